"""Operators with an exact definition against brute force on generated texts and whole small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("corpusmill.llm")
from corpusmill.llm import mixing, nearcopies, packing, repetition, splits, tokens  # noqa: E402
from corpusmill.llm.shingles import WordCodes  # noqa: E402

W = re.compile(r"[^\W_]+")
VOCAB = [f"w{i}" for i in range(400)]


def sets(text):
    w = W.findall(text.lower())
    return set(zip(w, w[1:], w[2:]))


def make(seed, groups=25):
    """Groups of texts with small edits, insertions and reordering, exact copies, and embedded short texts."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice(VOCAB) for _ in range(r.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(VOCAB)] * r.randint(0, 2)
            if r.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            if r.random() < 0.3:
                w = [r.choice(VOCAB) for _ in range(40)] + w + [r.choice(VOCAB) for _ in range(40)]
            out.append(" ".join(w))
    r.shuffle(out)
    return out


def test_repeated_words():
    r = random.Random(2)
    for _ in range(200):
        words = [r.choice("abcdefg") for _ in range(r.randint(0, 60))]
        seen, mark = set(), [False] * len(words)
        for i in range(len(words) - 4):
            run = tuple(words[i : i + 5])
            if run in seen:
                mark[i : i + 5] = [True] * 5
            seen.add(run)
        assert repetition.repeated_words(words, WordCodes()) == sum(mark)


def test_repeated_words_of_any_vocabulary(spark):
    r = random.Random(6)
    code = lambda n=8: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    codes = [code() for _ in range(3000)]
    codes += [w for at in r.sample(range(0, 3000, 5), 600) for w in codes[at : at + 5]]  # half of 54 KB is repeated
    mixed = [w for _ in range(300) for w in [*(code(60) for _ in range(5)), "a", "b", "c", "d", "e"]]  # few bytes, half of the words
    texts = [" ".join(codes), " ".join(mixed), " ".join(code() for _ in range(6000))]
    rows = {x.example_id: x for x in repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "example_id bigint, text string")).collect()}
    assert [rows[i].is_repetitive for i in range(3)] == [True, True, False]
    assert {rows[i].band for i in (0, 1)}.isdisjoint({"repetitive"})
    assert rows[0].share == 0.5 and rows[1].share > 0.49 and rows[2].repeated_words == 0


def test_repetition_of_any_length(spark):
    """Texts of 1 KB to 10 MB, of rich and poor vocabularies, with shares about the limit: all above it are found, no other."""
    r = random.Random(8)
    texts, want = [], []
    for size in (150, 600, 2000, 7000, 22_000, 70_000, 600_000, 1_500_000):
        for words in (60_000, 3000):
            for share in (0.25, 0.31, 0.35, 0.6):
                fresh = [f"w{r.randrange(words)}" for _ in range(size)]
                again = int(size * share / 2) if size > 500_000 else int(size * share)
                again -= again % 10
                at = r.randrange(size - again)
                text = fresh[: size - again] + (fresh[at : at + again] if size > 500_000 else [w for k in range(again // 10) for w in fresh[10 * k : 10 * k + 10]])
                if size <= 70_000 or (words == 60_000 and share in (0.25, 0.6)):
                    texts.append(" ".join(text))
                    seen, mark = set(), bytearray(len(text))
                    for i in range(len(text) - 4):
                        run = tuple(text[i : i + 5])
                        if run in seen:
                            mark[i : i + 5] = b"\1" * 5
                        seen.add(run)
                    want.append(sum(mark) / len(text) > 0.30)
    texts.append(" ".join(f"w{r.randrange(60_000)}" for _ in range(700_000)))
    texts[-1] += " " + texts[-1]  # a passage of 4 MB said twice
    want.append(True)
    rows = {x.example_id: x for x in repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "example_id bigint, text string")).collect()}
    assert [rows[i].is_repetitive for i in range(len(texts))] == want and 0 < sum(want) < len(want)
    assert max(map(len, texts)) > 9_000_000 and rows[len(texts) - 1].ratio < 0.3  # far repeats show in the ratio too


@pytest.mark.parametrize("hot", [2000, 2])
def test_near_copies(spark, hot):
    """Also with nearly all members hot, so that pairs come by ranges of size and salts."""
    texts = make(1)
    df = spark.createDataFrame(list(enumerate(texts)), "example_id bigint, text string")
    members, links = nearcopies.class_links(df, 0.8, hot=hot)
    cls = {r.example_id: r.cls for r in members.collect()}
    got = {(r.cls_a, r.cls_b) for r in links.collect()}
    all_sets = {i: sets(t) for i, t in enumerate(texts)}
    for a, b in combinations(all_sets, 2):
        x, y = all_sets[a], all_sets[b]
        if x and y:
            near = len(x & y) / len(x | y) >= 0.8
            assert near == (cls[a] == cls[b] or (min(cls[a], cls[b]), max(cls[a], cls[b])) in got)
    assert len(got) > 10


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x.node: x.root for x in nearcopies.components(links, "a", "b", hot_rows=20).collect()}
    assert got == {n: find(n) for n in list(parent)}
    with pytest.raises(RuntimeError):
        nearcopies.components(links, "a", "b", rounds=1)


def test_pruning_bound():
    least = nearcopies.least_agreements(0.8, 1e-7)
    assert all(0 < m < n * 0.8 for n, m in least.items()) and sorted(least) == [16, 32, 48, 64]


@pytest.mark.parametrize("hot", [2000, 2])
def test_splits(spark, hot):
    """Also with nearly all keys hot, so that they are spread over salts."""
    texts = make(7, 40)
    rows = [(i, i % 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "example_id bigint, run_id bigint, text string")
    phases = spark.createDataFrame([(0, "val"), (1, "train"), (2, "train")], "run_id bigint, phase string")
    val, train, links = splits.split_links(df, phases, 0.8, hot=hot)
    v, t = ({r.example_id: r.cls for r in side.collect()} for side in (val, train))
    got = {(r.cls_v, r.cls_r) for r in links.collect()}
    hits = 0
    for a in v:
        for b in t:
            x, y = sets(texts[a]), sets(texts[b])
            near = len(x & y) / len(x) >= 0.8
            hits += near
            assert near == ((v[a], t[b]) in got), (texts[a], texts[b])
    assert hits > 10


def test_splits_of_periodic_and_short_texts(spark):
    val = ["p q r s " * 3, "z " * 9, "one two three " * 40, "a b c", "a b c d e", "x y x y x y x y", "k l m n o k l m n o k l m", "the red cat sat. " * 5 + "the dog ran off."]
    train = ["p q r s p q", "z z z", "one two three one two", "a b c", "x a b c d e y", "x y x y", "k l m n o k l", "the red cat sat the red", "so the red cat sat the red cat the dog ran off sat the dog", "q r s p q r s"]
    rows = [(i, 0, x) for i, x in enumerate(val)] + [(100 + i, 1, x) for i, x in enumerate(train)]
    phases = spark.createDataFrame([(0, "val"), (1, "train")], "run_id bigint, phase string")
    v, r, links = splits.split_links(spark.createDataFrame(rows, "example_id bigint, run_id bigint, text string"), phases, 0.8)
    got = {(a.example_id, b.example_id) for a, b, c in ((a, b, c) for c in links.collect() for a in v.collect() for b in r.collect() if a.cls == c.cls_v and b.cls == c.cls_r)}
    want = {(i, 100 + j) for i, x in enumerate(val) for j, y in enumerate(train) if len(sets(x) & sets(y)) / len(sets(x)) >= 0.8}
    assert got == want and len(want) >= 8


def test_posted_passages_of_edited_copies():
    """However a copy is edited, it has as many of the posted passages as are asked for; most texts post few."""
    r, known, counts, hits, few = random.Random(11), WordCodes(), np.zeros(1 << 10, np.uint16), 0, 0
    code = lambda words: splits.word_codes([" ".join(words)], known)[0]
    for k in range(600):
        base = [r.choice(VOCAB) for _ in range(r.randint(40, 300))]
        if k % 5 == 0:
            base[20:30] = base[:10] * r.randint(1, 3)  # repeats itself
        copy, every, kind = [], r.randint(7, 16), r.randrange(4)
        for i, w in enumerate(base):
            cut = i % every == every // 2 if k % 2 else r.random() < 1 / every
            copy += [[w, "new"], ["new"], [], ["new", w]][kind] if cut else [w]
        if k % 3 == 0:
            at = r.randrange(len(copy))
            copy = ["before"] + copy[at:] + copy[:at]  # moved
        x, y = sets(" ".join(base)), sets(" ".join(copy))
        w = code(base)
        least, codes = splits.posted(splits.passages(w), splits.runs(w, 3), counts, len(x), 0.8)
        assert 1 <= least <= len(codes) and len(np.unique(codes)) == len(codes)
        few += len(codes) <= len(base) / 6
        if len(x & y) / len(x) >= 0.8:
            hits += 1
            assert len(np.intersect1d(codes, splits.passages(code(copy)))) >= least, (base, copy)
    assert hits > 100 and few > 300


def test_full_bitmap_lets_few_codes_through(spark, monkeypatch):
    """With a bitmap of the greatest size, of 7 bits for a validation passage; no train text has any of them."""
    monkeypatch.setattr(splits, "BITMAP_BITS", (12, 16))
    r = random.Random(12)
    side = lambda of, n: spark.createDataFrame([(i, " ".join(f"{of}{r.randrange(10**6)}" for _ in range(240))) for i in range(n)], "example_id bigint, text string")
    val = splits.held_out_codes(side("v", 40), np.zeros(1 << 10, np.uint16), 0.8).cache()
    bitmap, _ = splits.key_summary(splits.asked_rows(val, None), 3 * sum(len(x.codes) for x in val.collect()))
    through = sum(len(x["keys"]) for x in splits.train_codes(side("t", 60), bitmap).collect())
    assert through < 0.02 * 60 * 235


def test_majority():
    r = np.random.default_rng(1)
    w = r.integers(0, 1 << 63, 40, np.uint64)
    for width in (3, 5, 9):
        got = splits.majority(w, width)
        for i, g in enumerate(got.tolist()):
            part = [int(x) for x in w[i : i + width]]
            assert g == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in part) > width // 2)


def test_packing(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(VOCAB) for _ in range(r.choice([2, 10, 40, 300])))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    t = tokens.Tokenizer(spark)
    placed = packing.pack(df, 256, t, windows=8).collect()
    used = {}
    whole = {}
    for p in placed:
        used[p.container] = used.get(p.container, 0) + p.n_tokens
        whole.setdefault(p.doc_id, []).append(p)
    assert max(used.values()) <= 256 and set(whole) == {d for d, _ in docs}
    size = mixing.token_sizes(df.selectExpr("doc_id", "text", "'c4' as source"), t)
    for d in size.collect():
        parts = sorted(whole[d.doc_id], key=lambda p: p.piece)
        assert sum(p.n_tokens - 1 for p in parts) == d.n_tokens
        assert (len(parts) > 1) == (d.n_tokens + 1 > 256)
    assert sum(used.values()) / (256 * len(used)) > 0.93


def test_long_text_tokens(spark):
    t = tokens.Tokenizer(spark)
    text = "The river ran high, and 42 men slept. " * 3000
    assert "".join(tokens.parts(text)) == text and len(tokens.parts(text)) > 3
    encoding = tokens._built(t._key, t._held)
    assert t.count(text) == len(encoding.encode_ordinary(text))


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["c4"] * 8 + ["wiki", "gutenberg"]), r.randint(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    meta = {"c4_weight": 0.3, "wiki_weight": 0.45, "gutenberg_weight": 0.25, "size_factor": 0.5, "max_repeats": 3, "seed": 9}
    uses, plan = mixing.mix(df, meta)
    got = uses.collect()
    assert len(got) == len(rows)
    for s, p in plan.items():
        mine = [x for x in got if x.source == s]
        total = sum(x.n_tokens * x.uses for x in mine)
        assert max(x.uses for x in mine) <= 3
        assert max(x.uses for x in mine) - min(x.uses for x in mine) <= 1
        assert abs(total - min(p["budget"], 3 * p["have"])) <= 25
    before = {x.doc_id: x.before for x in mixing.keyed(df, 9).collect()}
    assert len({(s, b) for (i, s, _), b in ((row, before[row[0]]) for row in rows)}) == len(rows)


def test_mix_without_weight(spark):
    df = spark.createDataFrame([(1, "c4", 10), (2, "wiki", 10)], "doc_id bigint, source string, n_tokens bigint")
    meta = {"c4_weight": 0, "wiki_weight": None, "gutenberg_weight": 0.0, "size_factor": 1.0, "max_repeats": 1, "seed": None}
    assert {x.uses for x in mixing.mix(df, meta)[0].collect()} == {0}
