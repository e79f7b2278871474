"""Problem 3: per-document text quality statistics, and which records are natural prose by combined rules.

One pass over a text gives composition, line, word and repetition statistics and the share of its characters that stand
in sentences. A unit of text is a paragraph line, or several hard-wrapped lines; a stretch of a unit is a sentence if it
ends like one and has the words, the letters and the common words of one, and, where it is long, if repeated runs of words
don't dominate it. ``kind_of`` combines the statistics: duplicate lines, paragraphs and n-grams, lists and boilerplate can
each overrule the sentence share.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_map, read, valid_config

MIN_SENTENCE_SHARE = 0.5
SHORT_LINE = 20
WRAP_CHARS = 45
"""A line of at least so many characters that doesn't end a sentence may go on in the next line."""
MIN_WORDS = 3
MIN_LETTERS = 0.7
LONG_WORDS = 40
"""A stretch of more words must look like prose throughout: see ``is_sentence``."""
LONG_FUNCTION_SHARE, LONG_REPEATED_SHARE = 0.08, 0.5
MAX_DUPLICATE_SHARE, MAX_2GRAM_SHARE, MAX_4GRAM_SHARE = 0.9, 0.5, 0.7
"""Shares of duplicate lines or paragraphs and of the dominant n-gram above which a text is repetition, whatever its sentences."""
UNSURE = 0.05
"""Within this distance of ``MIN_SENTENCE_SHARE`` line statistics decide between prose and lists or boilerplate."""
#: Function words that hardly any sentence of some length lacks, in languages with Latin letters. Texts in
#: other scripts are told by their letters and end marks alone.
FUNCTION_WORDS = frozenset(
    "the a an and or but of to in on at by for with from as is are was were be been has had have it its this that these they their them we our you your he his she her "
    "nobody one every no not who which when while until since why how what "
    "der die das den dem des ein eine einen einem einer und oder aber nicht ist war im mit auf von zu für sich nach bei seit ohne "
    "le la les l un une des du de et ou mais ne pas est dans sur avec pour sous sans que qui quand car où "
    "el los las una unos y o pero no es en con por para del al se su sin cuando donde porque "
    "il lo gli di da che è e non per con sono della nel uno os as um uma não com em que het een van en niet op te zijn aan det och att som på inte är af til ikke w na nie się jest do że z i bir ve bu için".split()
)

_TAG = re.compile(r"<!--.*?-->|<[^<>\n]{1,200}>|&#?\w{1,10};", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)|\[\[[^\[\]|]*\||\{\{.*?\}\}|\\(?:cite|ref|label)\{[^{}]*\}|\\[A-Za-z]+\*?", re.S)
_END = re.compile(r"[.!?…؟।]+[\"'”’»)\]}*_`]*(?=\s|$)|[。！？]+[」』”）]*")
_CLOSERS = "\"'”’»)]}*_`」』）"
_END_MARKS = frozenset(".!?…。！？؟।")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1cff\u2c00-\ud7ff\uf900-\ufdff\ufe70-\ufefc]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"\s*(?:[-*•+›·–—>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\|)\s")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|=+[^=]+=+\s*$|\\(?:section|chapter|subsection)\b|CHAPTER\b|\*{3}|~{3}|`{3})")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:if|for|while|return|call|def|let|var)\b[^\n]*[:;\]]\s*$|\w\s?=\s?\w+[.(\[]")
_GAPS = re.compile(r"\S(?: {3,}|\t+)\S.*\S(?: {3,}|\t+)\S")
_CELLS = re.compile(r"[^\s,;|]*(?:[,;|][^\s,;|]*){3,}\s*$")
_DIGIT = re.compile(r"\d")
_LOG = re.compile(r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d")


def ends(line: str) -> bool:
    """Whether a stripped line ends with an end mark, quotes and brackets apart."""
    return line.rstrip(_CLOSERS)[-1:] in _END_MARKS


def structural(line: str) -> bool:
    """A line that is never part of a sentence because of its form."""
    if len(line) < 200 and len(_DIGIT.findall(line)) >= 6:
        cells = line.split()
        if 2 * sum(_DIGIT.search(c) is not None for c in cells) >= len(cells):
            return True
    if ("   " in line or "\t" in line) and _GAPS.search(line):
        cells = line.lower().split()
        if sum(c in FUNCTION_WORDS for c in cells) * 8 < len(cells):
            return True
    if " " not in line and _CELLS.match(line):
        return True
    if (line[-1:] in ";{}:] " or "=" in line) and _CODE.search(line):
        return True
    return bool(_HEADING.match(line) or _LOG.match(line))


def repeated_share(words: list[str], n: int = 5) -> float:
    """Share of ``words`` that stand in a run of ``n`` words which occurs more than once among them."""
    grams = list(zip(*(words[i:] for i in range(n))))
    times = Counter(grams)
    if len(times) == len(grams):
        return 0.0
    last, total = -n, 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            total += min(n, at - last)
            last = at
    return total / len(words)


def is_sentence(stretch: str) -> bool:
    """Whether a stretch that ends with an end mark reads like a sentence.

    It has words, mostly letters, and a function word unless it is in a script other than Latin. However long it is, it may
    be one; but more than ``LONG_WORDS`` words need function words throughout, and fewer than ``LONG_REPEATED_SHARE`` of
    them in repeated runs: otherwise it is keywords, or phrases strung together.
    """
    body = _ITEM.sub("", stretch, count=1) if _ITEM.match(stretch) else stretch
    words = _LETTERS.findall(body)
    solid = sum(map(len, body.split()))
    letters = sum(map(len, words))
    if letters < MIN_LETTERS * solid or not words:
        return False
    if _OTHER_SCRIPT.search(body):
        return len(words) >= MIN_WORDS or len(_UNSPACED.findall(body)) >= 2 * MIN_WORDS
    if len(words) < MIN_WORDS or letters > 14 * len(words):
        return False
    if len(words) <= LONG_WORDS:
        return not FUNCTION_WORDS.isdisjoint(words) or not FUNCTION_WORDS.isdisjoint(map(str.lower, words))
    low = [w.lower() for w in words]
    return sum(w in FUNCTION_WORDS for w in low) >= LONG_FUNCTION_SHARE * len(low) and repeated_share(low) < LONG_REPEATED_SHARE


def units(text: str) -> list[str]:
    """Lines that may hold sentences, hard-wrapped ones joined."""
    out: list[str] = []
    held = ""
    for line in text.split("\n"):
        bare = line.strip()
        form = bool(bare) and structural(line)
        if held and (not bare or form or _ITEM.match(line) or (bare[0].isupper() and len(held.rsplit("\n", 1)[-1]) < WRAP_CHARS)):
            out.append(held)
            held = ""
        if not bare or form:
            continue
        held = f"{held}\n{bare}" if held else bare
        if ends(bare) or len(bare) < SHORT_LINE:
            out.append(held)
            held = ""
    if held:
        out.append(held)
    return out


def sentence_chars(text: str) -> int:
    """Characters other than white space that stand in sentences; markup inside a sentence stands in it."""
    total = 0
    for unit in units(text):
        if "\n" in unit and structural(unit):
            continue
        plain = _LINK.sub(lambda m: " " * len(m.group()), _TAG.sub(lambda m: " " * len(m.group()), unit)) if any(c in unit for c in "<&[{\\") else unit
        at = 0
        for m in _END.finditer(plain):
            to = m.end()
            if is_sentence(plain[at:to].strip()):
                total += sum(map(len, unit[at:to].split()))
            at = to
    return total


def entropy(text: str) -> float:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def duplicate_share(parts: list[str]) -> float:
    """Share of the characters of ``parts`` that stand in parts seen before."""
    total = sum(map(len, parts))
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def dominant_share(words: list[str], n: int) -> float:
    """Share of all characters of words covered by the most frequent run of ``n`` words (if it occurs twice)."""
    if len(words) < 2 * n:
        return 0.0
    run, times = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
    return min(1.0, times * sum(map(len, run)) / sum(map(len, words))) if times > 1 else 0.0


MEASURES = (
    "n_chars int, n_words int, mean_word_length double, alpha_ratio double, symbol_ratio double, digit_ratio double, entropy double, n_lines int, punctuated_line_share double, "
    "short_line_share double, list_line_share double, common_word_share double, duplicate_line_share double, duplicate_paragraph_share double, "
    "dominant_2gram_share double, dominant_4gram_share double, sentence_share double, kind string, is_prose boolean"
)
_NAMES = [m.split()[0] for m in MEASURES.split(", ")]


def kind_of(m: dict) -> str:
    """Combined rules: ``prose``, or what a text is instead.

    Repetition comes first: a text whose lines or paragraphs are nearly all copies, or that one n-gram covers, is no prose,
    although its sentences are. Then the sentence share decides, with the form of the lines where it is close to the limit.
    """
    if max(m["duplicate_line_share"], m["duplicate_paragraph_share"]) > MAX_DUPLICATE_SHARE or m["dominant_2gram_share"] > MAX_2GRAM_SHARE or m["dominant_4gram_share"] > MAX_4GRAM_SHARE:
        return "repetition"
    share = m["sentence_share"]
    listed, furnished = m["list_line_share"] > 0.5, m["short_line_share"] > 0.5 and m["punctuated_line_share"] < 0.3
    if share >= MIN_SENTENCE_SHARE + UNSURE:
        return "prose"
    if share >= MIN_SENTENCE_SHARE - UNSURE:
        doubts = listed + furnished + (m["common_word_share"] < 0.05) + (m["dominant_4gram_share"] > 0.3 or m["duplicate_line_share"] > 0.5)
        if doubts == 0 and share >= MIN_SENTENCE_SHARE or doubts == 0 and m["punctuated_line_share"] > 0.9:
            return "prose"
    if m["dominant_4gram_share"] > 0.3 or m["duplicate_line_share"] > 0.3:
        return "repetition"
    if m["symbol_ratio"] > 0.3 or m["mean_word_length"] > 12:
        return "noise"
    if m["digit_ratio"] > 0.15:
        return "table"
    if listed:
        return "list"
    if m["common_word_share"] < 0.1:
        return "keywords"
    return "boilerplate" if m["short_line_share"] > 0.5 else "fragments"


def measure(text: str, common: frozenset[str]) -> dict:
    """All statistics of a text that is not null; shares of nothing are 0."""
    words = WORD.findall(text.lower())
    lines = [s for line in text.split("\n") if (s := line.strip())]
    solid = sum(map(len, text.split()))
    letters = sum(map(len, _LETTERS.findall(text)))
    digits = len(_DIGIT.findall(text))
    n, k = max(1, len(text)), max(1, len(lines))
    m = {
        "n_chars": len(text),
        "n_words": len(words),
        "mean_word_length": sum(map(len, words)) / max(1, len(words)),
        "alpha_ratio": letters / n,
        "symbol_ratio": (solid - letters - digits) / max(1, solid),
        "digit_ratio": digits / max(1, solid),
        "entropy": entropy(text),
        "n_lines": len(lines),
        "punctuated_line_share": sum(map(ends, lines)) / k,
        "short_line_share": sum(len(s) < SHORT_LINE for s in lines) / k,
        "list_line_share": sum(bool(_ITEM.match(s)) for s in lines) / k,
        "common_word_share": sum(w in common for w in words) / max(1, len(words)),
        "duplicate_line_share": duplicate_share(lines),
        "duplicate_paragraph_share": duplicate_share([p.strip() for p in text.split("\n\n") if p.strip()]),
        "dominant_2gram_share": dominant_share(words, 2),
        "dominant_4gram_share": dominant_share(words, 4),
        "sentence_share": sentence_chars(text) / solid if solid else 0.0,
    }
    m["kind"] = kind_of(m) if solid else "blank"
    m["is_prose"] = m["kind"] == "prose"
    return m


def common_words(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The words of the fixed table ``common_words`` (a few hundred rows)."""
    return frozenset(r[0].lower() for r in read(spark, sf_dir, "common_words").select("word").filter("word is not null").distinct().collect())


def statistics(records: DataFrame, common: frozenset[str]) -> DataFrame:
    """One row per row of ``records`` (example_id, text) with all statistics.

    A null text has null statistics and kind ``null``; a blank one has zeros and kind ``blank``; neither is prose.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        rows = [dict.fromkeys(_NAMES) | {"kind": "null", "is_prose": False} if t is None else measure(t, common) for t in c["text"]]
        return {"example_id": c["example_id"]} | {k: [r[k] for r in rows] for k in _NAMES}

    return arrow_map(records.select("example_id", "text"), run, f"example_id bigint, {MEASURES}")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a non-blank text of which less than half of the characters stand in sentences; each once."""
    rows = statistics(read(spark, sf_dir, "example"), common_words(spark, sf_dir))
    return rows.filter(~F.col("kind").isin("prose", "blank", "null")).select("example_id").distinct()


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every record, each once, and which of the valid base configuration's limits it breaks."""
    limits = valid_config(spark, sf_dir).select("min_alpha_ratio", "c4_min_entropy", "max_short_line_ratio").first()
    rows = statistics(read(spark, sf_dir, "example"), common_words(spark, sf_dir)).dropDuplicates(["example_id"])
    alpha, low, short = limits if limits else (None, None, None)
    return rows.select("*", (F.col("alpha_ratio") < F.lit(alpha)).alias("below_alpha"), (F.col("entropy") < F.lit(low)).alias("below_entropy"), (F.col("short_line_share") > F.lit(short)).alias("over_short_lines"))
