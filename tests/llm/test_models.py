"""Classifiers and rules on held-out, invented texts."""

import random
import sys
from pathlib import Path

import pytest

pytest.importorskip("corpusmill.llm")
from corpusmill.llm import furniture, markup, personal, personal_labels, quality  # noqa: E402

sys.path.insert(0, str(Path(__file__).parent))
import held_out_personal  # noqa: E402


@pytest.mark.parametrize("text", [
    "The boat left at dawn. Nobody saw it, and the keeper slept.", "the boat left at dawn and nobody saw it.", "THE BOAT LEFT AT DAWN. NOBODY SAW IT GO.", "\"We saw the boat,\" said the clerk, in the rain.",
    "The boat left in the early\nmorning, long before the keeper\nwoke, and it came back with\nan empty hold and a torn sail.", "<p>The <b>boat</b> left at dawn, and [[it]] came &amp; went.</p>", "Der Weg führt durch den Wald.", "La rivière monte encore après la pluie.",
    "The  boat  left  at  dawn,  and  nobody  saw  it.",
])
def test_prose(text):
    assert quality.measure(text, frozenset())["is_prose"]


@pytest.mark.parametrize("text", [
    "boat, sail, oar, rope\nnet, hook", "1. sail\n2. oar\n3. rope", "2024-05-01T10:22:31 WARN boat.sail code=12 took=38ms\n2024-05-01T10:22:35 INFO boat.sail code=1 took=3ms", "Home | News | Shop", "call sail(3);\nif oar > 3:\n  return net[2]",
    "200 g sugar\n3 cups flour\n12 pcs red apples", "Ashby 8:10 9:25 daily\nNorton 8:30 9:50 Sat", "boat    12.5    n/a\nsail    n/a    7.1", "S2Oxs4OKqRhdBMM0FevNvU2kkAYJjkOW9S2lHOdNyLyZJ2xCJSw", "#*+^^%=++~.@%&!:-?+#;&_-@ rope 8072.",
    "beside the boat and beside the boat and beside the boat and", "How the boat was sold\nThe Old Sail Of Ashby\n12 Ways To Mend A Net",
])
def test_not_prose(text):
    assert not quality.measure(text, frozenset())["is_prose"]


NOUNS = "clause lease tenant owner court notice rent payment sum term house clerk judge paper witness seal copy date sale land field fence water road".split()


def test_long_sentences():
    r = random.Random(1)
    legal = " ".join(f"the {r.choice(NOUNS)} of the {r.choice(NOUNS)} is {r.choice(NOUNS)} to a {r.choice(NOUNS)}," for _ in range(20)) + " and so on."
    assert len(legal.split()) > 190 and quality.measure(legal, frozenset())["is_prose"]
    strung = "beside the lease of the owner " * 30 + "of the court."
    assert quality.measure(strung, frozenset())["kind"] == "repetition"
    assert not quality.measure(" ".join(r.choice(NOUNS) for _ in range(120)) + " the end.", frozenset())["is_prose"]


@pytest.mark.parametrize("text", ["Корабль ушёл на рассвете. Никто его не видел.", "船は夜明けに出た。誰もそれを見なかった。", "La barca partì all'alba, e nessuno la vide.", "Łódź wypłynęła o świcie i nikt jej nie widział.", "Το πλοίο έφυγε την αυγή."])
def test_prose_of_other_languages(text):
    assert quality.measure(text, frozenset())["is_prose"]


def test_every_statistic_counts():
    line = "The boat left at dawn and nobody saw it."
    assert quality.measure(line, frozenset())["is_prose"]
    assert quality.measure("\n".join([line] * 60), frozenset())["kind"] == "repetition"
    assert quality.measure("\n\n".join([f"{line}\nThe keeper slept."] * 30), frozenset())["kind"] == "repetition"
    m = quality.measure(line, frozenset())
    near = m | {"sentence_share": 0.51, "common_word_share": 0.3}
    assert quality.kind_of(near) == "prose"
    for change, kind in (
        ({"list_line_share": 0.6}, "list"), ({"short_line_share": 0.7, "punctuated_line_share": 0.1}, "boilerplate"), ({"common_word_share": 0.01}, "keywords"), ({"dominant_4gram_share": 0.5}, "repetition"),
        ({"duplicate_line_share": 0.6}, "repetition"), ({"duplicate_paragraph_share": 0.95}, "repetition"), ({"dominant_2gram_share": 0.6}, "repetition"),
    ):
        assert quality.kind_of(near | change) == kind
    assert quality.kind_of(near | {"sentence_share": 0.47}) == "prose"
    assert quality.kind_of(near | {"sentence_share": 0.47, "punctuated_line_share": 0.5}) != "prose"


def test_page():
    page = [
        ("Toggle navigation", 1), ("News | Shop | Contact | Help", 1), ("The quiet well of Norton", 0), ("The well was dug in 1840, and it never ran dry!", 0), ("Sponsored", 1), ("Later wells", 0), ("", 0),
        ("We use cookies to improve your visit.", 1), ("The cookies at the fair were sold out by noon, although the baker had made twice as many.", 0), ("More from The Norton Post", 1), ("How Norton dug its well", 1), ("7 cheap ways to keep a well", 1),
        ("© 2020 The Norton Post. All rights reserved.", 1), ("| depth | 12 |", 0), ("Back to top", 1),
    ]
    numbers, bad = furniture.classify("\n".join(t for t, _ in page))
    assert [n for n, b in zip(numbers, bad) if b] == [i for i, (_, f) in enumerate(page, 1) if f]


def test_long_side_list():
    titles = [f"How {place} dug its {thing}" for place in ("Norton", "Ashby", "Holm", "Weston") for thing in ("well", "pond", "quay")]
    counts = [f"{w} ({n})" for n, w in enumerate("Boats Wells Nets Mills Maps Clocks Dogs Weirs".split(), 3)]
    page = ["The quiet well of Norton", "The well was dug in 1840, and it never ran dry!", "Recent posts", *titles, "The well is open on Sundays, and the keeper shows it to every guest.", "Categories", *counts, *titles]
    numbers, bad = furniture.classify("\n".join(page))
    assert [n for n, b in zip(numbers, bad) if b] == [*range(3, 16), *range(17, 26)]


HELD_OUT = """
-Skip to article
-Politics | Business | Culture | Help
+Old lighthouse to become a hotel
+The lighthouse at the cape has stood empty since 1989, but a family from Bergen wants to change that.
-Advertising
+"We will keep the lamp," said the architect, who grew up beside it.
+Costs
+The work will cost four million, and it begins in May.
-Share this story
-Tags: hotels, coast
-Related stories
-Harbor master retires after forty years
-The Best Beaches Of The North
+
-Sign in to comment
-© 2023 Cape Courier
=
-We use cookies on this site to analyse traffic. OK
-Home › Garden › Bees
+Keeping bees on a roof
+Bees need water, shade and flowers. A roof can offer all three if the wind is not too strong.
+- water
+- shade
+| hive | 120 |
+Two hives are enough for a beginner.
-Click for a larger picture
-Read also: Honey that never hardens
-Subscribe to our letter about bees.
-You may also like
-How to plant lavender
-Ten flowers for a dry summer
-Archives
-June (8)
-July (15)
-Newer
"""


def test_held_out_pages():
    right = total = missed = 0
    for page in HELD_OUT.strip("\n").split("\n=\n"):
        rows = [r for r in page.split("\n") if r.strip("+- ")]
        _, bad = furniture.classify("\n".join(r[1:] for r in rows))
        right += sum(b == (r[0] == "-") for r, b in zip(rows, bad))
        total += len(rows)
        missed += sum(r[0] == "+" and b for r, b in zip(rows, bad))
    assert right / total > 0.9 and missed <= 1


CASES = [
    ("<div><p>Rain &amp; wind</p></div>", ["html"]), ("# Boats\nThey *left* early.", ["markdown"]), ("The [[river Ash|river]] is '''old'''.", ["wiki"]), ("It is $\\frac{1}{n}$ here.", ["latex"]), ("A rope cost $5 here and $9 there, see [3].", []),
    ("* one\n* two\n- three", []), ("if x < 3 and y > 4 then stop", []), ("The file mast_sail_12 is lost.", []), ("```\nrun(3)\n```\n\\emph{x}", ["latex", "markdown"]), ("*** START OF THE PROJECT X ***", []), ("+=~*_#%^&;:!_*?#@^ rope 12", []),
]


@pytest.mark.parametrize("text, kinds", CASES)
def test_markup(text, kinds):
    tree = markup.analyse([text])[0]
    assert markup.kinds_of(tree) == kinds
    if not kinds:
        assert markup.clean(text, tree) == text


def test_clean_text():
    text = "<h2>Boats</h2>\n<ul><li>red <b>sail</b></li><li>oar</li></ul>\nA [[river Ash|Ash]] &amp; '''mill'''.\n```sh\ncall *x*(3)\n```\n$x_{1} = \\frac{1}{n}$"
    assert markup.clean(text, markup.analyse([text])[0]) == "## Boats\n\n- red sail\n- oar\n\nA Ash & mill.\n```\ncall *x*(3)\n```\n$x_{1} = \\frac{1}{n}$"


Q = "'" * 3
NESTED = [
    ("\\textbf{old \\emph{mill} here}", "old mill here", ["latex"]), ("\\section{The \\emph{old} mill}", "## The old mill", ["latex"]), ("{{Infobox {{nested|x}} |y=1}} Text.", " Text.", ["wiki"]),
    (f"See [the mill](/{'x' * 400}).", "See the mill.", ["markdown"]), (f"A {{{{cite {'long words ' * 300}}}}} text.", "A  text.", ["wiki"]), (f"So $${'a + ' * 400} b$$ holds.", f"So $${'a + ' * 400} b$$ holds.", ["latex"]),
    (f"<p class=\"{'c ' * 300}\">Old <b>mill</b></p>", "Old mill", ["html"]), ("== Later ''use'' ==\nIt was sold.", "## Later use\nIt was sold.", ["wiki"]), (Q + "Ashby's" + Q + " mill", "Ashby's mill", ["wiki"]),
    ("<pre>a = b &lt; c\n  d</pre>", "```\na = b < c\n  d\n```", ["html"]), ("\\begin{verbatim}\nx = 1\n\\end{verbatim}", "```\nx = 1\n```", ["latex"]), ("# Boats\nText with `code`.", "# Boats\nText with `code`.", ["markdown"]),
]


@pytest.mark.parametrize("text, plain, kinds", NESTED)
def test_nested_and_long_markup(text, plain, kinds):
    tree = markup.analyse([text])[0]
    assert markup.kinds_of(tree) == kinds
    assert markup.clean(text, tree).strip() == plain.strip()


def test_siblings_and_attributes_are_features():
    text = "<p>Bees sleep.</p>\n<p>Bees fly.</p>\n# Bees\n<a href=\"/x\">Bees</a>"
    nodes = markup.describe(text, markup.parse(text))
    assert [n.siblings[0] > 1 for n in nodes] == [True] * 4 and nodes[0].siblings[6] and not nodes[1].siblings[6] and nodes[2].siblings[7]
    other = text.replace("href", "hrex")
    assert nodes[3].x != markup.describe(other, markup.parse(other))[3].x


def test_odd_braces_end_soon():
    for text in ("{{" * 20_000, "}}" * 20_000, "\\emph{" * 20_000, "<a " * 20_000, "<!-- " * 20_000, "\\[ " * 20_000, "**a " * 5_000, "{{a " * 3_000 + "}}" * 3_000, "\\emph{a " * 3_000 + "}" * 3_000):
        markup.clean(text, markup.analyse([text])[0])


def test_opaque_nodes_have_no_markup_inside():
    tree = markup.analyse(["```\na **b** [c](/d)\n```"])[0]
    chosen = [n for r in tree for n in r.all() if n.chosen]
    assert [n.kind for n in chosen] == ["fence"]


def test_personal_held_out():
    assert not set(held_out_personal.TEMPLATES + held_out_personal.HARMLESS) & set(personal_labels.TEMPLATES + personal_labels.HARMLESS)
    ends = ["stein", "brook", "ford", "wright"]
    lexicon = personal.Lexicon(set(), {f"{s}{e}" for s in ("Alm", "Kolb", "Sand", "Torr") for e in ends})
    weights = personal.fitted(lexicon)
    texts, given, family = personal_labels.labelled(ends, 600, 99, held_out_personal.TEMPLATES, held_out_personal.HARMLESS)
    known = personal.Lexicon(given, family)
    known.ends = lexicon.ends
    hit = found = true = 0
    for text, marks in texts:
        want = {(a, t) for a, _, t in marks}
        got = {(a, t) for a, _, t in personal.segment(personal.candidates(text, known), weights)}
        hit, found, true = hit + len(want & got), found + len(got), true + len(want)
    print(f"held-out recall {hit / true:.4f}, precision {hit / found:.4f}")
    assert hit / true > 0.95 and hit / found > 0.95


def test_likelihood_gradient():
    """The expected counts are the derivatives of the log partition sum, by differences."""
    spans = [(0, 4, "person", ["a"]), (2, 6, "phone", ["b"]), (7, 9, "email", ["c"]), (12, 15, "person", ["a", "c"])]
    weights = {"a": 0.3, "b": -0.2, "c": 0.7, "person>email": -0.5, "email>person": 0.4}
    links = personal._links(spans)
    p, pairs, z = personal._expected(spans, links, weights)
    step = 1e-6
    for name, want in (("a", p[0] + p[3]), ("b", p[1]), ("c", p[2] + p[3]), ("person>email", sum(s for j, i, s in pairs if (j, i) == (0, 2))), ("email>person", sum(s for j, i, s in pairs if (j, i) == (2, 3)))):
        moved = personal._expected(spans, links, weights | {name: weights[name] + step})[2]
        assert abs((moved - z) / step - want) < 1e-4


def test_redaction():
    lexicon = personal.Lexicon({"Anna"}, {"Sandstein", "Almstein", "Kolbstein"})
    weights = personal.fitted(lexicon)
    text = "Contact: Anna Sandstein, tel. (212) 555-0164, anna.sandstein@mail.lamp.example\nOrder 318-3175292 left Norwell."
    out = personal.redact(text, personal.segment(personal.candidates(text, lexicon), weights))
    assert out == "Contact: [PERSON], tel. [PHONE], [EMAIL]\nOrder 318-3175292 left Norwell."
