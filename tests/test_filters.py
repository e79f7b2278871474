import pytest
from pyspark.sql import functions as F

from corpusmill.operators import filters

P = "Words of prose that go on. "
CASES = [
    ("G0_length", "a" * 299, False), ("G0_length", "a" * 300, True), ("G0_length", "a" * 80000, True), ("G0_length", "a" * 80001, False),
    ("G1_alpha_ratio", "", False), ("G2_repeated_chars", "aaaaa", True), ("G2_repeated_chars", "aaaaaa", False), ("G2_repeated_chars", "\n" * 6, True), ("G2_repeated_chars", "\r" * 7, False),
    ("G3_weird_symbols", "a" * 99 + "é", True), ("G3_weird_symbols", "a" * 98 + "éé", False), ("G4_line_structure", " \n\n\t", True),
    ("G4_line_structure", "\n".join(["a line of some length here"] * 4 + ["A LINE OF SOME LENGTH HERE"]), True), ("G4_line_structure", "\n".join(["a line of some length here"] * 3 + ["A LINE OF SOME LENGTH HERE"] * 2), False),
    ("G5_boilerplate", "see our PRIVACY Policy here", False), ("C2_punct_spam", "a----b" + "c" * 50, False), ("C3_web_junk", "shipping " * 10, True), ("C3_web_junk", "shipping and checkout", False),
    ("C4_nav_patterns", "home about contact", True), ("C4_nav_patterns", "home about contact faq", False), ("C5_paragraph_quality", "\n".join(["x" * 25] * 15), True), ("C5_paragraph_quality", "x" * 5000, False),
    ("W2_short_paragraphs", "One. Two.", True), ("W2_short_paragraphs", "One sentence.", False), ("W1_list_heavy", "* a\n* b\nplain", False), ("W1_list_heavy", "", True),
    ("GUT2_poetry_heavy", "short\n" + "x" * 50, True), ("GUT2_poetry_heavy", "short\nshort\n" + "x" * 50, False), ("C6_entropy", "ab" * 50, False),
]


@pytest.mark.parametrize("rule", sorted({c[0] for c in CASES}))
def test_rule(spark, rule):
    cases = [c for c in CASES if c[0] == rule]
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", filters.passes(rule, F.col("t")).alias("p")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_first_reason_and_null(spark):
    df = spark.createDataFrame([(0, None), (1, "short"), (2, (P * 20).strip()), (3, "9" * 400)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", filters.reason(F.col("t"), filters.GLOBAL).alias("r")).collect()}
    assert got == {0: "null_text", 1: "G0_length", 2: "", 3: "G1_alpha_ratio"}
