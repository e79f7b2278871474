"""Nulls, blanks, long texts, repeated rows, ties, empty tables and clashing extra columns, for every operator."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusmill.llm")
from corpusmill.llm import furniture, markup, mixing, nearcopies, packing, personal, quality, queries, repetition, splits, tokens  # noqa: E402

DIR = "/root/testdata/sf0.001"
LONG = "The keeper slept all day. " * 6000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, "x" * 120_000), (None, "Some text without an id."), (6, "é" * 50), (7, "a")]


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DIR):
        if f.split(".")[0] in ("example", "documents", "checkpoints"):
            spark.read.parquet(f"{DIR}/{f}").limit(0).write.parquet(f"{base}/{f}")
        else:
            shutil.copy(f"{DIR}/{f}", f"{base}/{f}")
    return str(base)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_dir, name):
    df = queries.queries()[name](spark, empty_dir)
    if name in ("p7_fill",):
        assert df.count() == 2
    else:
        assert df.count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "example_id bigint, text string")
    return df.withColumns({c: F.lit("clash") for c in ("cls", "members", "lines", "band", "kinds", "found", "source", "n", "key", "token", "uses", "container")})


def test_row_operators(spark, odd):
    n = len(TEXTS)
    assert repetition.repetition(odd).count() == n
    rep = {r.example_id: r for r in repetition.repetition(odd).collect()}
    assert rep[1].band == "null" and rep[1].share is None and rep[2].band == "empty" and rep[2].share == 0 and rep[4].is_repetitive and not rep[7].is_repetitive
    stats = {r.example_id: r for r in quality.statistics(odd, frozenset(["the"])).collect()}
    assert stats[1].kind == "null" and stats[1].n_words is None and stats[3].kind == "blank" and stats[4].kind == "repetition"
    assert stats[3].sentence_share == 0 and stats[4].sentence_share > 0.9 and stats[5].sentence_share == 0
    pages = {r.example_id: r for r in furniture.furniture_lines(odd).collect()}
    assert pages[1].lines is None and pages[2].lines == [] and pages[2].body == ""
    kinds = {r.example_id: r for r in markup.markup(odd).collect()}
    assert kinds[1].kinds is None and kinds[2].kinds == [] and kinds[4].clean_text == LONG
    docs = odd.withColumnRenamed("example_id", "doc_id")
    lexicon = personal.Lexicon({"Anna"}, {"Sandstein", "Almstein", "Kolbstein"})
    found = {r.doc_id: r for r in personal.mentions(docs, lexicon, {}).collect()}
    assert found[1].found is None and found[2].found == [] and found[4].redacted == LONG


def test_pairs_with_odd_rows(spark, odd):
    members, links = nearcopies.class_links(odd, 0.8)
    assert sorted(r.example_id for r in members.collect()) == [4] and links.count() == 0
    rows = odd.withColumn("run_id", F.when(F.col("example_id") > 3, F.col("example_id") % 2))
    phases = spark.createDataFrame([(0, "val"), (1, "train")], "run_id bigint, phase string")
    val, train, links = splits.split_links(rows, phases, 0.8)
    assert links.count() == 0 and [r.example_id for r in val.collect()] == [4]


def test_sizes_with_odd_rows(spark, odd):
    t = tokens.Tokenizer(spark)
    docs = odd.withColumnRenamed("example_id", "doc_id").withColumn("source", F.lit("c4"))
    placed = packing.pack(docs, 64, t)
    per = {r.container: r.n for r in placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).collect()}
    assert max(per.values()) <= 64 and placed.filter("doc_id in (1, 2)").count() == 0
    sizes = mixing.token_sizes(docs, t)
    assert {r.doc_id for r in sizes.collect()} == {3, 4, 5, None, 6, 7}
