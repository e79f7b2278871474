"""Chunks by hand-worked cases and by what must hold of any; the queries compare them with SQL over whole tables."""

import os
import random
import re

import duckdb

from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.operators.chunk import chunks


def made(spark, texts, most=8000, least=500):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", chunks(F.col("t"), most, least).alias("c")).orderBy("i").collect()]


def test_short_texts(spark):
    texts = ["a" * 499, "a" * 500, "a" * 8000, "", None]
    assert made(spark, texts) == [[], [texts[1]], [texts[2]], [], None]


def test_long_texts(spark):
    cases = [
        ("a" * 9000, ["a" * 9000]),  # no place to cut
        ("x" * 8001 + "\n\n" + "y" * 600, ["x" * 8001, "y" * 600]),
        ("y" * 600 + "\n\n" + "x" * 8001, ["y" * 600, "x" * 8001]),
        ("p" * 4000 + "\n\n" + "q" * 3990 + "\n\n" + "r" * 700, ["p" * 4000 + "\n\n" + "q" * 3990, "r" * 700]),
        ("p" * 7000 + "\n\n \n\n" + "q" * 1200 + "\n\n" + "r" * 400, ["p" * 7000, "q" * 1200 + "\n\n" + "r" * 400]),
        ("p" * 7900 + "\n\n" + "q" * 300, ["p" * 7900]),  # the rest is too short
        ("s" * 4999 + ". " + "t" * 4999 + ". " + "u" * 2999 + ".", ["s" * 4999 + ".", "t" * 4999 + ". " + "u" * 2999 + "."[:1]]),
    ]
    got = made(spark, [t for t, _ in cases])
    assert got[:6] == [want for _, want in cases[:6]]
    assert got[6][0] == "s" * 4999 + "." and got[6][1].split() == ["t" * 4999 + ".", "u" * 2999 + "."]


def test_properties(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["word ", "End. ", "\n\n", "really? ", "x" * r.randint(1, 30), "\n"]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    for text, parts in zip(texts, made(spark, texts, 60, 10)):
        assert all(len(p) >= 10 for p in parts)
        for p in parts:  # over the limit only where it cannot be cut, joiners between sentences apart
            pieces = re.split(r"(?<=[.!?])\s+|\n\n", p)
            assert len(pieces) == 1 or sum(map(len, pieces)) <= 60
        at = 0
        bare = "".join(text.split())
        for p in parts:  # nothing invented, in order
            at = bare.index("".join(p.split()), at) + len("".join(p.split()))
    whole = made(spark, texts, 60, 0)
    assert ["".join("".join(w).split()) for w in whole] == ["".join(t.split()) for t in texts]


def test_long_texts_as_in_sql(spark, tmp_path):
    r = random.Random(2)
    sentence = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(5, 400))) + r.choice((". ", "? ", "! ", ", "))
    texts = ["".join(sentence() + r.choice(["", "", "", "\n\n", "\n"] if k % 3 else ["", "", "\n\n"] * 9) for _ in range(r.randint(20, 160))) for k in range(40)] + ["x" * 20_000, " ".join("word." for _ in range(4000))]
    spark.createDataFrame([(i, i, t, None) for i, t in enumerate(texts)], "doc_id bigint, pos bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, x.chunk_idx, x.chunk) for x in registry.queries()["chunk_text"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{os.path.join(tmp_path, 'documents.parquet')}/*.parquet'")
    rel = db.sql(registry.oracle_sql()["chunk_text"])
    assert got == sorted(rel.fetchall()) and sum(len(t) > 8000 for t in texts) > 20
