from pyspark.sql import functions as F

from corpusmill.operators import clean


def run(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", fn(F.col("t")).alias("c")).orderBy("i").collect()]


def test_wiki(spark):
    assert run(spark, clean.strip_wiki_sections, ["a\n== References ==\nb\n=== Sub ===\nc", "== Resources ==\nx", ""]) == ["a\n=== Sub ===\nc", "", ""]
    assert run(spark, clean.strip_wiki_markup, ["x [[A|b]] [[C]] {{t}} [z]"]) == ["x b C  z"]


def test_book_marks(spark):
    m = "PROJECT GUTENBERG X"
    assert run(spark, clean.strip_book_marks, [f"h\n*** START OF THIS {m}\nbody\n*** END OF THIS {m}\nf", "pre\nChapter I\ntext", f"*** END OF THE {m}\nx\n*** START OF THE {m}\ny", "plain"]) == ["body", "Chapter I\ntext", "", "plain"]


def test_toc(spark):
    lines = ["CONTENTS"] + ["CHAPTER I"] * 60 + ["text"]
    assert run(spark, clean.strip_toc, ["\n".join(lines)]) == ["\n".join(["CHAPTER I"] * 9 + ["text"])]


def test_wrapped(spark):
    assert run(spark, clean.merge_wrapped, ["won-\nderful", "a b\nc d", "a b\nC d", "a.\nb", "a\n\nb", "  a \n b"]) == ["wonderful", "a b c d", "a b\nC d", "a.\nb", "a\n\nb", "a b"]
