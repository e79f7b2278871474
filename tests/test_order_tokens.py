from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.operators import dedup, order, stats, tokens
from corpusmill.plans import pipeline
from corpusmill.sources import readers, writers


def test_running_and_budget(spark):
    df = spark.range(0, 500).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("g"))
    got = {r.pos: r.b for r in order.running(df, ["pos"], {"b": "v"}).collect()}
    want, total = {}, 0
    for i in range(500):
        want[i] = total
        total += i % 7
    assert got == want
    by = {r.pos: r.b for r in order.running(df, ["pos"], {"b": F.lit(1)}, ["g"]).collect()}
    assert by == {i: i // 3 for i in range(500)}
    three = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "pos int, n int")
    assert sorted(r.pos for r in order.within_budget(three, "pos", "n", 6).collect()) == [1, 2]


def test_interleave_shares(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "c4").otherwise("wiki").alias("source"))
    rows = order.interleave(df, {"c4": 0.25, "wiki": 0.75, "gutenberg": 0.0}, 1).orderBy("draw").limit(1500).collect()
    assert 0.2 < sum(r.source == "c4" for r in rows) / 1500 < 0.3
    assert [r.pos for r in rows if r.source == "wiki"] == sorted(r.pos for r in rows if r.source == "wiki")


def test_dedup(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "x" * 200 + "1"), (4, "X" * 200 + "2"), (5, None)], "pos int, text string")
    kept = dedup.keep_first(df, "text", "pos")
    assert sorted(r.pos for r in kept.collect()) == [1, 3]
    assert kept.count() == dedup.keep_first(kept, "text", "pos").count()


def test_tokens(spark, tmp_path):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [7])], "pos int, ids array<int>")
    packed = tokens.pack(df, "pos")
    assert [(r.pos, r.start) for r in packed.orderBy("pos").collect()] == [(1, 0), (2, 3), (3, 4)]
    flat = [r.token for r in tokens.stream(packed).orderBy("pos").collect()]
    assert flat == [5, 6, 2, 2, 7, 2]
    assert tokens.write_binary(packed, str(tmp_path / "bin"), 32000) == 6
    assert [r.token for r in tokens.read_binary(spark, str(tmp_path / "bin"), 2, 5).orderBy("pos").collect()] == flat[:5]
    got = {r.block: (r.x, r.y) for r in tokens.blocks(packed, 2).collect()}
    assert got == {0: ([5, 6], [6, 2]), 1: ([2, 2], [2, 7])}
    cut = df.select(tokens.until_eos(F.array(*[F.lit(i) for i in (5, 1, 5, 2, 6)])).alias("x")).first().x
    assert cut == [5, 5] and tokens.dtype_of(65535) == "uint16" and tokens.dtype_of(65536) == "uint32"


def test_subwords_round_trip(spark):
    df = spark.createDataFrame([(1, "The river ran high."), (2, None), (3, "")], "doc_id int, text string")
    coded = tokens.encode(df, "text")
    back = {r.doc_id: r.text for r in tokens.decode(coded).collect()}
    assert back == {1: "The river ran high.", 2: None, 3: ""}


def test_scan_and_control(spark):
    t = spark.createDataFrame([(0,), (31999,), (32000,)], "token int")
    r = stats.token_range(t, 32000).first()
    assert (r.out_of_range, r.max_id, r.consistent) == (1, 32000, True)
    assert stats.token_range(t.filter("false"), 32000).first().min_id == 0
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, size int")
    assert [x.name for x in stats.to_delete(files, files.filter("name = 'a'"), 9).collect()] == ["b", "c"]
    assert stats.to_delete(files, files, 0).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "v").write_text("<unk>\t0\n▁the\t-1\n")
    assert [(r.id, r.piece, r.score) for r in readers.vocabulary(spark, str(tmp_path / "v")).orderBy("id").collect()] == [(0, "<unk>", 0.0), (1, "▁the", -1.0)]
    lines = spark.createDataFrame([('{"cmd": "save", "tag": "x"}',), ("",), ("{broken",), ('{"other": 1}',)], "value string")
    assert [(r.cmd, r.tag) for r in readers.commands(lines).collect()] == [("save", "x")]
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.txt").write_bytes(b"caf\xe9 book")
    (tmp_path / "books" / "b.txt").write_bytes(b"")
    assert [r.text for r in readers.books(spark, str(tmp_path / "books")).collect()] == ["caf� book"]
    assert readers.load_state(str(tmp_path / "none")) is None and readers.empty(spark).count() == 0
    (tmp_path / "c.json").write_text('{"dedup_similarity_threshold": 0.9}')
    assert readers.config(str(tmp_path / "c.json")) == {"dedup_threshold": 0.9}
    df = spark.createDataFrame([(1, " a\nb "), (2, "\n"), (3, "cc")], "pos int, text string")
    assert [r.line for r in writers.tokenizer_text(df, "pos", 3).orderBy("pos").collect()] == ["a b"]


def test_split_has_no_leak(spark):
    df = spark.createDataFrame([(f"Text {i // 2}" + " " * (i % 2),) for i in range(400)], "text string")
    s = df.withColumn("split", pipeline.split_of(F.col("text"), 0.3))
    r = pipeline.overlap_report(s.filter("split = 'val'"), s.filter("split = 'train'")).first()
    assert r.shared == 0 and r.keys_a + r.keys_b == 200 and r.keys_a > 20


def test_headers_within_the_stream(spark, tmp_path):
    df = spark.range(0, 3).select(F.col("id").alias("doc_id"), F.col("id").alias("pos"), F.expr("repeat('river ', 100000)").alias("text"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    total = 3 * 600_001
    rows = registry.queries()["sample_headers"](spark, str(tmp_path)).orderBy("block").collect()
    assert [r.block for r in rows] == list(range((total - 1) // 2048))
    assert [r.next for r in rows] == [min(r.block * 2048 + 2048, total - 2049) for r in rows]
    assert f"({100 * rows[-1].block * 2048 / total:.2f}%)" in rows[-1].header


def test_whole_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    rows = registry.queries()["pipeline_packed"](spark, folder).orderBy("start").collect()
    docs = readers.table(spark, folder, "documents").select("doc_id", "pos", "source", "text")
    pieces = pipeline.corpus(docs, weights=registry.WEIGHTS).orderBy("draw", "doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx) for r in rows] == [(p.doc_id, p.chunk_idx) for p in pieces]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    coded = pipeline.packed_corpus(pipeline.corpus(docs, weights=registry.WEIGHTS), rows[3].start + 1, lambda df: tokens.encode(df, "chunk"))
    kept = {(r.doc_id, r.chunk_idx): r.text for r in tokens.decode(coded.select("doc_id", "chunk_idx", F.expr("slice(packed, 1, size(packed) - 1)").alias("ids"))).collect()}
    assert set(kept) == {(p.doc_id, p.chunk_idx) for p in pieces[:4]}
    assert all("".join(kept[p.doc_id, p.chunk_idx].split()) == "".join(p.chunk.split()) for p in pieces[:4])
