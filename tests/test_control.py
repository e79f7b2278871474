import pytest
from pyspark.sql import functions as F

from corpusmill import durable
from corpusmill.operators import clean, control, filters, tokens
from corpusmill.sources import readers
from corpusmill.streaming import incremental


def test_settings():
    base = {"training": {"learning_rate": 1}, "name": "a"}
    assert control.setting(base, "training.learning_rate") == 1 and control.setting(base, "name.x", 7) == 7
    assert control.with_setting(base, "checks.loss.max", 3) == base | {"checks": {"loss": {"max": 3}}} and "checks" not in base
    assert control.with_setting(base, "name.x", 3)["name"] == {"x": 3}
    assert control.applied(base, [("training.eval_interval", "0"), ("training.learning_rate", "0.5"), ("model.size", 9)]) == {"training": {"learning_rate": 0.5, "eval_interval": 1}, "name": "a"}
    assert control.prompts({"prompt_list": ["b"]}, {"prompts": ["a", None]}) == ["a", "b"] and control.prompts({}) == [control.DEFAULT_PROMPT]
    manifest = {"last": "s3", "best": [{"step": "s1"}, {"step": "s2"}], "good_slots": {"good_1": "s0", "good_2": None}}
    assert [control.slot_step(manifest, s) for s in ("last", "best", "good_1", "none")] == ["s3", "s1", "s0", None]
    assert control.protected_steps(manifest) == {"s0", "s1", "s2", "s3"} and control.slot_step({}, "best") is None


def test_commands(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"cmd": "set", "path": "a.b", "value": "1"}\n\n{"cmd": "set", "path": "a.b", "value": "é"}\n')
    lines, end = control.commands_from(spark, str(path))
    parsed = readers.commands(lines.withColumn("run", F.lit(1)), "value")
    assert parsed.count() == 2 and end == path.stat().st_size
    with path.open("a") as f:
        f.write('{"cmd": "stop_training", "save": false}\n{"cmd": "pin_checkpoint", "slot": "other"}\n{"cmd": "pin_checkpoint"}\n{"cmd": "sample_prompt", "prompt": "x"}\n')
    more, _ = control.commands_from(spark, str(path), end)
    both = lines.select((F.col("at")).alias("o"), "value").unionByName(more.select((F.col("at") + 100).alias("o"), "value"))
    c = both.select("o", F.from_json("value", readers.COMMAND).alias("c")).select(F.lit(1).alias("run"), "o", "c.*")
    assert [(r.path, r.value) for r in control.updates(c, ["run"], "o").collect()] == [("a.b", "é")]
    assert control.updates(c, ["run"], "o", ["x"]).count() == 0
    r = control.actions(c, ["run"], ["good_1"], "o").first()
    assert (r.prompts, r.pins, r.stop, r.save) == (["x"], ["good_1"], True, False)
    none, same = control.commands_from(spark, str(tmp_path / "none"), 5)
    assert none.count() == 0 and same == 5


def test_state(spark, tmp_path):
    state = {k: 1 for k in control.STATE} | {"phase": "train", "timestamp": "t"}
    control.save_state(spark, str(tmp_path / "s.json"), state | {"other": 2})
    assert readers.load_state(str(tmp_path / "s.json")) == state
    with pytest.raises(KeyError):
        control.save_state(spark, str(tmp_path / "t.json"), {"phase": "val"})


def test_book_files(spark, tmp_path):
    (tmp_path / "list").write_text("".join(f"train/{i}.txt\n" for i in range(50)) + "\n")
    one = [r.path for r in readers.book_files(spark, str(tmp_path / "list"), "https://x/", 1).orderBy("place").collect()]
    two = [r.path for r in readers.book_files(spark, str(tmp_path / "list"), "https://x/", 2).orderBy("place").collect()]
    assert sorted(one) == sorted(two) and one != two and len(one) == 50 and one[0].startswith("https://x/train/")


def test_own_lists(spark):
    df = spark.createDataFrame([("buy the lamp and the rope now",)], "t string")
    own = filters.Limits(junk_words=("lamp", "rope"), boilerplate=("lamp and",))
    assert df.select(filters.passes("C3_web_junk", F.col("t"), own)).first()[0] is False and df.select(filters.passes("C3_web_junk", F.col("t"))).first()[0] is True
    assert df.select(filters.passes("G5_boilerplate", F.col("t"), own)).first()[0] is False
    page = spark.createDataFrame([("a\n== Press ==\nb\n== See also ==\nc",)], "t string")
    assert page.select(clean.strip_wiki_sections(F.col("t"), ["press"])).first()[0] == "a\n== See also ==\nc"


def test_marked_decoding(spark):
    df = spark.createDataFrame([(1, "The river"), (2, "ran high.")], "doc_id int, text string")
    a, b = (r.ids for r in tokens.encode(df, "text").orderBy("doc_id").collect())
    rows = spark.createDataFrame([(1, [*a, 2, 2, *b]), (2, a), (3, [2]), (4, None), (5, [])], "k int, ids array<int>")
    got = {r.k: (r.documents, r.text) for r in tokens.marked(rows).collect()}
    assert got == {1: (3, "The river\n[EOS]\nran high."), 2: (1, "The river"), 3: (2, ""), 4: (None, None), 5: (1, "")}


def test_samples_of_short_streams(spark):
    size = lambda n, inclusive: spark.range(1).select(tokens.random_starts(F.lit(n), 10, 50, 1, inclusive).alias("s")).first().s
    assert set(size(12, False)) == {0} and set(size(12, True)) == {0, 1}
    for n, inclusive in ((11, False), (10, True)):
        with pytest.raises(Exception, match="too short"):
            size(n, inclusive)


def test_slices_and_blocks(spark):
    texts = [[5] * n for n in (0, 3, 1, 9, 2, 30, 0, 4)]
    flat = [t for ids in texts for t in [*ids, 2]]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(texts)], "pos int, ids array<int>").withColumn("ids", F.transform("ids", lambda t, i: t + i))
    packed = durable.cut(tokens.pack(df, "pos"))
    flat = [r.token for r in tokens.stream(packed).orderBy("pos").collect()]
    got = {r.block: (r.x, r.y) for r in tokens.blocks(packed, 4).collect()}
    assert got == {b: (flat[4 * b : 4 * b + 4], flat[4 * b + 1 : 4 * b + 5]) for b in range((len(flat) - 1) // 4)}
    starts = spark.range(len(flat) - 6).select(F.col("id").alias("start"))
    assert {r.start: r.x for r in tokens.slices(packed, starts, 6).collect()} == {s: flat[s : s + 6] for s in range(len(flat) - 6)}
    assert [r.token for r in tokens.head(packed, 11).orderBy("pos").collect()] == flat[:11]
    assert sorted(r.end for r in tokens.eos_places(packed).collect()) == [i for i, t in enumerate(flat) if t == 2]


def test_stream_stops_at_its_budget(spark, tmp_path):
    good = "The keeper of the old mill slept all day long while the river ran high and fast past the wheel. " * 8
    for i in range(6):
        spark.createDataFrame([(i, i, "c4", f"{i} {good}"), (100 + i, 100 + i, "c4", "bad")], "doc_id bigint, pos bigint, source string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("doc_id bigint, pos bigint, source string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    chunks, progress = incremental.budgeted_chunks(stream, len(good) * 2, str(tmp_path / "out"))
    rows = chunks.orderBy("start").collect()
    assert len(rows) == 2 and rows[0].start == 0 and rows[1].start == rows[0].n_chars
    assert progress.agg(F.sum("documents"), F.sum("passed"), F.sum("chunks")).first()[2] == 2


def test_no_folder_on_a_cluster():
    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Held)}))

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        durable.checkpoint_dir(Session)
