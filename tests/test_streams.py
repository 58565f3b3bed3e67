"""Ordered folds: golden rows, and a stream gives what the batch job gives."""

import pytest

from pyspark.sql import functions as F

from lexitide.sources import files as S
from lexitide.sources.tables import VersionedTable, all_rows, newest_commit, newest_fields, newest_rows
from lexitide.streaming import folds as Z

CHUNKS = "upload_id string, total_bytes long, start long, length long, seq long"


def upload(spark, rows):
    return [(r.verdict, r.offset, r.complete) for r in Z.fold_batch(spark.createDataFrame([("u", *r) for r in rows], CHUNKS), Z.UPLOADS).orderBy("seq").collect()]


def test_upload_resumes_and_rejects_wrong_offsets(spark):
    got = upload(spark, [(10, 0, 4, 1), (10, 5, 4, 2), (10, 4, 9, 3), (10, 4, 6, 4), (10, 10, 1, 5), (11, 0, 1, 6)])
    assert [v for v, _, _ in got] == ["accepted", "offset mismatch", "too long", "complete", "complete", "size conflict"]
    assert got[3][1:] == (10, True)


def events(spark, kinds):
    return spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}", k, None) for i, k in enumerate(kinds)], "user_id long, event_id long, ts string, kind string, progress long").selectExpr("user_id", "event_id", "cast(ts as timestamp) ts", "kind", "progress")


def test_tasks_retry_until_the_fifth_failure(spark):
    out = Z.fold_batch(events(spark, ["running", *["failure"] * 5, "queued", "paused", "running", "resumed", "done"]), Z.TASKS).orderBy("event_id").collect()
    assert [r.status for r in out] == ["running", "queued", "queued", "queued", "queued", "failed", "queued", "paused", "paused", "queued", "done"]
    assert out[-1].failures == 0 and out[-1].progress == 100


def test_words_become_captions(spark):
    rows = [("v", i, i * 300, i * 300 + 200, w) for i, w in enumerate("One two. Three four".split())]
    out = Z.fold_batch(spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string"), Z.CAPTIONS).collect()
    assert [r.text for r in out] == ["One two.", "Three four"]


def test_captions_of_dealt_words_move_nothing_more(spark):
    """The fold takes words where they are, and tidies a text only where it could be too long."""
    words = "it 's - a b , long-winded sentence".split() * 40
    rows = [("v", i, i * 100, i * 100 + 80, w) for i, w in enumerate(words)]
    dealt = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string").repartition(4, "video_id").withColumn("text", F.explode(F.array("text")))
    out = Z.fold_batch(dealt, Z.CAPTIONS)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    held, want = [], []
    for w in words:
        if held and (len(held) >= 30 or len(Z.tidied([*held, w])) > 160):
            want, held = [*want, Z.tidied(held)], []
        held.append(w)
    assert [r.text for r in out.orderBy("word_start").collect()] == [*want, Z.tidied(held)]


@pytest.mark.parametrize("name", ["str6_playback_state", "str6_stream_playback"])
def test_playback_events_of_one_time_and_number_are_no_matter_of_chance(spark, tmp_path, name):
    import duckdb

    from lexitide.plans import io_queries

    rows = [(e, f"2024-01-01 00:{e:02d}:00", u, "view", float(v)) for e in range(20) for u, v in ((107, 40 - e), (7, 1 + e), (207, 30))]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.expr("cast(ts as timestamp_ntz)"))
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.video_id, r.ts, r.position_ms) for r in io_queries.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(io_queries.ORACLE_SQL[name]).fetchall())
    assert [p for _, _, p in got] == [1000 * min(40 - e, 1 + e, 30) for e in range(20)]


@pytest.mark.parametrize("name", ["str6_playback_state", "str6_stream_playback"])
def test_playback_counts_milliseconds_as_its_sql(spark, tmp_path, name):
    """Times are whole microseconds: to the nearest millisecond, 2999.2 ms apart are 3000 and 3000.2 ms are 2999 or 3000."""
    import duckdb

    from lexitide.plans import io_queries

    times = [(7, 400), (7, 2_999_600), (8, 600), (8, 3_000_400), (9, 499), (9, 3_000_500), (10, 1500), (10, 3_001_499), (11, 0), (11, 2_999_500)]
    table = spark.createDataFrame([(e, us, u, "view", float(e)) for e, (u, us) in enumerate(times)], "event_id long, us long, user_id long, event_type string, value double")
    table = table.select("event_id", F.timestamp_micros(F.col("us") + 1_704_067_200_000_000).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.video_id, r.ts, r.position_ms) for r in io_queries.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(io_queries.ORACLE_SQL[name]).fetchall())
    assert sorted(p // 1000 for v, _, p in got if v in "7 8 11".split()) == [0, 1, 2, 8, 9]


def test_uploads_of_more_files_in_the_second_part_lose_no_row(spark, tmp_path):
    """Chunks that come again are rows of tasks of their own; here all of them are of the second half of the time."""
    from lexitide.plans import io_queries

    spark.createDataFrame([(k, "x", 60_000 + k) for k in range(5)], "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    batch, stream = (sorted(map(tuple, io_queries.QUERIES[name](spark, str(tmp_path)).collect())) for name in ("str1_track_uploads", "str1_stream_uploads"))
    assert "offset mismatch" in {r[2] for r in batch} and stream == batch


@pytest.mark.parametrize("fold", [Z.TASKS, Z.CHANGES, Z.PROGRESS], ids=["tasks", "changes", "progress"])
def test_stream_equals_batch(spark, tmp_path, fold):
    kinds = (["running", "progress", "failure", "done", "queued"] * 5)[:23]
    table = events(spark, kinds)
    table.where("event_id < 12").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    table.where("event_id >= 12").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = Z.fold_stream(stream, fold).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, Z.fold_batch(table, fold).collect()))


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_videos_are_published_whole_over_micro_batches(spark, tmp_path):
    """Rows of a video come in two batches; with a declared number nothing is published before all are there."""
    rows = [("a", i, 100 * i, 100 * i + 50, f"e{i}", f"c{i}", None, 4) for i in range(4)] + [("b", 0, 0, 50, "e", None, None, 1)]
    table = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, english_text string, chinese_text string, translation_source string, total long")
    table.where("idx < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    out, seen = str(tmp_path / "out"), []
    for _ in range(2):
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        with Z.rocks(spark, ("spark.sql.streaming.noDataMicroBatches.enabled", "false")):
            query = Z.stream_publish(stream, out, str(tmp_path / "ckpt"), total="total").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        seen.append(sorted((r.video_id, r.idx) for r in S.load_captions(spark, out).collect()))
        table.where("idx >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert seen == [[], [("a", i + 1) for i in range(4)]]  # numbered from 1


def test_idle_keys_are_flushed(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("v", i, i * 300, i * 300 + 200, w) for i, w in enumerate("One two. Three four".split())] + [("w", 0, 10**7, 10**7 + 100, "Later.")]
    table = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string").withColumn("ts", F.timestamp_millis(F.col("start_ms") + 10**6))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set(*ROCKS)
    try:
        stream = Z.fold_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), Z.CAPTIONS, ts="ts", late="1 minute", idle_ms=60_000)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.unset(ROCKS[0])
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["One two.", "Three four"]  # w is not idle yet


def test_null_keys_are_one_key(spark):
    table = spark.createDataFrame([(None, i, f"2024-01-01 00:00:{i:02d}", "failure", None) for i in range(2)], "user_id long, event_id long, ts string, kind string, progress long").selectExpr("user_id", "event_id", "cast(ts as timestamp) ts", "kind", "progress")
    assert sorted((r.event_id, r.failures) for r in Z.fold_batch(table, Z.TASKS).collect()) == [(0, 1), (1, 2)]


def started(spark, rows, fold, path, late, idle_ms):
    """One run of the stream over what the folder holds now."""
    with Z.rocks(spark):
        stream = spark.readStream.schema(rows.schema).parquet(str(path / "in"))
        query = Z.stream_fold(stream, fold, str(path / "out"), str(path / "ckpt"), late=late, idle_ms=idle_ms).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return VersionedTable(spark, str(path / "out"), fold.output, fold.key)


def at(spark, rows, ddl="user_id long, event_id long, s double, kind string, progress long"):
    return spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long") + 1_700_000_000_000)).drop("s")


def told(rows, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in rows)


def test_an_idle_key_gives_heartbeats_and_leaves_no_state(spark, tmp_path):
    events = at(spark, [(1, 1, 0.0, "running", None), (1, 2, 30.0, "running", None), (2, 3, 10.0, "done", None), (2, 4, 400.0, "done", None)])
    batch = Z.fold_batch(events, Z.STATUS_LOG, "ts", 150_000).collect()
    assert sum(r.heartbeat for r in batch if r.user_id == 1) == 2  # of the 150 s after its last event
    names = ("user_id", "ts", "event_id", "kind", "heartbeat")
    events.where("event_id <> 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    started(spark, events, Z.STATUS_LOG, tmp_path, "5 seconds", 150_000)
    end = at(spark, [(2, 4, 400.0, "done", None), (9, 9, 9000.0, "end", None)])
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = started(spark, events, Z.STATUS_LOG, tmp_path, "5 seconds", 150_000)
    assert told(table.read().collect(), *names) == told(batch, *names)
    for state in ("state", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", state).load(str(tmp_path / "ckpt"))
        assert {r.key.user_id for r in left.collect()} == {9}
    # A batch that is run again adds nothing, and one without new rows neither.
    assert told(started(spark, events, Z.STATUS_LOG, tmp_path, "5 seconds", 150_000).read().collect(), *names) == told(batch, *names)


@pytest.mark.parametrize("fold", [Z.TASKS, Z.STATUS_LOG], ids=["tasks", "log"])
def test_keys_of_a_group_share_an_entry_of_the_store(spark, tmp_path, fold):
    """300 keys (one of them null) in 4 groups over three runs: the rows of the batch job, and 4 timers and entries at most."""
    kinds = ["running", "progress", "failure", "done"]
    events = at(spark, [(k or None, 300 * i + k, 40.0 * i + k / 10, kinds[(k + i) % 4], (k + i) % 4 == 1 and i or None) for k in range(300) for i in range(6)])
    end = at(spark, [(9999, 9999, 9.0e6, "end", None)])
    for part in (events.where("event_id < 1000"), events.where("event_id >= 1000"), end):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with Z.rocks(spark):
            stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
            assert Z.stream_fold(stream, fold, str(tmp_path / "out"), str(tmp_path / "ckpt"), late="10 seconds", idle_ms=150_000, groups=4).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "ckpt")).count() <= 4
    assert spark.read.format("statestore").option("stateVarName", "keys").load(str(tmp_path / "ckpt")).count() == 0
    got = VersionedTable(spark, str(tmp_path / "out"), fold.output, fold.key).read()
    names = got.columns
    assert told(got.collect(), *names) == told(Z.fold_batch(events, fold, "ts", 150_000).collect(), *names)


def test_late_rows_are_counted_apart(spark, tmp_path):
    first = at(spark, [(1, 1, 0.0, "running", None), (1, 2, 500.0, "done", None)])
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    started(spark, first, Z.TASKS, tmp_path, "60 seconds", 10**9)
    at(spark, [(1, 3, 100.0, "failure", None), (1, 4, 450.0, "failure", None), (1, 5, 100.0, "failure", None), (9, 9, 10.0**7, "end", None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = started(spark, first, Z.TASKS, tmp_path, "60 seconds", 10**9).read().orderBy("event_id").collect()
    assert [(r.event_id, r.status) for r in got] == [(1, "running"), (4, "queued"), (2, "done")] or [r.event_id for r in got] == [1, 2, 4]
    assert {r.event_id: (r.status, r.failures) for r in got} == {1: ("running", 0), 4: ("queued", 1), 2: ("done", 0)}  # 4 came before 2 in event time
    late = VersionedTable(spark, str(tmp_path / "out_late"), "user_id long, late timestamp, n long", "user_id").read().collect()
    assert [(r.user_id, r.n) for r in late] == [(1, 2)]


def test_captions_over_five_batches(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = "One two , three . Four it 's five six do n't stop ! seven eight nine ten".split() * 12
    rows = [(v, i, 600 * i, 600 * i + 500, w) for v in ("a", "b") for i, w in enumerate(words)]
    table = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string").withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1_700_000_000_000))
    want = Z.fold_batch(table, Z.CAPTIONS).collect()
    assert "Four it's five six don't stop!" in {r.text for r in want}
    parts = [[] for _ in range(5)]
    for r in table.collect():
        parts[min(4, int((r.start_ms / 1000 + rng.uniform(0, 20)) / 30))].append(r)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 4:
            spark.createDataFrame([("z", 0, 0, 1, "end")], "video_id string, idx long, start_ms long, end_ms long, text string").withColumn("ts", F.timestamp_millis(F.lit(1_700_100_000_000))).write.mode("append").parquet(str(tmp_path / "in"))
        got = started(spark, table, Z.CAPTIONS, tmp_path, "30 seconds", 60_000)
    last = VersionedTable(spark, str(tmp_path / "out"), Z.CAPTIONS.output, "video_id").read().collect()
    assert told(last, "video_id", "word_start", "word_end", "text") == told(want, "video_id", "word_start", "word_end", "text")
    assert VersionedTable(spark, str(tmp_path / "out_late"), "video_id string, late timestamp, n long", "video_id").read().count() == 0
    assert got.manifest()["batches"]["fold"] >= 5


def test_progress_that_was_held_back_goes_out_later(spark):
    rows = [(1, 1, 0.0, "progress", 1), (1, 2, 0.1, "progress", 2), (1, 3, 0.2, "progress", 3), (1, 4, 2.0, "progress", 3), (1, 5, 2.1, "progress", 3), (1, 6, 2.2, "done", None), (1, 7, 2.25, "progress", 9)]
    out = Z.fold_batch(at(spark, rows), Z.TRAILING, "ts", 10_000).orderBy("ts").collect()
    assert [(r.event_id, r.percent, r.trailing, r.ts.timestamp() - 1_700_000_000) for r in out] == [(1, 1, False, 0.0), (3, 3, True, pytest.approx(0.3)), (4, 3, False, pytest.approx(2.0)), (6, 3, False, pytest.approx(2.2)), (7, 9, False, pytest.approx(2.25))]


def test_retries(spark):
    kinds = ["running", "progress", "failure", "failure", "failure", "failure", "failure", "done", "failure"]
    out = Z.fold_batch(at(spark, [(1, i, float(i), k, 100 if k == "progress" else None) for i, k in enumerate(kinds)]), Z.RETRIES).orderBy("event_id").collect()
    assert [(r.status, r.failures, r.progress) for r in out] == [("running", 0, 0), ("progress", 0, 100), *[("queued", n, 99) for n in (1, 2, 3, 4)], ("failed", 5, 99), ("done", 0, 100), ("queued", 1, 99)]


# ---- versioned tables


def test_a_commit_replaces_its_keys_and_few_folders_hold_many_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, "video_id string, idx long, v string", "video_id", newest_commit("video_id"), buckets=4)
    assert table.read().count() == 0
    many = spark.range(20_000).selectExpr("cast(id div 2 as string) video_id", "id % 2 idx", "'old' v")
    table.commit(many)
    assert len(list((tmp_path / "t").glob("data/*/_bucket=*"))) == 4
    for k in range(3):
        table.commit(spark.createDataFrame([(str(k), 0, f"new{k}"), ("x", k, "x")], "video_id string, idx long, v string"))
    assert len(table.manifest()["parts"]) == 2  # small parts are merged, the large one isn't
    assert table.read().count() == 20_000 - 3 + 1
    assert sorted(map(tuple, table.read(["1", "x", "7"]).collect())) == [("1", 0, "new1"), ("7", 0, "old"), ("7", 1, "old"), ("x", 2, "x")]
    plan = table.read(["1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan


def test_rows_that_are_dealt_are_written_where_they_are(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v long", "k", newest_commit("k"), buckets=2)
    rows = spark.range(900).selectExpr("cast(id % 90 as string) k", "id v").repartition(3, "k")
    for k in range(2):
        table.commit(rows.withColumn("v", F.col("v") + k), dealt=True)
    assert sorted(map(tuple, table.read().collect())) == sorted((str(i % 90), i + 1) for i in range(900))
    plain = VersionedTable(spark, str(tmp_path / "p"), "k string, v long", "k", newest_commit("k"), buckets=2)
    for t, folder in ((table, "d"), (plain, "e")):
        VersionedTable(spark, str(tmp_path / folder), "k string, v long", "k", newest_commit("k"), buckets=2).commit(rows, dealt=t is table)
    count = lambda folder: len(list((tmp_path / folder).glob("data/*/_bucket=*/part-*")))
    assert count("d") == 6 and count("e") == 2


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k", newest_commit("k"))
    table.commit(spark.createDataFrame([("a", 1)], "k string, v int"))
    with pytest.raises(Exception, match="(?i)divi"):
        table.commit(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int").selectExpr("k", "v div (v - 3) as v"))
    assert list(map(tuple, table.read().collect())) == [("a", 1)] and table.manifest()["version"] == 1
    table.commit(spark.createDataFrame([("c", 1)], "k string, v int"))
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("c", 1)]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # what the failed writer left is gone; the last version's parts are kept
    assert list(map(tuple, table.read(version=1).collect())) == [("a", 1)]
    with pytest.raises(FileExistsError):
        table.folder.put(f"_manifests/{table._name(2)}", "{}")


def test_a_micro_batch_counts_once_and_history_is_bounded(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "user_id long, time long", "user_id", newest_rows("user_id", [F.desc("time")], 10))
    for k in range(8):
        rows = spark.range(100).selectExpr("id % 2 user_id", f"id + {k * 100} time")
        assert table.commit(rows, ("s", k)) == table.commit(rows, ("s", k)) == k + 1
    assert table.read().count() == 20 and table.read().selectExpr("min(time)").first()[0] == 780
    assert sum(p["rows"] for p in table.manifest()["parts"]) <= 120
    plain = VersionedTable(spark, str(tmp_path / "p"), "user_id long, time long", "user_id", all_rows)
    for k in range(3):
        plain.commit(spark.range(5).selectExpr("id user_id", f"id + {k} time"), ("s", k))
    assert plain.read().count() == 15


def test_fields_are_merged_by_their_stamps(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k long, a string, a_at long, b long, b_at long", "k", newest_fields("k", {"a": "a_at", "b": "b_at"}))
    for rows in ([(1, "new", 9, None, None)], [(1, "old", 3, 5, 4), (None, "n", 1, None, None)], [(1, None, None, 6, 2)]):
        table.commit(spark.createDataFrame(rows, table.schema))
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, "new", 9, 5, 4), (None, "n", 1, None, None)]
