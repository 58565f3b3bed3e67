"""Sources and sinks: files of any size, names with spaces, artifacts, captions by bucket."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexitide.operators import segmentation as G
from lexitide.plans import fixtures as X
from lexitide.sources import files as S

SF = "/root/testdata/sf0.001"


def test_files_of_any_size_are_hashed_in_chunks(spark, tmp_path):
    """One file is above the size of a cell; it is sparse, so it takes no disk."""
    with open(tmp_path / "large one.mp4", "wb") as f:
        f.write(b"begin")
        f.truncate(2**31 + 12345)
    for name in ("a.wav", "b é%20c.WAV"):
        (tmp_path / name).write_bytes(b"same bytes")
    (tmp_path / "empty.xyz").write_bytes(b"")
    want = hashlib.sha256(b"begin")
    left = 2**31 + 12345 - 5
    while left:
        n = min(left, 1 << 24)
        want.update(bytes(n))
        left -= n
    out = {r.audio_hash: r for r in S.hash_inventory(spark, str(tmp_path)).collect()}
    same = out[hashlib.sha256(b"same bytes").hexdigest()]
    assert len(out) == 2 and (same.copies, same.total_bytes, same.extension) == (2, 10, "wav")
    assert (out[want.hexdigest()].total_bytes, out[want.hexdigest()].extension) == (2**31 + 12345, "mp4")
    # Spark passes over empty files, which are no audio.


def test_an_empty_folder_and_an_address_that_only_spark_opens(spark, tmp_path, monkeypatch):
    os.mkdir(tmp_path / "none")
    assert S.hash_inventory(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "x.mp3").write_bytes(b"x")

    def unknown(path):
        raise OSError("no such scheme")

    monkeypatch.setattr(S, "_place", unknown)
    assert [(r.audio_hash, r.extension) for r in S.hash_inventory(spark, str(tmp_path / "x.mp3")).collect()] == [(hashlib.sha256(b"x").hexdigest(), "mp3")]


def test_artifacts_of_a_run(spark, tmp_path):
    words = X.words(spark, SF).where("cast(video_id as int) < 20")
    segments = G.materialize_segments(words, "segment_id").select("video_id", F.col("segment_id").alias("id"), "text")
    tables = S.run_artifacts(words, segments)
    assert sorted(tables) == ["english.legacy.json", "english.semantic-preview.json", "segmentation_debug.json", "whisper_segments.json", "whisper_words.json"]
    S.save_artifacts(tables, str(tmp_path))
    read = {n: S.artifact_table(spark, str(tmp_path), n, df.schema).read() for n, df in tables.items()}
    assert read["whisper_words.json"].count() == words.count() and read["whisper_segments.json"].count() == segments.count()
    debug = {r.video_id: r for r in read["segmentation_debug.json"].collect()}
    preview = {r.video_id: r.n for r in read["english.semantic-preview.json"].groupBy("video_id").agg(F.count("*").alias("n")).collect()}
    assert preview == {v: r.captions for v, r in debug.items() if not r.used_fallback}
    assert all((r.error is not None) == r.used_fallback and r.audio_hash == hashlib.sha256(v.encode()).hexdigest() for v, r in debug.items())
    ends = read["english.legacy.json"].groupBy("video_id").agg(F.max("word_end").alias("n")).collect()
    assert {r.video_id: r.n for r in ends} == {r.video_id: r.n for r in G.normalize_words(words).groupBy("video_id").agg((F.max("idx") + 1).alias("n")).collect()}
    # A run that is saved again replaces the rows of its hash, and those of others stay.
    S.save_artifacts({"whisper_words.json": tables["whisper_words.json"].where("video_id = '2' and idx < 3")}, str(tmp_path))
    again = S.artifact_table(spark, str(tmp_path), "whisper_words.json", tables["whisper_words.json"].schema).read()
    assert again.where("video_id = '2'").count() in (0, 3) and again.where("video_id <> '2'").count() == words.where("video_id <> '2'").count()
    with pytest.raises(ValueError, match="unsafe"):
        S.save_artifacts({"../x.json": segments}, str(tmp_path))


def test_captions_of_some_videos(spark, tmp_path):
    rows = X.captions(spark, SF)
    S.save_captions(rows, str(tmp_path))
    some = [r.video_id for r in rows.select("video_id").distinct().orderBy("video_id").limit(2).collect()]
    assert S.load_captions(spark, str(tmp_path), some).count() == rows.where(F.col("video_id").isin(some)).count()
    assert S.load_captions(spark, str(tmp_path)).count() == rows.count()


def test_bundles_hold_what_files_hold(spark, tmp_path):
    """A row of a bundle is read as the file of a video is."""
    from pyspark.sql import functions as F

    word = '[{"index": 0, "segment_id": 2, "start": 0.1, "end": 0.29, "text": " a ", "probability": "odd"}, {"start": 1, "end": 2, "text": " "}, {"start": 1.5, "end": 2, "text": "b", "segment_end": true}]'
    segment = '[{"id": 3, "start": 0.1, "end": 0.29, "text": "a b", "avg_logprob": -0.5}, {"id": 4, "start": 1, "end": 2, "text": " "}]'
    caption = '[{"start": 1, "text": "x"}, {"start": 0.5, "end": 2, "text": "y", "translation": "z"}]'
    srt = "1\n00:00:00,100 --> 00:00:01,000\nhello\n你好\n\n2\nno time\nlost\n"
    empty = "[]"
    for k, (read, text) in enumerate([(S.read_words, word), (S.read_asr_segments, segment), (S.read_transcripts, caption), (lambda *a, **b: S.read_srt(*a, **b)[0], srt), (lambda *a, **b: S.read_srt(*a, **b)[1], srt)]):
        files = spark.createDataFrame([("v1", text), ("v2", text), ("v3", empty)], S.BUNDLE)
        files.coalesce(1).write.partitionBy("video_id").text(f"{tmp_path}/files{k}")
        S.write_bundle(files, f"{tmp_path}/bundle{k}")
        one, two = (df.select([F.col(c) for c in sorted(df.columns)]) for df in (read(spark, f"{tmp_path}/files{k}"), read(spark, f"{tmp_path}/bundle{k}", bundle=True)))
        assert one.schema.simpleString() == two.schema.simpleString()
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() >= 2


def test_queries_over_files_do_not_write_one_a_video(spark, tmp_path, monkeypatch):
    from lexitide.plans import io_queries

    monkeypatch.setattr(S, "scratch", lambda s: f"{tmp_path}/out")
    assert io_queries.src1_read_words(spark, "/root/testdata/sf0.001").count() > 0
    assert not list((tmp_path / "out").glob("video_id=*"))


def test_a_file_a_video_has_no_folder_of_its_own(spark, tmp_path, monkeypatch):
    """The same files come of the writer for addresses that only Spark opens, which has a folder a video."""
    rows = spark.range(300).selectExpr("cast(id as string) as video_id", "1L as idx", "0L as start_ms", "5L as end_ms", "concat('text ', id % 200) as english_text", "cast(null as string) as chinese_text")
    hashes = lambda path: sorted(map(tuple, S.hash_inventory(spark, path).drop("path").collect()))
    path = f"{tmp_path}/copy=1"
    S.write_srt(rows.where("video_id = '7'").withColumn("english_text", F.lit("replaced")), path)
    S.write_srt(rows, path)
    assert len(os.listdir(path)) <= 64 and sum(len(files) for _, _, files in os.walk(path)) == 300
    want = b"1\n00:00:00,000 --> 00:00:00,005\ntext 7\n\n"
    assert (hashlib.sha256(want).hexdigest(), len(want), 2, "bin") in hashes(str(tmp_path)) and len(hashes(str(tmp_path))) == 200
    assert S.read_srt(spark, path)[0].select("video_id").distinct().count() == 300

    def unknown(path):
        raise OSError("no such scheme")

    new = hashes(path)
    monkeypatch.setattr(S, "_place", unknown)
    S.write_srt(rows.where("video_id < '2'"), f"{tmp_path}/other")
    some = hashes(f"{tmp_path}/other")
    assert len(os.listdir(f"{tmp_path}/other")) > 64 and {r[0] for r in some} <= {r[0] for r in new}


def test_files_of_odd_keys_are_all_seen(spark, tmp_path):
    """Names that Spark would hide, that name folders, or that are none."""
    keys = [None, "", "a/b", "../up", "_hidden", ".dot", "%2E", "%none", "%empty", "a b é", "x.srt", "\u5f71" * 70, "_", "=?*[1]:\\\n"]
    files = spark.createDataFrame([(k, f"text {n}") for n, k in enumerate(keys)] + [("void", None)], S.BUNDLE)
    S.write_files(files, f"{tmp_path}/in/side", "srt")
    got = sorted(r.value for r in spark.read.text(f"{tmp_path}/in/side", wholetext=True).collect())
    assert got == sorted(["\n", *(f"text {n}\n" for n in range(len(keys)))]) and os.listdir(tmp_path) == ["in"]
    assert S.hash_inventory(spark, f"{tmp_path}/in").count() == len(keys) + 1
    S.write_files(files.where("false"), f"{tmp_path}/in/side", "srt")
    assert os.listdir(f"{tmp_path}/in/side") == []


def test_inventory_query_makes_no_folder_a_video(spark, tmp_path, monkeypatch):
    from lexitide.plans import io_queries

    monkeypatch.setattr(S, "scratch", lambda s: f"{tmp_path}/out")
    rows = io_queries.src12_hash_inventory(spark, SF).collect()
    videos = X.captions(spark, SF).select("video_id").distinct().count()
    assert sum(r.copies for r in rows) == videos + videos // 2 == sum(len(files) for _, _, files in os.walk(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("copy=*/video_id=*"))
