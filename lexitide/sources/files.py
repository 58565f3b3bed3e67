"""Readers and writers of word, caption, task and wordbook files; audio inventory; publishing of complete captions."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexitide.functions import text as X
from lexitide.operators.captions import split_bilingual
from lexitide.sources.tables import VersionedTable, _Folder, newest_commit

WORD_FILE = "array<struct<index: int, segment_id: int, start: double, end: double, text: string, probability: string, segment_end: boolean, segment_complete: boolean>>"
SEGMENT_FILE = "id int, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double, word_start int, word_end int"
TRANSCRIPT_FILE = "start double, end double, text string, translation string"
TASK_FILE = "id string, uri string, title string, status string, taskKind string, stage string, progress int, message string, connectionLabel string, subtitleCount int, bilingual boolean, failureCount int, createdAt long, updatedAt long, completedAt long, error string, audioHash string, uploadId string, uploadedBytes long, totalBytes long, uploadPrepared boolean, remoteJobId string, remoteUpdatedAt long, forceTranscribe boolean"
WORDBOOK_FILE = "time long, term string, phonetic string, sentence string, meaning string, definition string, englishText string, chineseText string, subtitleIndex int, startMs long, endMs long, videoUri string, videoId string"
JOB_FILE = "job_id string, audio_hash string, mode string, force boolean, status string, stage string, progress int, message string, error string, created_at double, updated_at double"
UPLOAD_FILE = "upload_id string, audio_hash string, total_bytes long, offset long, mime_type string, extension string, video_title string, complete boolean, created_at double, updated_at double"
# Task states; any other is read as queued.
STATES = ("queued", "running", "paused", "canceled", "done", "failed")
ALGORITHM = "least-cost-cut"
CHUNK_BYTES = 8 << 20
# The folders that one set of files, one a video, is dealt into, so that they are listed side by side.
FOLDERS = 64
ARTIFACT = re.compile(r"[A-Za-z0-9._-]+\.json")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of the session (where none is set, a temporary folder, but never on a cluster)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{uuid.uuid4()}"


def _key() -> Column:
    """A video's key: from a folder ``video_id=...`` if there is one, else from its file's name."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, "video_id=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1))


# The columns of a bundle, in which a row is a file of a video: its key and what is in it.
BUNDLE = "video_id string, value string"


def write_bundle(files: DataFrame, path: str) -> None:
    """Many files (``video_id, value``) as rows of few, compressed, for what would be a file and a folder a video.

    Where there are very many videos, a file each costs a listing, an open and a block each, however short it is. Texts end
    with a line end, as Spark's text files do.
    """
    files.select("video_id", F.concat("value", F.lit("\n")).alias("value")).write.option("compression", "zstd").parquet(path)


def _contents(spark: SparkSession, path: str, bundle: bool) -> DataFrame:
    """``video_id, value``: the texts of files, one a video, or of the rows of a bundle."""
    if bundle:
        return spark.read.schema(BUNDLE).parquet(path)
    return spark.read.text(path, wholetext=True).select(_key().alias("video_id"), "value")


def _ms(seconds: Column) -> Column:
    """Milliseconds, cut and not rounded; a microsecond guards against binary fractions."""
    return F.floor(seconds * 1000 + 1e-6).cast("long")


def read_words(spark: SparkSession, path: str, bundle: bool = False) -> DataFrame:
    """Words of JSON arrays, one file a video (``bundle``: as ``write_bundle`` has them); blank texts are dropped."""
    rows = _contents(spark, path, bundle).select("video_id", F.posexplode(F.from_json("value", WORD_FILE)).alias("pos", "w"))
    out = rows.select("video_id", F.coalesce("w.index", "pos").cast("long").alias("idx"), F.col("w.segment_id").cast("long").alias("segment_id"), _ms(F.col("w.start")).alias("start_ms"), _ms(F.col("w.end")).alias("end_ms"), X.stripped(F.col("w.text")).alias("text"), F.expr("try_cast(w.probability as double)").alias("probability"), F.coalesce("w.segment_end", F.lit(False)).alias("segment_end"), F.coalesce("w.segment_complete", F.lit(False)).alias("segment_complete"))
    return out.where("text <> ''")


def read_asr_segments(spark: SparkSession, path: str, bundle: bool = False) -> DataFrame:
    """Recognised segments of JSON arrays, one file a video (or a bundle), with their quality columns."""
    names = [c.split()[0] for c in SEGMENT_FILE.split(", ")]
    if bundle:
        kind = f"array<struct<{', '.join(c.replace(' ', ': ') for c in SEGMENT_FILE.split(', '))}>>"
        rows = _contents(spark, path, True).select("video_id", F.explode(F.from_json("value", kind)).alias("r")).select("video_id", "r.*")
    else:
        rows = spark.read.schema(SEGMENT_FILE).json(path, multiLine=True).select(_key().alias("video_id"), *names)
    return rows.withColumns({"start_ms": _ms(F.col("start")), "end_ms": _ms(F.col("end"))}).drop("start", "end").where(~X.is_blank(F.col("text")))


def read_transcripts(spark: SparkSession, path: str, bundle: bool = False) -> DataFrame:
    """Captions of JSON arrays: rows without times or text go, the rest is numbered from 1 in the order of the file."""
    rows = _contents(spark, path, bundle).select("video_id", F.posexplode(F.from_json("value", f"array<struct<{TRANSCRIPT_FILE.replace(' double', ': double').replace(' string', ': string')}>>")).alias("pos", "c"))
    kept = rows.where("c.start is not null and c.end is not null").where(~X.is_blank(F.col("c.text")))
    chinese = F.nullif(X.stripped(F.col("c.translation")), F.lit(""))
    return kept.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("pos")).cast("long").alias("idx"), _ms(F.col("c.start")).alias("start_ms"), _ms(F.col("c.end")).alias("end_ms"), X.stripped(F.col("c.text")).alias("english_text"), chinese.alias("chinese_text"), F.when(chinese.isNotNull(), "computer").alias("translation_source"))


def timestamp_ms(value: Column) -> Column:
    """``hh:mm:ss,mmm`` in ms; a part that is no number counts 0, other shapes are 0."""
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(".")), ":")
    as_long = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    seconds = F.split(F.get(parts, F.lit(2)), r"\.")
    fraction = as_long(F.left(F.rpad(F.coalesce(F.get(seconds, F.lit(1)), F.lit("")), 3, "0"), F.lit(3)))
    return F.when(F.size(parts) == 3, as_long(F.get(parts, F.lit(0))) * 3600000 + as_long(F.get(parts, F.lit(1))) * 60000 + as_long(F.get(seconds, F.lit(0))) * 1000 + fraction).otherwise(F.lit(0).cast("long"))


def read_srt(spark: SparkSession, path: str, bundle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Captions of SRT files, and the blocks without a valid timing line (``video_id``, ``block``)."""
    text = F.regexp_replace(F.regexp_replace("value", "^\\uFEFF", ""), "\r\n?", "\n")
    blocks = _contents(spark, path, bundle).select("video_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "block")).where("trim(regexp_replace(block, '\\\\s', '')) <> ''")
    lines = blocks.withColumn("l", F.split(F.regexp_replace("block", r"^\s*\n", ""), "\n"))
    timing = F.split(F.coalesce(F.get("l", F.lit(1)), F.lit("")), "-->")
    rows = lines.withColumn("t", timing).withColumn("lines", F.filter(F.slice("l", 3, 1_000_000), lambda t: F.trim(t) != "")).withColumn("good", (F.size("t") == 2) & (F.size("lines") > 0))
    kept = split_bilingual(rows.where("good"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    out = kept.select("video_id", F.coalesce(F.trim(F.get("l", F.lit(0))).try_cast("long"), place.cast("long")).alias("idx"), timestamp_ms(F.get("t", F.lit(0))).alias("start_ms"), timestamp_ms(F.get("t", F.lit(1))).alias("end_ms"), "english_text", "chinese_text")
    return out.withColumn("translation_source", F.when(F.col("chinese_text").isNotNull(), "imported")), rows.where("not good").select("video_id", "block")


def srt_content(captions: DataFrame, bilingual: bool = True) -> DataFrame:
    """One row a video: ``content`` of its SRT file, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("idx"))
    start = F.greatest(F.col("start_ms"), F.lit(0))
    lines = [n.cast("string"), F.concat(X.srt_time(start), F.lit(" --> "), X.srt_time(F.greatest(F.col("end_ms"), start + 1))), F.trim("english_text")]
    if bilingual:
        lines.append(F.nullif(X.stripped(F.col("chinese_text")), F.lit("")))
    rows = captions.select("video_id", n.alias("n"), F.concat(F.concat_ws("\n", *lines), F.lit("\n\n")).alias("block"))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x.block), "").alias("content"))


def safe_name(name: Column) -> Column:
    """A file name of the last part of an address: other characters than ``A-Za-z0-9._-`` become one underscore."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("video_subtitles"))


def write_srt(captions: DataFrame, path: str, bilingual: bool = True, bundle: bool = False) -> None:
    """An SRT file for each video, or a text in a row of a bundle."""
    files = srt_content(captions, bilingual).select(F.regexp_replace("content", "\n\n$", "\n").alias("value"), "video_id")
    if bundle:
        return write_bundle(files, path)
    write_files(files, path, "srt")


def _file_name(key: str | None, extension: str) -> str:
    """A file name of a key, escaped as Spark does for folders; no two keys share one, and none is hidden from Spark."""
    if not key:
        return f"{'%none' if key is None else '%empty'}.{extension}"
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{}\[\]^]|^[._]""", lambda m: f"%{ord(m[0]):02X}", key) + f".{extension}"


def write_files(files: DataFrame, path: str, extension: str) -> None:
    """A file for each row (``video_id, value``), one row a video, with a line end, in place of what was in the folder.

    Tasks write the files of their rows where they belong, under a hidden name until all is written, so a task that runs again
    replaces its own. Files share ``FOLDERS`` folders: Spark's own writer has a folder a video, and its driver moves each into
    place. Only where Python cannot open the address are they written so.
    """
    folder = _Folder(files.sparkSession, path)
    root = folder.fs.makeQualified(folder.root).toString()
    texts = files.select("video_id", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value"))
    try:
        system, place = _place(root)
    except (pa.ArrowInvalid, OSError):
        files.select("value", "video_id").write.partitionBy("video_id").mode("overwrite").text(path)
        return
    system.create_dir(place)
    system.delete_dir_contents(place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, place), made = _place(root), set()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                name = _file_name(key.as_py(), extension)
                at = f"{place}/bucket={zlib.crc32(name.encode()) % FOLDERS}"
                if at not in made:
                    system.create_dir(at)
                    made.add(at)
                hidden = f"{at}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as stream:
                    stream.write(text.as_buffer())
                system.move(hidden, f"{at}/{name}")
            yield batch.slice(0, 0).select(["video_id"])

    texts.mapInArrow(write, "video_id string").write.format("noop").mode("overwrite").save()


# The columns of a caption.
CAPTION = "video_id string, idx long, start_ms long, end_ms long, english_text string, chinese_text string, translation_source string"


def caption_table(spark: SparkSession, path: str, schema: T.StructType | str = CAPTION) -> VersionedTable:
    """Captions in buckets of videos, of which a commit replaces those videos that it has rows of."""
    return VersionedTable(spark, path, schema, "video_id", newest_commit("video_id"))


def save_captions(captions: DataFrame, path: str) -> None:
    """Replaces the captions of the videos that are given, all at once, and leaves those of others."""
    caption_table(captions.sparkSession, path, captions.schema).commit(captions)


def load_captions(spark: SparkSession, path: str, videos: list[str] | None = None) -> DataFrame:
    """Saved captions numbered from 1; the text ``null`` and blanks are no translation. ``videos`` reads only their buckets."""
    rows = caption_table(spark, path).read(videos)
    none = lambda c: F.when(~X.stripped(F.col(c)).isin("", "null"), F.col(c))
    return rows.withColumns({"idx": F.row_number().over(Window.partitionBy("video_id").orderBy("idx")).cast("long"), "chinese_text": none("chinese_text"), "translation_source": none("translation_source")})


def save_artifacts(tables: dict[str, DataFrame], path: str, dealt: bool = False) -> None:
    """Diagnostic tables by name (``words.json`` and the like); what a table has of an ``audio_hash`` replaces what there was.

    ``dealt``: rows of an ``audio_hash`` lie in one task already, as those of ``run_artifacts`` do if its words are dealt by video.
    """
    for name, df in tables.items():
        artifact_table(df.sparkSession, path, name, df.schema).commit(df, dealt=dealt)


def artifact_table(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> VersionedTable:
    if not ARTIFACT.fullmatch(name):
        raise ValueError(f"unsafe artifact name: {name}")
    return VersionedTable(spark, f"{path}/{name.removesuffix('.json')}", schema, "audio_hash", newest_commit("audio_hash"))


def run_artifacts(words: DataFrame, segments: DataFrame, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables that a run leaves: recognised words and segments, the captions of both cuts, and how the cut went.

    ``words`` and ``segments`` have ``video_id``, and ``scores`` what models say of boundaries. ``audio_hash`` is that of the video.
    """
    from lexitide.operators import segmentation as G

    named = lambda df: df.select(F.sha2("video_id", 256).alias("audio_hash"), "*")
    clean = G.normalize_words(words)
    legacy = G.greedy_captions(clean).withColumn("text", X.corrected(F.col("text")))
    # The cut is staged: two tables are made of it, and to make it moves its captions.
    staged, cut = scratch(words.sparkSession), G.segment_corpus(words, scores)
    cut.write.parquet(staged)
    cut = words.sparkSession.read.schema(cut.schema).parquet(staged)
    debug = cut.groupBy("video_id").agg(F.bool_or("used_fallback").alias("used_fallback"), F.max("error").alias("error"), F.count("*").alias("captions")).withColumn("algorithm", F.lit(ALGORITHM))
    # The names of the artifacts.
    return {
        "whisper_segments.json": named(segments),
        "whisper_words.json": named(words),
        "english.legacy.json": named(legacy),
        "english.semantic-preview.json": named(cut.where("not used_fallback").drop("used_fallback", "error")),
        "segmentation_debug.json": named(debug),
    }


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task records with defaults for what is missing, progress within 0 and 100, counts not below 0."""
    t = spark.read.schema(TASK_FILE).json(path)
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    string = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    time = lambda c: F.timestamp_millis(F.coalesce(c, F.lit(0)))
    return t.where("id is not null").select("id", string("uri").alias("uri"), string("title").alias("title"), F.when(F.lower("status").isin(*STATES), F.lower("status")).otherwise("queued").alias("status"), F.coalesce("taskKind", F.lit("generate")).alias("task_kind"), string("stage").alias("stage"), F.least(count("progress"), F.lit(100)).alias("progress"), string("message").alias("message"), string("connectionLabel").alias("connection_label"), count("subtitleCount").alias("subtitle_count"), flag("bilingual").alias("bilingual"), count("failureCount").alias("failure_count"), time("createdAt").alias("created_at"), time("updatedAt").alias("updated_at"), time("completedAt").alias("completed_at"), F.nullif(string("error"), F.lit("")).alias("error"), string("audioHash").alias("audio_hash"), string("uploadId").alias("upload_id"), count("uploadedBytes").alias("uploaded_bytes"), count("totalBytes").alias("total_bytes"), flag("uploadPrepared").alias("upload_prepared"), string("remoteJobId").alias("remote_job_id"), time("remoteUpdatedAt").alias("remote_updated_at"), flag("forceTranscribe").alias("force_transcribe"))


def _records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    kinds = T.StructType.fromDDL(schema).add("_broken", "string")
    parsed = F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parsed.alias("r")).select("file", "r.*")
    rows = rows.withColumns({c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long")) for c in ("created_at", "updated_at")})
    return rows.where("_broken is null").drop("_broken", "file"), rows.where("_broken is not null").select("file", F.col("_broken").alias("record"))


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Job records, and those that cannot be read (``file``, ``record``)."""
    return _records(spark, path, JOB_FILE)


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Upload records, and those that cannot be read."""
    return _records(spark, path, UPLOAD_FILE)


def read_wordbook(spark: SparkSession, path: str) -> DataFrame:
    """Wordbook entries; the English text falls back to the sentence's first line; blank terms go."""
    w = spark.read.schema(WORDBOOK_FILE).json(path).where(~X.is_blank(F.col("term")))
    english = F.coalesce(F.nullif(F.trim("englishText"), F.lit("")), F.get(F.split("sentence", "\n"), F.lit(0)), F.lit(""))
    return w.select(F.timestamp_millis("time").alias("time"), X.stripped(F.col("term")).alias("term"), "phonetic", "sentence", "meaning", "definition", english.alias("english_text"), F.col("chineseText").alias("chinese_text"), F.coalesce("subtitleIndex", F.lit(-1)).alias("subtitle_index"), F.col("startMs").alias("start_ms"), F.col("endMs").alias("end_ms"), F.col("videoUri").alias("video_uri"), F.coalesce(F.nullif("videoId", F.lit("")), F.sha2("videoUri", 256)).alias("video_id"))


def hash_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each distinct content of the files in a folder: hash, size, smallest path, extension and number of copies."""
    # Extensions kept as they are; others are bin.
    known = ("wav", "mp3", "m4a", "aac", "ogg", "flac", "mp4", "webm")
    files = _hashed(spark, path)
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy("audio_hash").agg(F.min("length").alias("total_bytes"), F.min("path").alias("path"), F.count("*").alias("copies"), F.min(F.when(end.isin(*known), end).otherwise("bin")).alias("extension"))


def _place(path: str) -> tuple[FileSystem, str]:
    """A file system for Python and the file's name there, of an address as Spark lists it."""
    if path.startswith("file:/"):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(quote(path, safe=":/@"))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path in batch.column(0).to_pylist():
            system, name = _place(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string())], names=["path", "length", "audio_hash"])


def _hashed(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, audio_hash`` of files of any size: Spark lists them, and tasks read them ``CHUNK_BYTES`` at a time.

    Where only Spark knows how to open the address, contents come as cells, which hold 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    if first is None:
        return files.select("path", "length", F.lit("").alias("audio_hash"))
    try:
        _place(first.path)
    except (pa.ArrowInvalid, OSError):
        return files.select("path", "length", F.sha2("content", 256).alias("audio_hash"))
    # Contents are not read here. Spark plans a task for every few files, however short they are.
    names = files.select("path", "length").coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(F.xxhash64("path")).mapInArrow(_hash_chunks, "path string, length long, audio_hash string")


def publish_captions(new: DataFrame, path: str) -> DataFrame:
    """Replace the captions of videos whose every row has a translation; others keep what they have.

    Returns ``video_id, n, missing, publishable`` of the new rows. They are staged first, so that the report and what is
    published are of the same rows; a write that fails leaves the old captions.
    """
    from lexitide.operators.captions import completeness

    spark = new.sparkSession
    staged = scratch(spark)
    new.write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    report = completeness(rows)
    save_captions(rows.join(report.where("publishable"), "video_id", "left_semi").select(new.columns), path)
    return report
