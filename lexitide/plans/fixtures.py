"""Caption, playback, wordbook and queue tables derived from the given tables, in Spark and, by the same rules, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import rules

# Terms that look-ups ask for in the derived wordbook.
TERMS = (
    "the of and to in is was running studies boxes stopped making cities tried cats dogs went better leaves hiking "
    "camping trail packed lighter gear tents mountain weather perfect really going something watches carried planning moved ties dies buses"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words of English documents: 350 ms apart, with a pause of 1.5 s after every 37th.

    Texts are dealt by video before they are split, so that what is done by video moves no words. The number of parts is
    given, as words are many times the texts by whose size parts would be put together.
    """
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.col("doc_id").cast("string").alias("video_id"), "text")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id").select("doc_id", "video_id", F.split(F.trim("text"), r"\s+").alias("t"))
    rows = docs.select("doc_id", "video_id", F.size("t").alias("n"), F.posexplode("t").alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))
    start = F.col("idx") * 350 + F.floor(F.col("idx") / 37) * 1500
    ends = (F.col("idx") % 25 == 24) | (F.col("idx") == F.col("n") - 1)
    return rows.select("video_id", "idx", F.floor(F.col("idx") / 25).alias("segment_id"), start.alias("start_ms"), (start + 280).alias("end_ms"), "text", (((F.col("doc_id") * 31 + F.col("idx") * 17) % 100) / 100).alias("probability"), ends.alias("segment_end"), (ends & F.col("text").rlike("[.!?]$")).alias("segment_complete"))


WORDS = """d0 AS (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS t FROM documents WHERE lang = 'en'),
w0 AS (SELECT doc_id, unnest(t) AS text, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS idx, len(t) AS n FROM d0),
words AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, idx, idx // 25 AS segment_id, idx * 350 + (idx // 37) * 1500 AS start_ms, idx * 350 + (idx // 37) * 1500 + 280 AS end_ms, text,
    CAST((doc_id * 31 + idx * 17) % 100 AS DOUBLE) / 100 AS probability, (idx % 25 = 24 OR idx = n - 1) AS segment_end, (idx % 25 = 24 OR idx = n - 1) AND regexp_matches(text, '[.!?]$') AS segment_complete FROM w0),
nw AS (SELECT video_id, idx, segment_id, start_ms, greatest(end_ms, start_ms + 10) AS end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, probability, segment_end, segment_complete FROM words WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
bf AS (SELECT *, start_ms - lag(end_ms) OVER v AS gap_ms, coalesce(regexp_extract(trim(lag(text) OVER v), '([,.!?;:])["'')\\]]*$', 1), '') AS punctuation FROM nw WINDOW v AS (PARTITION BY video_id ORDER BY idx)),
bd AS (SELECT *, coalesce(gap_ms >= 1200, false) AS forced_silence FROM bf),
bl AS (SELECT *, CAST(sum(CASE WHEN forced_silence OR punctuation IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY idx) AS BIGINT) AS block_id FROM bd)"""


def tidy_sql(text: str) -> str:
    """The spacing rules of caption text."""
    for pattern, put in (("\\s+([,.!?;:%])", "\\1"), ("\\s+-\\s*", "-"), ("(?i)\\s+([''’]s\\b)", "\\1"), ("(?i)\\s+n''t\\b", "n''t"), ("\\s+", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"trim({text})"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption for each turn, 5 s long every 6 s; every fifth lacks its translation."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") + 1).alias("idx"), (F.col("turn") * 6000).alias("start_ms"), (F.col("turn") * 6000 + 5000).alias("end_ms"), F.col("text").alias("english_text"), F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.concat(F.lit("译文 "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("chinese_text"), F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.lit("computer")).alias("translation_source"))


CAPTIONS = """captions AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn + 1 AS idx, turn * 6000 AS start_ms, turn * 6000 + 5000 AS end_ms, text AS english_text,
    CASE WHEN (conv_id + turn) % 5 <> 0 THEN '译文 ' || conv_id || '-' || turn END AS chinese_text, CASE WHEN (conv_id + turn) % 5 <> 0 THEN 'computer' END AS translation_source FROM conversations)"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shift of -2 to 2 times 50 ms for each video but every seventh."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 7 <> 0")
    return c.select(F.col("conv_id").cast("string").alias("video_id"), ((F.col("conv_id") % 5 - 2) * 50).alias("offset_ms"))


OFFSETS = "offsets AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS video_id, (conv_id % 5 - 2) * 50 AS offset_ms FROM conversations WHERE conv_id % 7 <> 0)"


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback positions from view events."""
    e = table(spark, sf_dir, "events").where("event_type = 'view' and value is not null")
    position = F.pmod(F.floor(F.col("value") * 1000).cast("long"), F.lit(48000))
    return e.select("event_id", F.col("user_id"), (F.col("user_id") % 100).cast("string").alias("video_id"), "ts", position.cast("long").alias("position_ms"))


PLAYBACK = "playback AS (SELECT event_id, user_id, CAST(user_id % 100 AS VARCHAR) AS video_id, ts, ((CAST(floor(value * 1000) AS BIGINT) % 48000) + 48000) % 48000 AS position_ms FROM events WHERE event_type = 'view' AND value IS NOT NULL)"


def wordbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups from click events."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    term = F.get(F.array(*map(F.lit, TERMS)), (F.col("event_id") % len(TERMS)).cast("int"))
    return e.select("event_id", "user_id", F.col("ts").alias("time"), F.when(F.col("event_id") % 3 == 0, F.initcap(term)).otherwise(term).alias("term"), (F.col("user_id") % 100).cast("string").alias("video_id"), (F.col("event_id") % 8).alias("subtitle_index"), ((F.col("event_id") % 8) * 6000 + (F.col("event_id") % 5) * 400).alias("start_ms"))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDBOOK = f"""wordbook AS (SELECT event_id, user_id, ts AS time, CASE WHEN event_id % 3 = 0 THEN upper(t[1]) || t[2:] ELSE t END AS term, CAST(user_id % 100 AS VARCHAR) AS video_id, event_id % 8 AS subtitle_index, (event_id % 8) * 6000 + (event_id % 5) * 400 AS start_ms
    FROM (SELECT *, {_list_sql(TERMS)}[CAST(event_id % {len(TERMS)} AS INTEGER) + 1] AS t FROM events WHERE event_type = 'click'))"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each distinct lower-case word of English documents; every fourth without a translation."""
    w = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    n = F.length("word")
    return w.select("word", F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), "word", F.lit("/"))).alias("phonetic"), F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("n. "), "word", F.lit(r"\n"), F.lit("v.  to "), "word")).alias("translation"), F.concat(F.lit("about "), "word").alias("definition"))


DICTIONARY = r"""dictionary AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN '' ELSE '/' || word || '/' END AS phonetic, CASE WHEN length(word) % 4 = 0 THEN '' ELSE 'n. ' || word || '\n' || 'v.  to ' || word END AS translation, 'about ' || word AS definition
    FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents WHERE lang = 'en') WHERE word <> '')"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from orders: status, upload and job flags by key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("queued", "running", "done", "failed", "paused"))), (k % 5).cast("int"))
    return o.select(F.col("o_custkey").alias("user_id"), k.alias("task_id"), status.alias("status"), (k % 2 == 0).alias("upload_prepared"), F.when(k % 3 == 0, F.concat(F.lit("j"), k.cast("string"))).otherwise(F.lit("")).alias("remote_job_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.timestamp_add("DAY", (k % 11).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("updated_at"), (k % 2 == 1).alias("force"), (k * 10).alias("uploaded_bytes"), F.col("o_orderpriority").alias("queue"))


TASKS = """tasks AS (SELECT o_custkey AS user_id, o_orderkey AS task_id, ['queued', 'running', 'done', 'failed', 'paused'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS status, o_orderkey % 2 = 0 AS upload_prepared,
    CASE WHEN o_orderkey % 3 = 0 THEN 'j' || o_orderkey ELSE '' END AS remote_job_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 11 AS INTEGER)) AS updated_at, o_orderkey % 2 = 1 AS force, o_orderkey * 10 AS uploaded_bytes, o_orderpriority AS queue FROM orders)"""


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events by user: signup queued, view progress, click running, error failure, purchase done."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "done")
    return e.withColumn("kind", kind).where("kind is not null").select("user_id", "event_id", "ts", "kind", F.when(F.col("kind") == "progress", F.pmod(F.col("event_id"), F.lit(101)).cast("long")).alias("progress"))


TASK_EVENTS = """task_events AS (SELECT user_id, event_id, ts, kind, CASE WHEN kind = 'progress' THEN event_id % 101 END AS progress FROM (
    SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'done' END AS kind FROM events) WHERE kind IS NOT NULL)"""


def quick_events(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    """Status events at so many times the speed, in whole milliseconds."""
    begin = 1_704_067_200_000
    ms = F.unix_millis("ts")
    return task_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ts", F.timestamp_millis(F.floor((ms - begin) / times) + begin))


def quick_sql(times: int) -> str:
    return f"{TASK_EVENTS}, quick AS (SELECT * REPLACE (make_timestamp(1000 * (1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // {times})) AS ts) FROM task_events)"


def glossary_sql(text: str) -> str:
    for pattern, new in rules.GLOSSARY:
        text = "regexp_replace({}, '{}', '{}', 'gi')".format(text, pattern.replace("'", "''"), new.replace("'", "''"))
    return text


def collapsed_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
