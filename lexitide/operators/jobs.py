"""Upload, job, task, wordbook and playback tables: queues, boards, upserts, status folds, progress texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitide.functions import text as X

ZONE = "Asia/Shanghai"


def task_board(tasks: DataFrame, which: str = "active") -> DataFrame:
    """``active``: queued, running, paused and failed tasks, newest update first; ``done``: newest completion first."""
    if which == "done":
        return tasks.where("status = 'done'").orderBy(F.desc("updated_at"), "task_id")
    return tasks.where(F.col("status").isin("queued", "running", "paused", "failed")).orderBy(F.desc("updated_at"), "task_id")


def _tier() -> Column:
    no_job = F.trim("remote_job_id") == ""
    return F.when(no_job & ~F.col("upload_prepared"), 1).when(no_job, 2).otherwise(3)


def next_task(tasks: DataFrame, recover: bool = False) -> DataFrame:
    """Per user the oldest queued task by tier: neither uploaded nor submitted, uploaded, submitted. ``recover``: a running one first."""
    tier = F.when(F.col("status") == "running", 0).otherwise(_tier()) if recover else _tier()
    rows = tasks.where(F.col("status").isin(["queued", "running"] if recover else ["queued"]))
    return rows.groupBy("user_id").agg(F.min_by(F.struct("task_id", "status"), F.struct(tier, "created_at", "task_id")).alias("t")).select("user_id", "t.*")


def recoverable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running")).orderBy("created_at", "task_id")


def has_pending_upload(tasks: DataFrame) -> DataFrame:
    """For each task, whether another of its user is queued and not submitted."""
    own = (F.col("status") == "queued") & (F.trim("remote_job_id") == "")
    n = tasks.groupBy("user_id").agg(F.count_if(own).alias("n"))
    return tasks.join(n, "user_id").select("user_id", "task_id", (F.col("n") - F.when(own, 1).otherwise(0) > 0).alias("pending"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Position in each queue: 0 for running, 1 and up for queued jobs in order of arrival.

    Positions are counted by day first, so that a queue with a third of all jobs is not ordered in one task.
    """
    waiting = jobs.where("status = 'queued'").withColumn("day", F.to_date("created_at"))
    days = waiting.groupBy("queue", "day").count()
    before = Window.partitionBy("queue").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select("queue", "day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("queue", "day").orderBy("created_at", "task_id"))
    placed = waiting.withColumn("place", place).join(base, ["queue", "day"]).select("queue", "task_id", (F.col("before") + F.col("place")).alias("position"))
    return placed.unionByName(jobs.where("status = 'running'").select("queue", "task_id", F.lit(0).cast("long").alias("position")))


def plan_jobs(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``reused``: an unforced ``generate`` request whose hash has cached captions is finished at once.

    ``requests``: ``audio_hash, mode, force``; ``cache``: ``audio_hash, caption_count``.
    """
    known = requests.join(cache.where("caption_count > 0").select("audio_hash", "caption_count").distinct(), "audio_hash", "left")
    return known.withColumn("reused", (F.col("mode") == "generate") & ~F.col("force") & F.col("caption_count").isNotNull()).drop("caption_count")


def dedupe_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds ``active_job``: the earliest queued or running job for the same hash and mode."""
    active = jobs.where(F.col("status").isin("queued", "running")).groupBy("audio_hash", "mode").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("active_job"))
    return requests.join(active, ["audio_hash", "mode"], "left")


def upsert_tasks(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests put into the task table by id: creation time and upload stay, progress starts anew.

    ``requests``: ``task_id, requested_at, force``: null force means the earlier flag, or true for a finished task. Of
    several requests for an id the latest counts.
    """
    latest = requests.groupBy("task_id").agg(F.max_by(F.struct("requested_at", F.col("force").alias("asked")), "requested_at").alias("r")).select("task_id", "r.*")
    rows = tasks.join(latest, "task_id", "full_outer")
    hit = F.col("requested_at").isNotNull()
    return rows.select(
        "task_id",
        F.when(hit, "queued").otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", "requested_at").alias("created_at"),
        F.when(hit, F.col("requested_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("uploaded_bytes", F.lit(0)).cast("long").alias("uploaded_bytes"),
        F.when(hit, F.coalesce("asked", F.coalesce("force", F.lit(False)) | F.coalesce(F.col("status") == "done", F.lit(False)))).otherwise(F.col("force")).alias("force"),
        F.when(hit, "").otherwise(F.col("remote_job_id")).alias("remote_job_id"),
    )


def delete_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("task_id").distinct(), "task_id", "left_anti")


def delete_task_captions(captions: DataFrame, tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """The cascade of a deletion: captions without those of the deleted tasks' videos, whether or not others share a video.

    ``tasks``: ``task_id, video_id``, as they were before the deletion.
    """
    gone = tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi").select("video_id").distinct()
    return captions.join(gone, "video_id", "left_anti")


def merge_updates(jobs: DataFrame, updates: DataFrame, key: str = "task_id") -> DataFrame:
    """Only non-null fields overwrite, so a null error never clears an earlier one."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return jobs.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in jobs.columns])


def job_state(events: DataFrame) -> DataFrame:
    """The latest non-null ``kind`` and ``progress`` of each user's events: the batch form of the status fold."""
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("kind", order).alias("status"), F.max_by(F.col("progress"), F.when(F.col("progress").isNotNull(), order)).alias("progress"), F.max("ts").alias("updated_at"))


def retry_state(events: DataFrame, most: int = 5) -> DataFrame:
    """Failures since the last success; queued again below ``most``, failed from there. The fold ``RETRIES`` has the progress, too."""
    order = F.struct("ts", "event_id")
    done = events.groupBy("user_id").agg(F.max(F.when(F.col("kind") == "done", order)).alias("d"))
    rows = events.join(done, "user_id")
    late = F.col("d").isNull() | (order > F.col("d"))
    out = rows.groupBy("user_id").agg(F.count_if(late & (F.col("kind") == "failure")).alias("failures"), F.max_by("kind", order).alias("last_kind"))
    return out.withColumn("status", F.when(F.col("last_kind") == "failure", F.when(F.col("failures") < most, "queued").otherwise("failed")).otherwise(F.col("last_kind"))).drop("last_kind")


def status_changes(events: DataFrame) -> DataFrame:
    """Events at which a user's status differs from the one before."""
    before = F.lag("kind").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where("before is null or before <> kind").drop("before", "progress")


def parse_progress(events: DataFrame, column: str = "message") -> DataFrame:
    """Adds ``percent`` (``NN%``, else ``a/b``; translation from 92 to 99), ``stage`` and ``connection`` of a message."""
    m = F.col(column)
    one, a, b = (F.expr(f"try_cast(nullif(regexp_extract({column}, '{p}', {k}), '') as bigint)") for p, k in ((r"(\\d{1,3})%", 1), (r"(\\d+)\\s*/\\s*(\\d+)", 1), (r"(\\d+)\\s*/\\s*(\\d+)", 2)))
    clamp = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    translating = m.contains("翻译") | F.lower(m).contains("translat")
    ratio = F.when(translating, clamp(92 + F.floor(a * 7 / b), 92, 99)).otherwise(clamp(F.floor(a * 100 / b), 0, 100))
    label = lambda pairs, none: F.coalesce(*[F.when(m.contains(k), F.lit(v)) for k, v in pairs], F.lit(none))
    # Stage and connection labels by the first of these that a message contains.
    stages = [("提取音频", "提取音频"), ("压缩音频", "提取音频"), ("上传", "上传中"), ("生成字幕", "识别中"), ("Whisper", "识别中"), ("翻译", "翻译中"), ("保存", "保存中"), ("连接", "连接中")]
    links = [("局域网", "局域网"), ("公网", "公网"), ("模拟器", "模拟器")]
    return events.withColumns({"percent": F.when(one.isNotNull(), clamp(one, 0, 100)).when(b > 0, ratio).cast("long"), "stage": label(stages, "处理中"), "connection": F.when(F.lower(m).contains("usb"), "USB").otherwise(label(links, ""))})


def progress_metrics(jobs: DataFrame) -> DataFrame:
    """Adds processed and total seconds of ``mm:ss/mm:ss`` in ``message``, stage percent, and the app's overall and upload percent.

    ``jobs``: ``stage, overall, message, mode, uploaded_bytes, total_bytes``.
    """
    pattern = r"(\d{2}):(\d{2})\s*/\s*(\d{2}):(\d{2})"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("message", pattern, k), F.lit("")).cast("long"), F.lit(0))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    trunc = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    o = F.col("overall")
    stage = F.when(F.col("stage") == "transcribing", clamp(trunc((o - 12) * 100 / 74))).when(F.col("stage") == "translating", clamp(trunc((o - 92) * 100 / 8))).otherwise(o)
    up = F.when(F.col("total_bytes") > 0, clamp(F.expr("uploaded_bytes * 100 div total_bytes"))).otherwise(0)
    total = F.when(F.col("mode") == "retranslate", 85 + F.expr("overall * 14 div 100")).otherwise(30 + F.expr("overall * 69 div 100"))
    return jobs.withColumns({"processed_s": part(1) * 60 + part(2), "total_s": part(3) * 60 + part(4), "stage_percent": stage.cast("long"), "overall_percent": clamp(total).cast("long"), "upload_percent": up.cast("long"), "upload_overall": (10 + F.floor(up * 20 / 100)).cast("long")})


def local_day(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd")


def with_display_times(rows: DataFrame, ts: str, ms: str, size: str) -> DataFrame:
    """Adds local day and minute of ``ts``, ``mm:ss`` and SRT time of ``ms``, megabytes of ``size``."""
    return rows.withColumns({"day": local_day(F.col(ts)), "minute": F.date_format(F.from_utc_timestamp(F.col(ts), ZONE), "HH:mm"), "clock": X.clock(F.col(ms)), "srt": X.srt_time(F.col(ms)), "megabytes": F.format_string("%.1f MB", F.col(size).cast("double") / (1024 * 1024))})


def wordbook_daily(wordbook: DataFrame) -> DataFrame:
    """Distinct lower-cased terms and look-ups of each local day, newest first."""
    return wordbook.groupBy(local_day(F.col("time")).alias("day")).agg(F.countDistinct(F.lower("term")).alias("terms"), F.count("*").alias("lookups")).orderBy(F.desc("day"))


def wordbook_day(wordbook: DataFrame, day: str) -> DataFrame:
    """Entries of one local day, newest first, with the local minute."""
    rows = wordbook.where(local_day(F.col("time")) == day).withColumn("minute", F.date_format(F.from_utc_timestamp("time", ZONE), "HH:mm"))
    return rows.orderBy(F.desc("time"), F.desc("event_id"))


def recent_wordbook(wordbook: DataFrame, most: int = 1000) -> DataFrame:
    """Each user's newest entries. Spark ranks within tasks first, so that a busy user's rows are not gathered."""
    w = Window.partitionBy("user_id").orderBy(F.desc("time"), F.desc("event_id"))
    return wordbook.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def last_session(playback: DataFrame) -> DataFrame:
    """The video with each user's newest saved state."""
    return playback.groupBy("user_id").agg(F.max_by(F.struct("video_id", "position_ms", "ts"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")


def resume_state(videos: DataFrame, playback: DataFrame, captions: DataFrame) -> DataFrame:
    """Each video's last position (0 for none) and selected caption: the saved one if it exists, else that at the position, else -1.

    ``playback``: ``video_id, ts, event_id, position_ms, selected_index``.
    """
    from lexitide.operators.captions import caption_at

    last = playback.groupBy("video_id").agg(F.max_by(F.struct("position_ms", "selected_index"), F.struct("ts", "event_id")).alias("s"))
    rows = videos.select("video_id").distinct().join(last, "video_id", "left").select("video_id", F.greatest(F.coalesce("s.position_ms", F.lit(0)), F.lit(0)).cast("long").alias("position_ms"), F.coalesce("s.selected_index", F.lit(-1)).cast("long").alias("saved"))
    sizes = captions.groupBy("video_id").agg(F.count("*").alias("n"))
    at = caption_at(rows, captions).join(sizes, "video_id", "left")
    return at.select("video_id", "position_ms", F.when((F.col("saved") >= 0) & (F.col("saved") < F.coalesce("n", F.lit(0))), F.col("saved")).otherwise(F.col("position_index")).alias("selected_index"))


def relocate_entries(wordbook: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds ``position_index`` (0-based) of a wordbook entry: its stored place if the caption there fits, else the first within
    800 ms or with the same text, else the one at its time, else null.

    Near starts meet by bins of 800 ms and equal texts by an equi-join, so a video's entries and captions are not paired.
    """
    from lexitide.operators.captions import caption_at

    blank = X.is_blank(F.col("english_text"))
    entries = wordbook.withColumns({"blank": blank})
    lines = captions.select("video_id", (F.col("idx") - 1).alias("place"), F.col("start_ms").alias("line_ms"), F.col("english_text").alias("line_text"))
    exact = entries.join(lines.withColumnRenamed("place", "subtitle_index"), ["video_id", "subtitle_index"]).where((F.col("blank")) | (F.col("line_text") == F.col("english_text")) | (F.abs(F.col("line_ms") - F.col("start_ms")) <= 800)).select("event_id", F.col("subtitle_index").alias("exact"))
    bins = lines.withColumn("bin", F.explode(F.sequence(F.floor(F.col("line_ms") / 800) - 1, F.floor(F.col("line_ms") / 800) + 1)))
    near = entries.withColumn("bin", F.floor(F.col("start_ms") / 800)).join(bins, ["video_id", "bin"]).where(F.abs(F.col("line_ms") - F.col("start_ms")) <= 800).select("event_id", "place")
    alike = entries.where(~F.col("blank")).join(lines.withColumnRenamed("line_text", "english_text"), ["video_id", "english_text"]).select("event_id", "place")
    first = near.unionByName(alike).groupBy("event_id").agg(F.min("place").alias("first"))
    timed = caption_at(entries.where("start_ms > 0").select("event_id", "video_id", F.col("start_ms").alias("position_ms")), captions).where("position_index >= 0").select("event_id", F.col("position_index").alias("timed"))
    return wordbook.join(exact, "event_id", "left").join(first, "event_id", "left").join(timed, "event_id", "left").withColumn("position_index", F.coalesce("exact", "first", "timed")).drop("exact", "first", "timed")
