"""Queries over derived caption, dictionary, playback, wordbook and queue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import rules
from lexitide.operators import captions as C
from lexitide.operators import jobs as J
from lexitide.operators import lookup as L
from lexitide.plans import fixtures as X

cap, off, play, book, tasks, events = X.captions, X.offsets, X.playback, X.wordbook, X.tasks, X.task_events


def _text_captions(s, d):
    """Turns of conversations cut into lines of the caption shape with plain ``text``: one for each sentence-like piece."""
    t = X.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.posexplode(F.split("text", r"(?<=,) |\n")).alias("k", "text"), "turn")
    idx = F.col("turn") * 1000 + F.col("k")
    return t.select("video_id", idx.cast("long").alias("idx"), (idx * 900).cast("long").alias("start_ms"), (idx * 900 + 800).cast("long").alias("end_ms"), "text")


def _phrases(s, d):
    # Common pairs of the derived corpus, as a phrase table.
    pairs = ["of the", "in the", "to the", "and the", "is the", "the and", "that the", "by the"]
    return s.createDataFrame([(p, "短语 " + p) for p in pairs], "phrase string, meaning string")


# Sources that rules know, and translations that they mend; other captions keep theirs.
SOURCES = ["Oh my.", "and let's do it", "This is the lost way around Africa", "But we don't get to go straight as the crow flies, he said.", "some  serious planning."]
DRAFTS = ["这是非洲最远的路", "像乌鸦飞一样直走", "一些严肃的计划", "谷歌地图一下"]


def _polish(s, d):
    c = cap(s, d)
    k = F.col("video_id").cast("long") + F.col("idx")
    source = F.get(F.array(*map(F.lit, SOURCES)), (k % 9).cast("int"))
    draft = F.get(F.array(*map(F.lit, DRAFTS)), (k % 7).cast("int"))
    c = c.withColumns({"english_text": F.coalesce(source, "english_text"), "chinese_text": F.coalesce(draft, "chinese_text")})
    return C.polish_translations(C.apply_glossary(c)).select("video_id", "idx", "chinese_text")


def _bilingual(s, d):
    """Lines of a caption: its text, its translation, and a second translation line."""
    return C.split_bilingual(cap(s, d).select("video_id", "idx", F.array("english_text", F.coalesce("chinese_text", F.lit(" ")), F.when(F.col("idx") % 2 == 0, "第二行").otherwise("")).alias("lines"))).select("video_id", "idx", "english_text", "chinese_text")


def _tracks(s, d):
    o = X.table(s, d, "lineitem")
    return o.select(F.col("l_orderkey").cast("string").alias("video_id"), F.when(F.col("l_linenumber") % 2 == 0, "audio").otherwise("video").alias("kind"), (F.col("l_partkey") * 7 + F.col("l_linenumber") * 997).alias("duration_ms"))


def _translations(s, d):
    return cap(s, d).where("not (cast(video_id as int) % 4 = 0 and idx = 1)").select("video_id", "idx", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("translation"))


def _ids(s, d, k):
    return X.table(s, d, "conversations").select("conv_id").distinct().where(F.col("conv_id") % k == 0).select(F.col("conv_id").cast("string").alias("video_id"))


def _hashed_jobs(s, d):
    t = X.table(s, d, "documents")
    status = F.get(F.array(*map(F.lit, ("queued", "running", "done"))), (F.col("doc_id") % 3).cast("int"))
    return t.select(F.sha2("text", 256).alias("audio_hash"), F.when(F.col("doc_id") % 2 == 0, "generate").otherwise("retranslate").alias("mode"), F.col("doc_id").alias("job_id"), status.alias("status"), (F.col("doc_id") * 7 % 1000).alias("created_at"))


def _requests(s, d):
    return X.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("audio_hash"), F.when(F.col("doc_id") % 2 == 0, "generate").otherwise("retranslate").alias("mode"), (F.col("doc_id") % 3 == 0).alias("force"))


def _cache(s, d):
    return X.table(s, d, "documents").where("doc_id % 4 <> 1").groupBy(F.sha2("text", 256).alias("audio_hash")).agg(F.max(F.col("doc_id") % 5).alias("caption_count"))


def _task_requests(s, d):
    k = F.col("o_orderkey")
    return X.table(s, d, "orders").where("o_orderkey % 4 = 0").select((k + F.when(k % 8 == 0, 0).otherwise(10_000_000)).alias("task_id"), F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate").cast("timestamp")).alias("requested_at"), F.when(k % 12 == 0, True).alias("force"))


def _messages(s, d):
    e = X.table(s, d, "events")
    k = (F.col("event_id") % 6).cast("int")
    n = F.pmod(F.col("event_id"), F.lit(120)).cast("string")
    return e.select("event_id", F.get(F.array(F.concat(F.lit("上传 "), n, F.lit("% USB")), F.concat(F.lit("翻译 "), n, F.lit("/150 公网")), F.concat(F.lit("Whisper "), n, F.lit(" / 130")), F.lit("保存"), F.lit("idle"), F.concat(F.lit("Translating "), n, F.lit("/0"))), k).alias("message"))


MESSAGES = """messages AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '上传 ' || n || '% USB' WHEN 1 THEN '翻译 ' || n || '/150 公网' WHEN 2 THEN 'Whisper ' || n || ' / 130' WHEN 3 THEN '保存' WHEN 4 THEN 'idle' ELSE 'Translating ' || n || '/0' END AS message FROM (SELECT event_id, event_id % 120 AS n FROM events))"""


def _metrics(s, d):
    k = F.col("o_orderkey")
    stage = F.get(F.array(*map(F.lit, ("transcribing", "translating", "loading"))), (k % 3).cast("int"))
    t = X.table(s, d, "orders").select(k.alias("job_id"), stage.alias("stage"), (k % 101).alias("overall"), F.format_string("%02d:%02d / %02d:%02d", k % 50, k % 60, k % 55, k % 59).alias("message"), F.when(k % 2 == 0, "generate").otherwise("retranslate").alias("mode"), (k * 13 % 997).alias("uploaded_bytes"), (k % 997).alias("total_bytes"))
    return J.progress_metrics(t).drop("message", "uploaded_bytes", "total_bytes")


def _book_text(s, d):
    """Wordbook entries with the text of a caption for every third."""
    c = cap(s, d).select("video_id", (F.col("idx") - 1).alias("subtitle_index"), "english_text")
    b = book(s, d).withColumn("subtitle_index", F.when(F.col("event_id") % 2 == 0, F.col("subtitle_index")).otherwise(F.col("subtitle_index") + 3))
    return b.join(c, ["video_id", "subtitle_index"], "left").withColumn("english_text", F.when(F.col("event_id") % 3 == 0, F.col("english_text")))


def _saved(s, d):
    return play(s, d).withColumn("selected_index", F.col("event_id") % 9)


def _videos_of_tasks(s, d):
    """Tasks of videos, two videos to every third task's number, and the ids to delete."""
    t = tasks(s, d).select("task_id", (F.col("task_id") % 997).cast("string").alias("video_id"))
    return t, t.where("task_id % 211 = 0")


QUERIES = {
    "prj2_caption_text": lambda s, d: _joined_turns(s, d),
    "prj4_correct_captions": lambda s, d: C.correct_captions(cap(s, d)).select("video_id", "idx", "english_text", "chinese_text"),
    "prj5_apply_glossary": lambda s, d: C.apply_glossary(cap(s, d)).select("video_id", "idx", "prepared"),
    "prj6_polish_translations": _polish,
    "prj7_normalize_cjk": lambda s, d: C.normalize_cjk(cap(s, d).withColumn("chinese_text", F.concat(F.lit("， 露营旅行 , 熊喷雾. "), F.coalesce("chinese_text", F.lit("none"))))).select("video_id", "idx", "chinese_text"),
    "prj8_clean_captions": lambda s, d: C.clean_captions(cap(s, d)).select("video_id", "idx", "english_text"),
    "prj9_split_bilingual": _bilingual,
    "prj10_display_text": lambda s, d: C.display_text(cap(s, d)).select("video_id", "idx", "display"),
    "prj11_shift_captions": lambda s, d: C.shift_captions(cap(s, d), off(s, d)).select("video_id", "idx", "start_ms", "end_ms"),
    "prj12_inference_context": lambda s, d: C.inference_context(X.table(s, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("_hiking_gear.mp4")).otherwise(F.lit(".mkv"))).alias("title"))).drop("title"),
    "prj13_clean_terms": lambda s, d: L.clean_terms(X.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("term"))),
    "prj14_summarize_entries": lambda s, d: L.summarize_entries(X.table(s, d, "documents").where("lang = 'en'").select("doc_id", F.col("text").alias("meaning"), F.col("text").alias("definition"))),
    "prj15_pending_translation": lambda s, d: C.pending_translation(cap(s, d)).select("video_id", "idx"),
    "prj16_task_board": lambda s, d: J.task_board(tasks(s, d)).select("task_id", "status", "updated_at"),
    "prj16_done_board": lambda s, d: J.task_board(tasks(s, d), "done").select("task_id", "updated_at"),
    "prj17_parse_progress": lambda s, d: J.parse_progress(_messages(s, d)),
    "prj18_progress_metrics": _metrics,
    "prj19_display_times": lambda s, d: J.with_display_times(play(s, d).select("event_id", "ts", "position_ms", (F.col("event_id") * 1048576).alias("size")), "ts", "position_ms", "size").drop("ts", "size"),
    "src11_load_dictionary": lambda s, d: L.load_dictionary(X.dictionary(s, d)),
    "jn1_lookup_terms": lambda s, d: L.lookup_terms(book(s, d), L.load_dictionary(X.dictionary(s, d))),
    "jn2_lookup_phrases": lambda s, d: L.lookup_phrases(_two_words(s, d), _phrases(s, d), L.load_dictionary(X.dictionary(s, d))),
    "jn3_annotate_terms": lambda s, d: L.annotate_terms(cap(s, d), _phrases(s, d)),
    "jn4_caption_at": lambda s, d: C.caption_at(play(s, d), cap(s, d), off(s, d)).select("event_id", "video_id", "position_ms", "position_index"),
    "jn5_relocate_entries": lambda s, d: J.relocate_entries(_book_text(s, d), cap(s, d)).select("event_id", "position_index"),
    "jn6_attach_translations": lambda s, d: C.attach_translations(cap(s, d), _translations(s, d)).select("video_id", "idx", "chinese_text"),
    "jn7_plan_jobs": lambda s, d: J.plan_jobs(_requests(s, d), _cache(s, d)).select("doc_id", "reused"),
    "jn8_dedupe_requests": lambda s, d: J.dedupe_requests(_requests(s, d), _hashed_jobs(s, d)).select("doc_id", "active_job"),
    "jn9_retranslate_source": lambda s, d: C.retranslate_source(_ids(s, d, 2), cap(s, d).where("cast(video_id as int) % 6 = 0 and idx = 1"), cap(s, d).where("cast(video_id as int) % 10 <> 0")).select("video_id", "idx", "english_text"),
    "jn10_resume_state": lambda s, d: J.resume_state(_ids(s, d, 1), _saved(s, d), cap(s, d)),
    "agg2_wordbook_daily": lambda s, d: J.wordbook_daily(book(s, d)),
    "agg3_completeness": lambda s, d: C.completeness(cap(s, d)),
    "agg4_track_report": lambda s, d: C.track_report(_tracks(s, d)),
    "agg7_caption_counts": lambda s, d: C.caption_counts(cap(s, d)),
    "agg8_wordbook_day": lambda s, d: J.wordbook_day(book(s, d), "2024-01-03").select("event_id", "term", "minute"),
    "win11_merge_incomplete": lambda s, d: C.merge_incomplete(_text_captions(s, d)),
    "win11_merge_incomplete_v1": lambda s, d: C.merge_incomplete(_text_captions(s, d), "v1"),
    "win12_merge_sentences": lambda s, d: C.merge_sentences(_text_captions(s, d)),
    "win13_split_overlong": lambda s, d: C.split_overlong(cap(s, d).withColumnRenamed("english_text", "text").select("video_id", "idx", "start_ms", "end_ms", "text")),
    "win14_merge_fragments": lambda s, d: C.merge_fragments(cap(s, d).withColumn("english_text", F.when(F.col("idx") % 3 != 0, F.concat(F.split("english_text", " ")[0], F.lit(" x"))).otherwise(F.col("english_text")))),
    "win15_pad_captions": lambda s, d: C.pad_captions(cap(s, d)).select("video_id", "idx", "start_ms", "end_ms"),
    "win16_playback_end": lambda s, d: C.playback_end(cap(s, d)).select("video_id", "idx", "play_until_ms"),
    "win17_queue_positions": lambda s, d: J.queue_positions(tasks(s, d)),
    "win18_recent_wordbook": lambda s, d: J.recent_wordbook(book(s, d), 3).select("user_id", "event_id", "rank"),
    "win19_neighbour_captions": lambda s, d: C.neighbour_captions(cap(s, d)).select("video_id", "idx", "previous_idx", "next_idx"),
    "top1_next_task": lambda s, d: J.next_task(tasks(s, d)),
    "top2_recoverable_task": lambda s, d: J.next_task(tasks(s, d), recover=True),
    "top3_recoverable_jobs": lambda s, d: J.recoverable_jobs(tasks(s, d)).select("task_id", "status", "created_at"),
    "top4_has_pending_upload": lambda s, d: J.has_pending_upload(tasks(s, d)),
    "top5_last_session": lambda s, d: J.last_session(play(s, d)),
    "set1_upsert_tasks": lambda s, d: J.upsert_tasks(tasks(s, d), _task_requests(s, d)),
    "set2_delete_captions": lambda s, d: J.delete_task_captions(cap(s, d), *_videos_of_tasks(s, d)).select("video_id", "idx"),
    "set2_delete_tasks": lambda s, d: J.delete_tasks(tasks(s, d), tasks(s, d).where("task_id % 5 = 0")).select("task_id"),
    "set3_merge_updates": lambda s, d: J.merge_updates(tasks(s, d).select("task_id", "status", "uploaded_bytes"), tasks(s, d).where("task_id % 2 = 0").select("task_id", F.when(F.col("task_id") % 4 == 0, "done").alias("status"), F.when(F.col("task_id") % 6 == 0, F.lit(5)).cast("long").alias("uploaded_bytes"))),
    "set4_clear_translations": lambda s, d: C.clear_translations(cap(s, d), _ids(s, d, 3)).select("video_id", "idx", "chinese_text"),
    "str2_job_state": lambda s, d: J.job_state(events(s, d)),
    "str4_retry_state": lambda s, d: J.retry_state(events(s, d)),
    "str11_status_changes": lambda s, d: J.status_changes(events(s, d)),
}


def _joined_turns(s, d):
    from lexitide.functions import text as T

    return X.table(s, d, "conversations").select("conv_id", "turn", T.joined(F.split("text", r"(?<=[a-z])(?=[,.])")).alias("text"))


def _two_words(s, d):
    return X.table(s, d, "conversations").where("role = 'user'").select(F.concat_ws(" ", F.slice(F.split(F.lower("text"), "[^a-z]+"), 2, 2)).alias("term"))


def _w(*parts):
    return "WITH " + ",\n".join(parts) + "\n"


_BLANK = "trim(coalesce(chinese_text, '')) = ''"
_COLLAPSED = "trim(regexp_replace(coalesce(english_text, ''), '\\s+', ' ', 'g'))"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(term), '[‘’‛′]', '''', 'g'), '[^a-z''\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LOADED = r"""dict AS (SELECT word, coalesce(phonetic, '') AS phonetic, trim(regexp_replace(replace(replace(replace(CASE WHEN trim(translation) <> '' THEN translation WHEN trim(definition) <> '' THEN definition ELSE '词典中有该词，但暂无中文释义。' END, '\r\n', chr(10)), '\n', chr(10)), '\t', ' '), '[ \t]+', ' ', 'g')) AS meaning, definition FROM dictionary)"""
_LINES = lambda c, n, m: f"left(array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:{n}], chr(10)), {m})"
_DAY = "strftime(time + INTERVAL 8 HOUR, '%Y-%m-%d')"
_TIER = "CASE WHEN trim(remote_job_id) = '' AND NOT upload_prepared THEN 1 WHEN trim(remote_job_id) = '' THEN 2 ELSE 3 END"
_FORMS = "MAP {" + ", ".join(f"'{form}': '{label}'" for form, _, label in L.IRREGULAR) + "}"
_IRREGULAR = "MAP {" + ", ".join(f"'{form}': '{base}'" for form, base, _ in L.IRREGULAR) + "}"
_SHIFTED = "moved AS (SELECT c.video_id, idx, greatest(start_ms + coalesce(offset_ms, 0), 0) AS start_ms, greatest(end_ms + coalesce(offset_ms, 0), greatest(start_ms + coalesce(offset_ms, 0), 0) + 1) AS end_ms FROM captions c LEFT JOIN offsets o ON o.video_id = c.video_id)"


def _chain(text, pairs):
    for p, r in pairs:
        text = f"regexp_replace({text}, '{p}', '{r}', 'g')"
    return text


_I = "regexp_replace({}, '(^|[^\\wÀ-ÿ])i($|[^\\wÀ-ÿ])', '\\1I\\2', 'g')"
_QUOTED = lambda pairs: [("(?i)" + p.replace("'", "''"), r.replace("'", "''")) for p, r in pairs]
_FIXED = _I.format(_I.format(_chain(_COLLAPSED, _QUOTED(rules.CORRECTIONS))))
_CUT = "CASE WHEN idx % 3 <> 0 THEN string_split(english_text, ' ')[1] || ' x' ELSE english_text END"
_SHORT = "(len(string_split_regex(trim(t), '\\s+')) <= 3 OR length(trim(t)) <= 24)"
def _polished_sql() -> str:
    """Sentence rules, guarded fragments, fragments, and Chinese marks of texts that hold no repeated full-width marks but these."""
    q = lambda x: x.replace("'", "''")
    either = lambda p: f"(regexp_matches(source, '{q(p)}') OR regexp_matches(prepared, '{q(p)}'))"
    text = "chinese"
    for guard, pairs in [*rules.GUARDED_FRAGMENTS, (None, rules.FRAGMENTS)]:
        for old, new in pairs:
            text = f"replace({text}, '{old}', '{new}')" if guard is None else f"CASE WHEN {either(guard)} THEN replace({text}, '{old}', '{new}') ELSE {text} END"
    whole = " ".join(f"WHEN {either(f'^(?:{p})$')} THEN '{new}'" for p, new in rules.SENTENCES)
    return f"CASE {whole} ELSE {text} END"


ORACLE_SQL = {
    "prj2_caption_text": f"SELECT conv_id, turn, {X.tidy_sql("regexp_replace(text, '([a-z])([,.])', '\\1 \\2', 'g')")} AS text FROM conversations",
    "prj4_correct_captions": _w(X.CAPTIONS, f"f AS (SELECT *, {_FIXED} AS t FROM captions)", "g AS (SELECT *, strpos(t, regexp_extract(t, '[A-Za-z]')) AS p FROM f)", "h AS (SELECT *, CASE WHEN regexp_extract(t, '[A-Za-z]') <> '' THEN substr(t, 1, p - 1) || upper(substr(t, p, 1)) || substr(t, p + 1) ELSE t END AS u FROM g)") + "SELECT video_id, idx, u AS english_text, CASE WHEN u = coalesce(english_text, '') THEN chinese_text END AS chinese_text FROM h",
    "prj5_apply_glossary": _w(X.CAPTIONS) + f"SELECT video_id, idx, {_chain(_COLLAPSED, _QUOTED(rules.GLOSSARY))} AS prepared FROM captions",
    "win14_merge_fragments": _w(X.CAPTIONS, f"c AS (SELECT * EXCLUDE (english_text), {_CUT} AS t FROM captions)", "n AS (SELECT *, lead(start_ms) OVER v AS ns, lead(end_ms) OVER v AS ne, lead(t) OVER v AS nt, lead(chinese_text) OVER v AS nc, lead(translation_source) OVER v AS nsrc FROM c WINDOW v AS (PARTITION BY video_id ORDER BY idx))",
        f"a AS (SELECT *, coalesce(ns IS NOT NULL AND trim(t) <> '' AND NOT regexp_matches(trim(t), '[.!?][\"'')\\]]*$') AND ns - end_ms <= 1500 AND length(trim(t)) + 1 + length(trim(nt)) <= 140 AND {_SHORT}, false) AS can FROM n)",
        "r AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY idx) AS run FROM a)", "m AS (SELECT *, can AND sum(CASE WHEN can THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, run ORDER BY idx) % 2 = 1 AS g FROM r)", "u AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY video_id ORDER BY idx), false) AS used FROM m)")
    + "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS idx, start_ms, CASE WHEN g THEN ne ELSE end_ms END AS end_ms, CASE WHEN g THEN trim(rtrim(t) || ' ' || ltrim(nt)) ELSE t END AS english_text, CASE WHEN g THEN nullif(concat_ws(chr(10), nullif(trim(chinese_text), ''), nullif(trim(nc), '')), '') ELSE chinese_text END AS chinese_text, CASE WHEN g THEN CASE WHEN translation_source IS NOT DISTINCT FROM nsrc THEN translation_source END ELSE translation_source END AS translation_source FROM u WHERE NOT used",
    "prj8_clean_captions": _w(X.CAPTIONS) + f"SELECT video_id, idx, {_COLLAPSED} AS english_text FROM captions WHERE {_COLLAPSED} <> ''",
    "prj6_polish_translations": _w(X.CAPTIONS, f"k AS (SELECT *, CAST(video_id AS BIGINT) + idx AS k FROM captions)", "x AS (SELECT video_id, idx, " + X.collapsed_sql(f"coalesce({X._list_sql([x.replace(chr(39), chr(39) * 2) for x in SOURCES])}[CAST(k % 9 AS INTEGER) + 1], english_text)") + " AS english, " + X.collapsed_sql(f"coalesce({X._list_sql(DRAFTS)}[CAST(k % 7 AS INTEGER) + 1], chinese_text)") + " AS chinese FROM k)", f"y AS (SELECT *, lower(english) AS source, lower({X.glossary_sql('english')}) AS prepared FROM x)")
    + f"SELECT video_id, idx, {_polished_sql()} AS chinese_text FROM y",
    "prj9_split_bilingual": _w(X.CAPTIONS) + "SELECT video_id, idx, trim(english_text) AS english_text, nullif(trim(concat_ws(chr(10), chinese_text, CASE WHEN idx % 2 = 0 THEN '第二行' END)), '') AS chinese_text FROM captions",
    "prj10_display_text": _w(X.CAPTIONS) + f"SELECT video_id, idx, CASE WHEN {_BLANK} THEN english_text ELSE english_text || chr(10) || chinese_text END AS display FROM captions",
    "prj11_shift_captions": _w(X.CAPTIONS, X.OFFSETS, _SHIFTED) + "SELECT video_id, idx, start_ms, end_ms FROM moved",
    "prj12_inference_context": """SELECT p_partkey, 'The video title is: ' || t || '.' || CASE WHEN o THEN ' Use accurate outdoor, hiking, camping and ultralight gear terminology.' ELSE '' END AS prompt, t || CASE WHEN o THEN ', hiking, camping, backpacking, trail' ELSE '' END AS hotwords
        FROM (SELECT p_partkey, t, regexp_matches(t, '(?i)\\b(hik|backpack|camp|trail|mountain|outdoor|gear|trek|switzerland|pakistan)\\w*\\b') AS o FROM (SELECT p_partkey, trim(regexp_replace(p_name, '[_\\s]+', ' ', 'g') || CASE WHEN p_partkey % 3 = 0 THEN ' hiking gear' ELSE '' END) AS t FROM part))""",
    "prj13_clean_terms": f"SELECT conv_id, turn, {_CLEAN} AS term FROM (SELECT conv_id, turn, text AS term FROM conversations WHERE role = 'user')",
    "prj14_summarize_entries": f"SELECT doc_id, {_LINES('text', 5, 360)} AS meaning, {_LINES('text', 3, 420)} AS definition FROM documents WHERE lang = 'en'",
    "prj15_pending_translation": _w(X.CAPTIONS) + f"SELECT video_id, idx FROM captions WHERE {_BLANK}",
    "prj16_task_board": _w(X.TASKS) + "SELECT task_id, status, updated_at FROM tasks WHERE status IN ('queued', 'running', 'paused', 'failed')",
    "prj16_done_board": _w(X.TASKS) + "SELECT task_id, updated_at FROM tasks WHERE status = 'done'",
    "prj17_parse_progress": _w(MESSAGES, "m AS (SELECT *, TRY_CAST(nullif(regexp_extract(message, '(\\d{1,3})%', 1), '') AS BIGINT) AS p, TRY_CAST(nullif(regexp_extract(message, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(message, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS BIGINT) AS b FROM messages)")
    + "SELECT event_id, message, CASE WHEN p IS NOT NULL THEN least(p, 100) WHEN b > 0 THEN CASE WHEN contains(message, '翻译') OR contains(lower(message), 'translat') THEN greatest(92, least(99, 92 + a * 7 // b)) ELSE least(100, a * 100 // b) END END AS percent, CASE WHEN contains(message, '上传') THEN '上传中' WHEN contains(message, 'Whisper') THEN '识别中' WHEN contains(message, '翻译') THEN '翻译中' WHEN contains(message, '保存') THEN '保存中' ELSE '处理中' END AS stage, CASE WHEN contains(message, 'USB') THEN 'USB' WHEN contains(message, '公网') THEN '公网' ELSE '' END AS connection FROM m",
    "prj18_progress_metrics": """SELECT job_id, stage, overall, mode, (k % 50) * 60 + k % 60 AS processed_s, (k % 55) * 60 + k % 59 AS total_s, CAST(CASE stage WHEN 'transcribing' THEN greatest(0, least(100, trunc((overall - 12) * 100 / 74.0))) WHEN 'translating' THEN greatest(0, least(100, trunc((overall - 92) * 100 / 8.0))) ELSE overall END AS BIGINT) AS stage_percent,
        least(100, CASE WHEN mode = 'retranslate' THEN 85 + overall * 14 // 100 ELSE 30 + overall * 69 // 100 END) AS overall_percent, up AS upload_percent, 10 + up * 20 // 100 AS upload_overall
        FROM (SELECT o_orderkey AS k, o_orderkey AS job_id, ['transcribing', 'translating', 'loading'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS stage, o_orderkey % 101 AS overall, CASE WHEN o_orderkey % 2 = 0 THEN 'generate' ELSE 'retranslate' END AS mode, CASE WHEN o_orderkey % 997 > 0 THEN least(100, (o_orderkey * 13 % 997) * 100 // (o_orderkey % 997)) ELSE 0 END AS up FROM orders)""",
    "prj19_display_times": _w(X.PLAYBACK) + "SELECT event_id, position_ms, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS minute, printf('%02d:%02d', position_ms // 60000, position_ms // 1000 % 60) AS clock, printf('%02d:%02d:%02d,%03d', position_ms // 3600000, position_ms // 60000 % 60, position_ms // 1000 % 60, position_ms % 1000) AS srt, event_id || '.0 MB' AS megabytes FROM playback",
    "src11_load_dictionary": _w(X.DICTIONARY, _LOADED) + "SELECT word, phonetic, meaning, definition FROM dict",
    "jn1_lookup_terms": _w(X.WORDBOOK, X.DICTIONARY, _LOADED, f"t AS (SELECT DISTINCT {_CLEAN} AS term FROM wordbook)",
        f"""c AS (SELECT term, left(term, length(term) - 3) AS s3, left(term, length(term) - 2) AS s2, left(term, length(term) - 1) AS s1, length(term) AS n, {_IRREGULAR}[term] AS irr FROM t WHERE term <> '' AND NOT contains(term, ' '))""",
        """cc AS (SELECT *, CASE WHEN irr IS NOT NULL THEN [irr] WHEN term IN ('news', 'series', 'species', 'physics', 'mathematics', 'this', 'his', 'is', 'was') THEN [] WHEN term LIKE '%ies' AND n > 4 THEN [s3 || 'y']
            WHEN term LIKE '%ing' AND n > 5 THEN [CASE WHEN length(s3) > 2 AND right(s3, 1) = right(s3, 2)[1] AND contains('bdgmnprt', right(s3, 1)) THEN left(s3, length(s3) - 1) END, s3, s3 || 'e'] WHEN term LIKE '%ied' AND n > 4 THEN [s3 || 'y']
            WHEN term LIKE '%ed' AND n > 4 THEN [CASE WHEN length(s2) > 2 AND right(s2, 1) = right(s2, 2)[1] AND contains('bdgmnprt', right(s2, 1)) THEN left(s2, length(s2) - 1) END, s2, s1] WHEN term LIKE '%es' AND n > 4 THEN [s2, s1] WHEN term LIKE '%s' AND n > 3 THEN [s1] ELSE [] END AS cand,
            CASE WHEN term LIKE '%ies' AND n > 4 THEN s3 || 'y' WHEN term LIKE '%ing' AND n > 5 THEN CASE WHEN length(s3) > 2 AND right(s3, 1) = right(s3, 2)[1] THEN left(s3, length(s3) - 1) ELSE s3 END WHEN term LIKE '%ed' AND n > 4 THEN s2 WHEN term LIKE '%es' AND n > 4 THEN s2 WHEN term LIKE '%s' AND n > 3 THEN s1 ELSE term END AS guess FROM c)""",
        "tr AS (SELECT term, unnest(cand) AS word, generate_subscripts(cand, 1) AS pos FROM cc)", "b AS (SELECT term, arg_min(word, pos) AS lemma, arg_min(phonetic, pos) AS phonetic, arg_min(meaning, pos) AS meaning, arg_min(definition, pos) AS definition FROM tr JOIN dict USING (word) WHERE word <> term GROUP BY term)")
    + f"""SELECT cc.term, CASE WHEN b.term IS NOT NULL THEN CASE WHEN trim(coalesce(e.phonetic, '')) <> '' THEN e.phonetic ELSE b.phonetic END WHEN e.word IS NOT NULL THEN e.phonetic WHEN g.word IS NOT NULL THEN g.phonetic ELSE '' END AS phonetic,
        CASE WHEN b.term IS NOT NULL THEN {_LINES('b.meaning', 5, 360)} WHEN e.word IS NOT NULL THEN {_LINES('e.meaning', 5, 360)} WHEN g.word IS NOT NULL THEN g.meaning || chr(10) || '原形：' || guess ELSE '本地词典暂未收录。' END AS meaning,
        CASE WHEN b.term IS NOT NULL THEN {_LINES('b.definition', 3, 420)} WHEN e.word IS NOT NULL THEN {_LINES('e.definition', 3, 420)} WHEN g.word IS NOT NULL THEN g.definition ELSE '' END AS definition, b.lemma,
        CASE WHEN b.term IS NOT NULL THEN coalesce({_FORMS}[cc.term], CASE WHEN cc.term LIKE '%ing' THEN '现在分词或动名词' WHEN cc.term LIKE '%ed' THEN '过去式或过去分词' ELSE '复数或第三人称单数' END) END AS inflection
        FROM cc LEFT JOIN b ON b.term = cc.term LEFT JOIN dict e ON e.word = cc.term LEFT JOIN dict g ON g.word = cc.guess""",
    "jn2_lookup_phrases": """SELECT term, CASE WHEN term IN ('of the', 'in the', 'to the', 'and the', 'is the', 'the and', 'that the', 'by the') THEN '短语 ' || term ELSE '本地短语库暂未收录。可以尝试点击其中的单词查询。' END AS meaning
        FROM (SELECT DISTINCT trim(array_to_string(string_split_regex(lower(text), '[^a-z]+')[2:3], ' ')) AS term FROM conversations WHERE role = 'user') WHERE contains(term, ' ')""",
    "jn4_caption_at": _w(X.CAPTIONS, X.OFFSETS, X.PLAYBACK, _SHIFTED) + "SELECT p.event_id, p.video_id, p.position_ms, coalesce(max(m.idx) - 1, -1) AS position_index FROM playback p LEFT JOIN moved m ON m.video_id = p.video_id AND m.start_ms <= p.position_ms AND p.position_ms < m.end_ms GROUP BY ALL",
    "jn5_relocate_entries": _w(X.CAPTIONS, X.WORDBOOK, "b0 AS (SELECT event_id, video_id, start_ms, CASE WHEN event_id % 2 = 0 THEN subtitle_index ELSE subtitle_index + 3 END AS si FROM wordbook)", "b AS (SELECT b0.*, CASE WHEN event_id % 3 = 0 THEN c.english_text END AS txt FROM b0 LEFT JOIN captions c ON c.video_id = b0.video_id AND c.idx = b0.si + 1)")
    + """SELECT b.event_id, coalesce(max(CASE WHEN x.idx = b.si + 1 AND (trim(coalesce(txt, '')) = '' OR x.english_text = txt OR abs(x.start_ms - b.start_ms) <= 800) THEN b.si END), min(CASE WHEN abs(x.start_ms - b.start_ms) <= 800 OR (trim(coalesce(txt, '')) <> '' AND x.english_text = txt) THEN x.idx - 1 END), max(CASE WHEN b.start_ms > 0 AND x.start_ms <= b.start_ms AND b.start_ms < x.end_ms THEN x.idx - 1 END)) AS position_index
        FROM b LEFT JOIN captions x ON x.video_id = b.video_id GROUP BY b.event_id""",
    "jn6_attach_translations": _w(X.CAPTIONS) + "SELECT video_id, idx, CASE WHEN CAST(video_id AS INTEGER) % 4 <> 0 THEN 't' || idx END AS chinese_text FROM captions",
    "jn7_plan_jobs": "WITH c AS (SELECT text, max(doc_id % 5) AS n FROM documents WHERE doc_id % 4 <> 1 GROUP BY text) SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND coalesce(n, 0) > 0 AS reused FROM documents LEFT JOIN c USING (text)",
    "jn8_dedupe_requests": "WITH a AS (SELECT text, doc_id % 2 AS m, arg_min(doc_id, (doc_id * 7 % 1000) * 1000000 + doc_id) AS active_job FROM documents WHERE doc_id % 3 < 2 GROUP BY ALL) SELECT doc_id, active_job FROM documents d LEFT JOIN a ON a.text = d.text AND a.m = d.doc_id % 2",
    "jn9_retranslate_source": _w(X.CAPTIONS, "r AS (SELECT DISTINCT video_id, CAST(video_id AS INTEGER) AS v FROM captions WHERE CAST(video_id AS INTEGER) % 2 = 0)") + "SELECT r.video_id, c.idx, c.english_text FROM r LEFT JOIN captions c ON c.video_id = r.video_id AND trim(c.english_text) <> '' AND CASE WHEN v % 6 = 0 THEN c.idx = 1 ELSE v % 10 <> 0 END",
    "jn10_resume_state": _w(X.CAPTIONS, X.PLAYBACK, "v AS (SELECT video_id, count(*) AS n FROM captions GROUP BY 1)", "l AS (SELECT video_id, position_ms, event_id % 9 AS si FROM playback QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts DESC, event_id DESC) = 1)", "s AS (SELECT v.video_id, n, coalesce(position_ms, 0) AS position_ms, coalesce(si, -1) AS si FROM v LEFT JOIN l USING (video_id))")
    + "SELECT s.video_id, s.position_ms, CASE WHEN si >= 0 AND si < n THEN si ELSE coalesce(max(c.idx) - 1, -1) END AS selected_index FROM s LEFT JOIN captions c ON c.video_id = s.video_id AND c.start_ms <= s.position_ms AND s.position_ms < c.end_ms GROUP BY s.video_id, s.position_ms, si, n",
    "agg2_wordbook_daily": _w(X.WORDBOOK) + f"SELECT {_DAY} AS day, count(DISTINCT lower(term)) AS terms, count(*) AS lookups FROM wordbook GROUP BY 1",
    "agg3_completeness": _w(X.CAPTIONS) + f"SELECT video_id, count(*) AS n, count(*) FILTER (WHERE {_BLANK}) AS missing, count(*) FILTER (WHERE {_BLANK}) = 0 AS publishable FROM captions GROUP BY 1",
    "agg4_track_report": "SELECT video_id, v AS video_ms, a AS audio_ms, coalesce(a - v > 5000, false) AS audio_outlasts, CASE WHEN v IS NULL THEN 0 ELSE greatest(v - 500, 0) END AS safe_end_ms FROM (SELECT CAST(l_orderkey AS VARCHAR) AS video_id, max(l_partkey * 7 + l_linenumber * 997) FILTER (WHERE l_linenumber % 2 = 1) AS v, max(l_partkey * 7 + l_linenumber * 997) FILTER (WHERE l_linenumber % 2 = 0) AS a FROM lineitem GROUP BY 1)",
    "agg7_caption_counts": _w(X.CAPTIONS) + f"SELECT video_id, count(*) AS caption_count, count(*) FILTER (WHERE {_BLANK}) = 0 AS bilingual FROM captions GROUP BY 1",
    "agg8_wordbook_day": _w(X.WORDBOOK) + f"SELECT event_id, term, strftime(time + INTERVAL 8 HOUR, '%H:%M') AS minute FROM wordbook WHERE {_DAY} = '2024-01-03'",
    "win15_pad_captions": _w(X.CAPTIONS, "n AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY idx) AS nx FROM captions)") + "SELECT video_id, idx, greatest(start_ms - 30, 0) AS start_ms, greatest(CASE WHEN nx IS NULL THEN end_ms + 220 WHEN nx > end_ms + 30 THEN least(end_ms + 220, nx - 30) ELSE end_ms END, greatest(start_ms - 30, 0) + 200) AS end_ms FROM n",
    "win16_playback_end": _w(X.CAPTIONS, "n AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY idx) AS nx FROM captions)") + "SELECT video_id, idx, greatest(least(end_ms + 160, coalesce(greatest(nx - 60, start_ms + 1), end_ms + 160)), start_ms + 1) AS play_until_ms FROM n",
    "win17_queue_positions": _w(X.TASKS) + "SELECT queue, task_id, row_number() OVER (PARTITION BY queue ORDER BY created_at, task_id) AS position FROM tasks WHERE status = 'queued' UNION ALL SELECT queue, task_id, 0 FROM tasks WHERE status = 'running'",
    "win18_recent_wordbook": _w(X.WORDBOOK) + "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY time DESC, event_id DESC) AS INTEGER) AS rank FROM wordbook QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY time DESC, event_id DESC) <= 3",
    "win19_neighbour_captions": _w(X.CAPTIONS) + "SELECT video_id, idx, coalesce(lag(idx) OVER v, idx) AS previous_idx, coalesce(lead(idx) OVER v, idx) AS next_idx FROM captions WINDOW v AS (PARTITION BY video_id ORDER BY idx)",
    "top1_next_task": _w(X.TASKS) + f"SELECT user_id, task_id, status FROM tasks WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_TIER}, created_at, task_id) = 1",
    "top2_recoverable_task": _w(X.TASKS) + f"SELECT user_id, task_id, status FROM tasks WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'running' THEN 0 ELSE {_TIER} END, created_at, task_id) = 1",
    "top3_recoverable_jobs": _w(X.TASKS) + "SELECT task_id, status, created_at FROM tasks WHERE status IN ('queued', 'running')",
    "top4_has_pending_upload": _w(X.TASKS, "o AS (SELECT *, CASE WHEN status = 'queued' AND trim(remote_job_id) = '' THEN 1 ELSE 0 END AS own FROM tasks)") + "SELECT user_id, task_id, sum(own) OVER (PARTITION BY user_id) - own > 0 AS pending FROM o",
    "top5_last_session": _w(X.PLAYBACK) + "SELECT user_id, video_id, position_ms, ts FROM playback QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "set1_upsert_tasks": _w(X.TASKS, "r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 10000000 END AS task_id, CAST(o_orderdate AS TIMESTAMP) + to_days(30) AS requested_at, CASE WHEN o_orderkey % 12 = 0 THEN true END AS asked FROM orders WHERE o_orderkey % 4 = 0)")
    + "SELECT coalesce(t.task_id, r.task_id) AS task_id, CASE WHEN r.task_id IS NOT NULL THEN 'queued' ELSE status END AS status, coalesce(created_at, requested_at) AS created_at, CASE WHEN r.task_id IS NOT NULL THEN requested_at ELSE updated_at END AS updated_at, coalesce(uploaded_bytes, 0) AS uploaded_bytes, CASE WHEN r.task_id IS NOT NULL THEN coalesce(asked, coalesce(force, false) OR coalesce(status = 'done', false)) ELSE force END AS force, CASE WHEN r.task_id IS NOT NULL THEN '' ELSE remote_job_id END AS remote_job_id FROM tasks t FULL JOIN r ON t.task_id = r.task_id",
    "set2_delete_captions": _w(X.CAPTIONS) + "SELECT video_id, idx FROM captions WHERE video_id NOT IN (SELECT CAST(o_orderkey % 997 AS VARCHAR) FROM orders WHERE o_orderkey % 211 = 0)",
    "set2_delete_tasks": "SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey % 5 <> 0",
    "set3_merge_updates": _w(X.TASKS) + "SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'done' ELSE status END AS status, CASE WHEN task_id % 6 = 0 THEN 5 ELSE uploaded_bytes END AS uploaded_bytes FROM tasks",
    "set4_clear_translations": _w(X.CAPTIONS) + "SELECT video_id, idx, CASE WHEN CAST(video_id AS INTEGER) % 3 <> 0 THEN chinese_text END AS chinese_text FROM captions",
    "str2_job_state": _w(X.TASK_EVENTS) + "SELECT user_id, arg_max(kind, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL) AS progress, max(ts) AS updated_at FROM task_events GROUP BY user_id",
    "str4_retry_state": _w(X.TASK_EVENTS, "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM task_events)", "d AS (SELECT user_id, coalesce(max(k) FILTER (WHERE kind = 'done'), 0) AS d FROM n GROUP BY 1)", "f AS (SELECT user_id, count(*) FILTER (WHERE k > d AND kind = 'failure') AS failures, arg_max(kind, k) AS last FROM n JOIN d USING (user_id) GROUP BY 1)") + "SELECT user_id, failures, CASE WHEN last = 'failure' THEN CASE WHEN failures < 5 THEN 'queued' ELSE 'failed' END ELSE last END AS status FROM f",
    "str11_status_changes": _w(X.TASK_EVENTS, "n AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM task_events)") + "SELECT user_id, event_id, ts, kind FROM n WHERE before IS NULL OR before <> kind",
}
