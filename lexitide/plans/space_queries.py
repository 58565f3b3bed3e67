"""Queries over captions and words with the white space that sources bring: no-break and wide spaces, tabs, line ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import captions as C
from lexitide.operators import segmentation as G
from lexitide.plans import fixtures as X
from lexitide.sources import files as S

# By the place of a caption, what its texts become.
CHINESE = {0: "　", 1: "\t", 2: "\n  "}
ENGLISH = {3: " 　", 4: " one 　two\u0085"}
TOKENS = {7: " ", 8: "a　b", 9: "　,", 10: " 'S", 11: "well -", 12: " n't"}


def _sql(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


def _odd(s, d):
    place = F.pmod(F.col("video_id").cast("long") + F.col("idx"), F.lit(9))
    put = lambda texts, c: F.coalesce(*[F.when(place == k, t) for k, t in texts.items()], F.col(c)).alias(c)
    return X.captions(s, d).select("video_id", "idx", "start_ms", "end_ms", put(ENGLISH, "english_text"), put(CHINESE, "chinese_text"), "translation_source")


def _cases(texts: dict[int, str], column: str, place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {k} THEN {_sql(t)}" for k, t in texts.items()) + f" ELSE {column} END"


_PLACE = "(CAST(video_id AS BIGINT) + idx) % 9"
_ODD = f"{X.CAPTIONS}, odd AS (SELECT * REPLACE ({_cases(ENGLISH, 'english_text', _PLACE)} AS english_text, {_cases(CHINESE, 'chinese_text', _PLACE)} AS chinese_text) FROM captions)"
_WHITE = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"


def _blank(column: str) -> str:
    return f"regexp_full_match(coalesce({column}, ''), '{_WHITE}*')"


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_WHITE}+', ' ', 'g'))"


def _tidy(text: str) -> str:
    for pattern, put in ((f"{_WHITE}+([,.!?;:%])", r"\1"), (f"{_WHITE}+-{_WHITE}*", "-"), (f"(?i){_WHITE}+([''’]s\\b)", r"\1"), (f"(?i){_WHITE}+n''t\\b", "n''t")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return _collapsed(text)


def _words(s, d):
    place = F.col("idx") % 50
    return X.words(s, d).withColumn("text", F.coalesce(*[F.when(place == k, t) for k, t in TOKENS.items()], F.col("text")))


_WORDS = f"{X.WORDS}, ow AS (SELECT * REPLACE ({_cases(TOKENS, 'text', 'idx % 50')} AS text) FROM words)"


def src13_publish_odd_space(s, d):
    path, c = S.scratch(s), _odd(s, d)
    S.save_captions(c.withColumn("chinese_text", F.lit("old")), path)
    S.publish_captions(c.withColumn("chinese_text", F.when(F.col("chinese_text").isNull(), "new").otherwise(F.col("chinese_text"))), path)
    return S.load_captions(s, path).groupBy("video_id").agg(F.count_if(F.col("chinese_text") == "old").alias("old"), F.count("*").alias("n"))


def prj7_normalize_odd_space(s, d):
    text = F.concat(F.lit("译　文  "), F.lit("句"), F.col("idx").cast("string"), F.lit("　a "))
    return C.normalize_cjk(_odd(s, d).withColumn("chinese_text", text)).select("video_id", "idx", "chinese_text")


QUERIES = {
    "prj1_normalize_odd_space": lambda s, d: G.normalize_words(_words(s, d)).select("video_id", "idx", "text"),
    "prj2_join_odd_space": lambda s, d: _words(s, d).groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("w")).select("video_id", "segment_id", T.joined(F.transform("w", lambda x: T.stripped(x.text))).alias("text")),
    "prj7_normalize_odd_space": prj7_normalize_odd_space,
    "prj8_clean_odd_space": lambda s, d: C.clean_captions(_odd(s, d)).select("video_id", "idx", "english_text"),
    "prj10_display_odd_space": lambda s, d: C.display_text(_odd(s, d)).select("video_id", "idx", "display"),
    "prj15_pending_odd_space": lambda s, d: C.pending_translation(_odd(s, d)).select("video_id", "idx"),
    "agg3_completeness_odd_space": lambda s, d: C.completeness(_odd(s, d)),
    "src13_publish_odd_space": src13_publish_odd_space,
}

ORACLE_SQL = {
    "prj1_normalize_odd_space": f"WITH {_WORDS} SELECT video_id, idx, {_collapsed('text')} AS text FROM ow WHERE NOT {_blank('text')}",
    "prj2_join_odd_space": f"WITH {_WORDS} SELECT video_id, segment_id, " + _tidy("coalesce(string_agg(" + _collapsed("text") + " , ' ' ORDER BY idx) FILTER (WHERE NOT " + _blank("text") + "), '')") + " AS text FROM ow GROUP BY 1, 2",
    "prj7_normalize_odd_space": f"WITH {_ODD} SELECT video_id, idx, '译文句' || idx || ' a' AS chinese_text FROM odd",
    "prj8_clean_odd_space": f"WITH {_ODD} SELECT video_id, idx, {_collapsed('english_text')} AS english_text FROM odd WHERE NOT {_blank('english_text')}",
    "prj10_display_odd_space": f"WITH {_ODD} SELECT video_id, idx, CASE WHEN {_blank('chinese_text')} THEN english_text ELSE concat_ws(chr(10), english_text, chinese_text) END AS display FROM odd",
    "prj15_pending_odd_space": f"WITH {_ODD} SELECT video_id, idx FROM odd WHERE {_blank('chinese_text')} AND NOT {_blank('english_text')}",
    "agg3_completeness_odd_space": f"WITH {_ODD} SELECT video_id, count(*) AS n, count(*) FILTER (WHERE {_blank('chinese_text')}) AS missing, count(*) FILTER (WHERE {_blank('chinese_text')}) = 0 AS publishable FROM odd GROUP BY 1",
    "src13_publish_odd_space": f"WITH {_ODD} SELECT video_id, CASE WHEN count(*) FILTER (WHERE chinese_text IS NOT NULL AND {_blank('chinese_text')}) > 0 THEN count(*) ELSE 0 END AS old, count(*) AS n FROM odd GROUP BY 1",
}
