"""Caption rows: cleaning, merging, splitting, timing, translation state. Rows are keyed by ``video_id`` and ordered by ``idx``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lexitide.functions import rules as R
from lexitide.functions import text as X

def by_video() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("idx")
#: Rules that a user gives as tables are read once into expressions, this many at most.
MOST_RULES = 1000
HAS_CJK = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF]"


def correct_captions(captions: DataFrame) -> DataFrame:
    """Known slips mended; a caption whose text changes loses its translation."""
    fixed = captions.withColumn("fixed", X.corrected(F.col("english_text")))
    return fixed.withColumns({"chinese_text": F.when(F.col("fixed") != F.coalesce("english_text", F.lit("")), F.lit(None).cast("string")).otherwise(F.col("chinese_text")), "english_text": F.col("fixed")}).drop("fixed")


def apply_glossary(captions: DataFrame, style: str = "natural") -> DataFrame:
    """Adds ``prepared``: the text for translation, with glossary terms put in unless the style is raw."""
    text = X.collapse(F.col("english_text"))
    return captions.withColumn("prepared", text if style in ("", "raw", "none", "off") else X.replaced(text, R.GLOSSARY))


def polish_translations(captions: DataFrame, sentences: DataFrame | None = None, fragments: DataFrame | None = None, style: str = "natural") -> DataFrame:
    """Translations by rule: a whole-sentence rule gives its text at once, else fragments in order, then Chinese marks.

    The rules are those of ``rules``; a user's own may be given instead. ``sentences``: ``pattern, replacement``, and
    ``fragments``: ``seq, guard, old, new`` (null guard: always). Each rule becomes an expression, so a table may have
    at most ``MOST_RULES``. The style raw only collapses white space.
    """
    text = X.collapse(F.col("chinese_text"))
    if style in ("", "raw", "none", "off"):
        return captions.withColumn("chinese_text", text)
    whole = R.SENTENCES if sentences is None else [(r.pattern, r.replacement) for r in _few(sentences)]
    parts = [(guard, old, new) for guard, pairs in [*R.GUARDED_FRAGMENTS, (None, R.FRAGMENTS)] for old, new in pairs] if fragments is None else [(r.guard, r.old, r.new) for r in sorted(_few(fragments), key=lambda r: r.seq)]
    rows = captions.withColumns({"__source": F.lower(X.collapse(F.col("english_text"))), "__prepared": F.lower(X.collapse(F.col("prepared")))})
    either = lambda p: F.col("__source").rlike("(?i)" + p) | F.col("__prepared").rlike("(?i)" + p)
    for guard, old, new in parts:  # replacing nothing changes nothing
        text = F.replace(text, F.lit(old) if guard is None else F.when(either(guard), old).otherwise(""), F.lit(new))
    rows = rows.withColumns({"__mended": text, "__whole": F.coalesce(*[F.when(either(f"^(?:{p})$"), F.lit(new)) for p, new in whole], F.lit(None))})
    return rows.withColumn("chinese_text", F.coalesce("__whole", X.cjk_normalised(F.col("__mended")))).drop("__source", "__prepared", "__mended", "__whole")


def _few(rules: DataFrame) -> list:
    found = rules.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return found


def normalize_cjk(captions: DataFrame, column: str = "chinese_text") -> DataFrame:
    return captions.withColumn(column, X.cjk_normalised(F.col(column)))


def clean_captions(captions: DataFrame) -> DataFrame:
    """Collapsed text without blank rows."""
    return captions.withColumn("english_text", X.collapse(F.col("english_text"))).where("english_text <> ''")


def split_bilingual(lines: DataFrame, column: str = "lines") -> DataFrame:
    """``english_text`` and ``chinese_text`` of an array of lines, cut at the first line with Chinese characters.

    If the first line has them it is the English text, as a caption needs one; the rest is the Chinese text.
    """
    clean = F.filter(F.transform(column, lambda t: X.stripped(t)), lambda t: t != "")
    first = F.coalesce(F.get(F.filter(F.transform("__l", lambda t, i: F.when(t.rlike(HAS_CJK), i).otherwise(-1)), lambda i: i >= 0), F.lit(0)), F.size("__l"))
    rows = lines.withColumn("__l", clean).withColumn("__at", F.greatest(first, F.lit(1)))
    rest = F.array_join(F.expr("slice(__l, __at + 1, greatest(size(__l), 1))"), "\n")
    return rows.withColumns({"english_text": F.trim(F.array_join(F.expr("slice(__l, 1, __at)"), " ")), "chinese_text": F.nullif(F.trim(rest), F.lit(""))}).drop("__l", "__at")


def display_text(captions: DataFrame, mode: str = "bilingual") -> DataFrame:
    """Adds ``display``: ``english``, ``chinese`` (English where there is none) or both on two lines."""
    both = F.when(X.is_blank(F.col("chinese_text")), F.col("english_text")).otherwise(F.concat_ws("\n", "english_text", "chinese_text"))
    return captions.withColumn("display", {"english": F.col("english_text"), "chinese": F.coalesce("chinese_text", "english_text"), "bilingual": both}[mode])


def shift_captions(captions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times moved by each video's ``offset_ms``: start at 0 at least, end 1 ms after it at least."""
    rows = captions.join(offsets, "video_id", "left").withColumn("by", F.coalesce("offset_ms", F.lit(0)))
    rows = rows.withColumn("start_ms", F.greatest(F.col("start_ms") + F.col("by"), F.lit(0)))
    return rows.withColumn("end_ms", F.greatest(F.col("end_ms") + F.col("by"), F.col("start_ms") + 1)).drop("by", "offset_ms")


def pending_translation(captions: DataFrame) -> DataFrame:
    """Captions with a text and without a translation."""
    return captions.where(X.is_blank(F.col("chinese_text")) & ~X.is_blank(F.col("english_text")))


def completeness(captions: DataFrame) -> DataFrame:
    """Per video: rows, rows without translation, and whether it may be published."""
    missing = F.count_if(X.is_blank(F.col("chinese_text")))
    return captions.groupBy("video_id").agg(F.count("*").alias("n"), missing.alias("missing")).withColumn("publishable", F.col("missing") == 0)


def caption_counts(captions: DataFrame) -> DataFrame:
    """Per video: number of captions, and whether all have a translation."""
    return completeness(captions).select("video_id", F.col("n").alias("caption_count"), F.col("publishable").alias("bilingual"))


def attach_translations(captions: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations by position; a video whose counts differ keeps English only.

    ``translations``: ``video_id, idx, translation``.
    """
    one, two = captions.groupBy("video_id").agg(F.count("*").alias("n")), translations.groupBy("video_id").agg(F.count("*").alias("m"))
    agree = one.join(two, "video_id").where("n = m").select("video_id")
    return captions.drop("chinese_text").join(translations.join(agree, "video_id", "left_semi").withColumnRenamed("translation", "chinese_text"), ["video_id", "idx"], "left")


def clear_translations(captions: DataFrame, ids: DataFrame) -> DataFrame:
    flagged = captions.join(ids.select("video_id").distinct().withColumn("hit", F.lit(True)), "video_id", "left")
    return flagged.withColumn("chinese_text", F.when(F.col("hit"), F.lit(None).cast("string")).otherwise(F.col("chinese_text"))).drop("hit")


def retranslate_source(requests: DataFrame, supplied: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to translate anew: supplied ones if there are any, else cached ones; blank lines go, translations are empty.

    A request with neither appears once with a null ``idx``.
    """
    own = supplied.where(~X.is_blank(F.col("english_text"))).join(requests, "video_id", "left_semi")
    cached = cache.where(~X.is_blank(F.col("english_text"))).join(requests, "video_id", "left_semi").join(own.select("video_id").distinct(), "video_id", "left_anti")
    names = ["video_id", "idx", "start_ms", "end_ms", "english_text"]
    rows = own.select(names).unionByName(cached.select(names))
    return requests.select("video_id").join(rows, "video_id", "left").withColumn("chinese_text", F.lit(None).cast("string"))


def pad_captions(captions: DataFrame) -> DataFrame:
    """Starts 30 ms earlier; ends 220 ms later but 30 ms before the next start, or as they are if it is closer; 200 ms at least."""
    nxt = F.lead("start_ms").over(by_video())
    end = F.when(nxt.isNull(), F.col("end_ms") + R.END_PAD_MS).when(nxt > F.col("end_ms") + R.MIN_GAP_MS, F.least(F.col("end_ms") + R.END_PAD_MS, nxt - R.MIN_GAP_MS)).otherwise(F.col("end_ms"))
    rows = captions.withColumn("__end", end).withColumn("start_ms", F.greatest(F.col("start_ms") - R.START_PAD_MS, F.lit(0)))
    return rows.withColumn("end_ms", F.greatest("__end", F.col("start_ms") + R.LEAST_MS)).drop("__end")


def playback_end(captions: DataFrame) -> DataFrame:
    """Adds ``play_until_ms``: 160 ms after the end, but 60 ms before the next start, 1 ms after the start at least."""
    cap = F.greatest(F.lead("start_ms").over(by_video()) - 60, F.col("start_ms") + 1)
    until = F.col("end_ms") + 160
    return captions.withColumn("play_until_ms", F.greatest(F.least(until, F.coalesce(cap, until)), F.col("start_ms") + 1))


def neighbour_captions(captions: DataFrame) -> DataFrame:
    """Adds ``previous_idx`` and ``next_idx``, a row's own at the ends."""
    return captions.withColumns({"previous_idx": F.coalesce(F.lag("idx").over(by_video()), "idx"), "next_idx": F.coalesce(F.lead("idx").over(by_video()), "idx")})


def merge_fragments(captions: DataFrame) -> DataFrame:
    """Pairs of a short unfinished caption and the next, if within 1.5 s and 140 characters. In runs the odd ones merge."""
    text = F.trim("english_text")
    nxt = F.lead(F.struct("start_ms", "end_ms", "english_text", "chinese_text", "translation_source")).over(by_video())
    rows = captions.withColumn("nxt", nxt)
    short = (F.size(F.split(text, r"\s+")) <= 3) | (F.length(text) <= 24)
    can = (text != "") & ~text.rlike(X.ENDS_SENTENCE) & (F.col("nxt.start_ms") - F.col("end_ms") <= 1500) & (F.length(text) + 1 + F.length(F.trim("nxt.english_text")) <= 140) & short
    rows = rows.withColumn("can", F.coalesce(can, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("can"), 0).otherwise(1)).over(by_video()))
    rows = rows.withColumn("merges", F.col("can") & (F.sum(F.when(F.col("can"), 1).otherwise(0)).over(Window.partitionBy("video_id", "run").orderBy("idx")) % 2 == 1))
    rows = rows.withColumn("used", F.coalesce(F.lag("merges").over(by_video()), F.lit(False))).where("not used")
    pick = lambda a, b: F.when(F.col("merges"), a).otherwise(F.col(b))
    parts = F.array_join(F.filter(F.array(F.trim("chinese_text"), F.trim("nxt.chinese_text")), lambda t: t.isNotNull() & (t != "")), "\n")
    same = F.when(F.col("translation_source").eqNullSafe(F.col("nxt.translation_source")), F.col("translation_source"))
    return rows.select("video_id", F.row_number().over(by_video()).cast("long").alias("idx"), "start_ms", pick(F.col("nxt.end_ms"), "end_ms").alias("end_ms"), pick(F.trim(F.concat(F.rtrim("english_text"), F.lit(" "), F.ltrim("nxt.english_text"))), "english_text").alias("english_text"), pick(F.nullif(parts, F.lit("")), "chinese_text").alias("chinese_text"), pick(same, "translation_source").alias("translation_source"))


_FOLDED = [("video_id", pa.string()), ("island", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("first_idx", pa.int64()), ("last_idx", pa.int64())]
_Row = tuple[int, int, str]  # start, end, text


def _folded(rows: DataFrame, island: Column, joins: Callable[[_Row, _Row], bool], sums: tuple[str, ...] = ()) -> DataFrame:
    """Ordered fold of each island: the row being built absorbs the next while ``joins`` holds. One open row is kept.

    ``island`` is a window by video, which leaves a video's rows together and in order, so that they are not moved again.
    ``last_idx`` is that of the last row, or its own column if ``rows`` has one; columns of ``sums`` (numbers) are added up.
    """
    kinds = [*_FOLDED, *((c, pa.float64()) for c in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        done: list[list] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done), kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for video, part, idx, start, end, text, last, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and (video, part) == (open_[0], open_[1]) and None not in (text, open_[4]) and joins(tuple(open_[2:5]), (start, end, text)):
                    open_[3:5], open_[6] = [end, f"{open_[4].rstrip()} {text.lstrip()}"], last
                    open_[7:] = [a + b for a, b in zip(open_[7:], more)]
                else:
                    if open_:
                        done.append(open_)
                    open_ = [video, part, start, end, text, idx, last, *more]
            if done:
                yield out()
                done = []
        if open_:
            done.append(open_)
            yield out()

    last = F.col("last_idx" if "last_idx" in rows.columns else "idx").cast("long").alias("last_idx")
    given = rows.select("video_id", island.cast("long").alias("island"), F.col("idx").cast("long"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "text", last, *[F.col(c).cast("double") for c in sums])
    schema = "video_id string, island long, start_ms long, end_ms long, text string, first_idx long, last_idx long" + "".join(f", {c} double" for c in sums)
    merged = given.sortWithinPartitions("video_id", "idx").mapInArrow(run, schema)
    return merged.withColumn("text", X.collapse(F.col("text"))).drop("island")


def _fold(rows: DataFrame, island: Column, joins: Callable[[_Row, _Row], bool]) -> DataFrame:
    """``_folded``, numbered from 1 in each video."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("first_idx")).cast("long")
    return _folded(rows, island, joins).select("video_id", number.alias("idx"), "start_ms", "end_ms", "text", "first_idx", "last_idx")


def _both(one: str, two: str) -> str:
    return f"{one.rstrip()} {two.lstrip()}"


def _joins_v1(cur: _Row, nxt: _Row) -> bool:
    """A short text that is no sentence, and what follows soon."""
    text, more = cur[2].strip(), nxt[2].strip()
    short = len(text.split()) <= 3 or len(text) <= 24
    return bool(text and more) and short and not X.stops(text) and nxt[0] - cur[1] <= 1500 and len(_both(cur[2], nxt[2])) <= 140


def _joins_v2(cur: _Row, nxt: _Row) -> bool:
    """A text that is no sentence and something that belongs to it, within the limits of a caption."""
    text, more, both = cur[2].strip(), nxt[2].strip(), _both(cur[2], nxt[2])
    if not text or not more or X.stops(text) or nxt[0] - cur[1] > R.FORCED_GAP_MS:
        return False
    if nxt[1] - cur[0] > R.MAX_MS or len(both) > R.MAX_CHARS or len(both.split()) > R.MAX_WORDS:
        return False
    return len(more.split()) <= 2 or X.goes_on(more) or X.unfinished(text)


def _joins_sentence(cur: _Row, nxt: _Row) -> bool:
    """Anything, up to a sentence end or a limit."""
    return not X.stops(cur[2]) and cur[1] - cur[0] < R.MAX_MS and len(cur[2]) < R.MAX_CHARS


def merge_incomplete(captions: DataFrame, rules: str = "v2", ranges: bool = False) -> DataFrame:
    """Unfinished captions absorb what follows within limits. Nothing crosses a finished sentence, so islands end there.

    With ``ranges`` a row also has ``first_idx`` and ``last_idx`` of the captions that it is made of.
    """
    rows, island = _sentences(captions)
    folded = _fold(rows, island, {"v1": _joins_v1, "v2": _joins_v2}[rules])
    return folded if ranges else folded.drop("first_idx", "last_idx")


def _sentences(captions: DataFrame) -> tuple[DataFrame, Column]:
    """Captions with a flag after a sentence end, and the number of their island by it."""
    done = F.coalesce(F.lag(X.ends_sentence(F.col("text"))).over(by_video()), F.lit(False))
    return captions.withColumn("__begins", done), F.sum(F.when(F.col("__begins"), 1).otherwise(0)).over(by_video())


def absorb_incomplete(captions: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """``merge_incomplete`` without numbers: ``video_id``, times, text, ``first_idx``, ``last_idx`` and sums of number columns."""
    return _folded(*_sentences(captions), _joins_v2, sums)


def merge_sentences(segments: DataFrame) -> DataFrame:
    """Recogniser segments joined up to a sentence end, 12 s or 160 characters, then overlong ones split."""
    rows = segments.where(~X.is_blank(F.col("text"))).withColumn("text", X.stripped(F.col("text")))
    rows, island = _sentences(rows)
    return split_overlong(_fold(rows, island, _joins_sentence).drop("first_idx", "last_idx"))


def split_overlong(captions: DataFrame) -> DataFrame:
    """Captions above 160 characters cut after ``,;:`` into pieces packed up to that length; time goes by characters (ms, floored)."""
    pieces = "split(text, '(?<=[,;:])\\\\s+')"
    packed = f"aggregate(slice({pieces}, 2, greatest(size({pieces}) - 1, 0)), slice({pieces}, 1, 1), (a, x) -> if(length(element_at(a, -1)) + 1 + length(x) <= {R.MAX_CHARS}, array_append(slice(a, 1, size(a) - 1), concat(element_at(a, -1), ' ', x)), array_append(a, x)))"
    rows = captions.withColumn("parts", F.when(F.length("text") <= R.MAX_CHARS, F.array("text")).otherwise(F.expr(packed)))
    upto = lambda k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0), lambda a, t: a + F.length(t))
    whole = upto(F.size("parts"))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * upto(k) / whole)
    out = rows.select("video_id", "idx", "start_ms", "end_ms", "parts", F.posexplode("parts").alias("k", "part"))
    cut = F.size("parts") > 1
    out = out.select("video_id", "idx", "k", F.when(cut, at(F.col("k"))).otherwise(F.col("start_ms")).alias("start_ms"), F.when(cut, at(F.col("k") + 1)).otherwise(F.col("end_ms")).alias("end_ms"), F.col("part").alias("text"))
    return out.withColumn("idx", F.row_number().over(Window.partitionBy("video_id").orderBy("idx", "k")).cast("long")).drop("k")


def caption_at(positions: DataFrame, captions: DataFrame, offsets: DataFrame | None = None, bin_ms: int = 10_000) -> DataFrame:
    """Adds ``position_index``: the last caption (0-based) with start <= position < end, -1 for none.

    A range join by bins: a caption goes to each bin of 10 s that it touches, a position to its own, so both sides meet
    on (video, bin) and a long video is spread over tasks.
    """
    moved = shift_captions(captions, offsets) if offsets is not None else captions
    bins = moved.select("video_id", "idx", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms))).alias("bin")).where("end_ms > start_ms")
    asked = positions.withColumn("bin", F.floor(F.col("position_ms") / bin_ms))
    keys = asked.select("video_id", "position_ms", "bin").distinct()
    hit = keys.join(bins, ["video_id", "bin"]).where("start_ms <= position_ms and position_ms < end_ms").groupBy("video_id", "position_ms").agg((F.max("idx") - 1).alias("position_index"))
    return positions.join(hit, ["video_id", "position_ms"], "left").withColumn("position_index", F.coalesce("position_index", F.lit(-1)).cast("long"))


def track_report(tracks: DataFrame) -> DataFrame:
    """Per video: longest video and audio track, whether audio outlasts video by over 5 s, and the safe end of playback."""
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("duration_ms")))
    rows = tracks.groupBy("video_id").agg(longest("video").alias("video_ms"), longest("audio").alias("audio_ms"))
    return rows.withColumns({"audio_outlasts": F.coalesce(F.col("audio_ms") - F.col("video_ms") > 5000, F.lit(False)), "safe_end_ms": F.greatest(F.col("video_ms") - 500, F.lit(0))})


def inference_context(videos: DataFrame) -> DataFrame:
    """Adds ``prompt`` and ``hotwords`` made of a video's title, with outdoor terms if a stem of them occurs."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), r"[_\s]+", " "), r"(?i)\.(mp4|m4a|mov|mkv|webm)$", ""))
    outdoor = title.rlike(r"(?i)\b(hik|backpack|camp|trail|mountain|outdoor|gear|trek|switzerland|pakistan)\w*\b")
    said, terms = F.when(title != "", F.concat(F.lit("The video title is: "), title, F.lit("."))), F.when(outdoor, F.lit("Use accurate outdoor, hiking, camping and ultralight gear terminology."))
    return videos.withColumns({"prompt": F.nullif(F.concat_ws(" ", said, terms), F.lit("")), "hotwords": F.nullif(F.concat_ws(", ", F.nullif(title, F.lit("")), F.when(outdoor, F.lit("hiking, camping, backpacking, trail"))), F.lit(""))})
