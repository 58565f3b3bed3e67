"""Plug points for a user's models. A model is a function over a batch; it is loaded by the caller's function, once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.operators.captions import apply_glossary, polish_translations

BATCH, ATTEMPTS = 16, 3


def translate(captions: DataFrame, model: Callable[[list[str]], list[str]], batch: int = BATCH, language: str = "en", provider: str = "local", style: str = "natural") -> DataFrame:
    """Captions with ``chinese_text`` from a model: glossary, batches of ``batch`` texts, up to three attempts, and
    then the rules by which translations are polished.

    Equal texts are translated once. Other languages than English and the provider ``none`` pass through. A batch that
    fails three times leaves its rows without translation.
    """
    if language != "en" or provider in ("", "none", "off"):
        return captions
    prepared = apply_glossary(captions, style)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str | None] = []
            texts = frame["prepared"].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                for attempt in range(ATTEMPTS):
                    try:
                        got = list(model(part))
                        break
                    except Exception:  # the model is the user's: its failure is a result, not ours
                        got = [None] * len(part)
                out += got if len(got) == len(part) else [None] * len(part)
            yield pd.DataFrame({"prepared": texts, "chinese_text": out})

    unlike = prepared.select("prepared").distinct().mapInPandas(run, "prepared string, chinese_text string")
    translated = prepared.drop("chinese_text").join(unlike, "prepared", "left").withColumn("__none", F.col("chinese_text").isNull())
    polished = polish_translations(translated, style=style)
    return polished.withColumn("chinese_text", F.when(F.col("__none"), "").otherwise(F.col("chinese_text"))).drop("prepared", "__none")


def transcribe(audio: DataFrame, model: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of audio rows (``video_id, content``): the model gives dicts of start, end (ms), text, probability, segment_id."""
    columns = ["video_id", "idx", "segment_id", "start_ms", "end_ms", "text", "probability"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(v, i, w.get("segment_id", 0), w["start"], w["end"], w["text"], w.get("probability")) for v, c in zip(frame["video_id"], frame["content"]) for i, w in enumerate(model(bytes(c)))]
            yield pd.DataFrame(rows, columns=columns)

    return audio.select("video_id", "content").mapInPandas(run, "video_id string, idx long, segment_id long, start_ms long, end_ms long, text string, probability double")


def transcribe_segments(audio: DataFrame, model: Callable[[bytes], list[dict]]) -> DataFrame:
    """Word and segment rows of audio rows (``video_id, content``) in one table, told apart by ``kind``.

    The model gives segments: dicts of start, end (ms), text, optionally avg_logprob, no_speech_prob, compression_ratio and
    temperature, and words: dicts of start, end, text, probability. White space in texts is collapsed. Blank words and
    blank segments give no row; words are numbered over the whole audio, and a segment has its first word and the one after
    its last. Rows without audio give none.
    """
    measures = ["avg_logprob", "no_speech_prob", "compression_ratio", "temperature"]
    columns = ["video_id", "kind", "idx", "segment_id", "start_ms", "end_ms", "text", "probability", *measures, "word_start", "word_end"]

    def rows(video: str, segments: list[dict]) -> Iterator[tuple]:
        n = 0
        for k, s in enumerate(segments):
            first = n
            for w in s.get("words") or []:
                if text := " ".join(w["text"].split()):
                    yield (video, "word", n, k, w["start"], w["end"], text, w.get("probability"), None, None, None, None, None, None)
                    n += 1
            if text := " ".join(s["text"].split()):
                yield (video, "segment", k, k, s["start"], s["end"], text, None, *(s.get(m) for m in measures), first, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for v, c in zip(frame["video_id"], frame["content"]) if c is not None for r in rows(v, model(bytes(c)))]
            yield pd.DataFrame(out, columns=columns).astype({"word_start": "Int64", "word_end": "Int64", **{m: "Float64" for m in ["probability", *measures]}})

    return audio.select("video_id", "content").mapInPandas(run, "video_id string, kind string, idx long, segment_id long, start_ms long, end_ms long, text string, probability double, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double, word_start long, word_end long")


def detect_language(audio: DataFrame, model: Callable[[bytes], str], force: str | None = None) -> DataFrame:
    """Adds ``language``, from the model or forced, and ``translates``: only English goes on to translation."""
    if force:
        return audio.withColumns({"language": F.lit(force), "translates": F.lit(force == "en")})

    @F.pandas_udf("string")
    def detected(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for content in frames:
            yield pd.Series([model(bytes(c)) for c in content], dtype=object)

    rows = audio.withColumn("language", detected("content"))
    return rows.withColumn("translates", F.coalesce(F.col("language") == "en", F.lit(False)))


def score_boundaries(chunks: DataFrame, model: Callable[[str], list[float]], ends_only: bool = False) -> DataFrame:
    """Scores of characters: ``video_id, chunk_id, position, score, error``. A failing model gives one row with its error.

    A chunk's scores are arrays until they are written out. With ``ends_only`` characters that no white space follows are
    left out, as ``boundary_scores`` asks for last characters of words and for no others, and arrays go to where the words are.
    """

    def scored(text: str) -> tuple[list[int] | None, list[float] | None, str | None]:
        try:
            got = [float(x) for x in model(text)]
        except Exception as e:  # the model is the user's: its failure is a result
            return None, None, f"{type(e).__name__}: {e}"
        if ends_only:
            at = [i for i in range(min(len(got), len(text) - 1)) if text[i + 1].isspace()]
            return at, [got[i] for i in at], None
        return list(range(len(got))), got, None

    @F.pandas_udf("position array<int>, score array<double>, error string")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            yield pd.DataFrame([scored(t) for t in texts], columns=["position", "score", "error"], dtype=object)

    made = chunks.select("video_id", "chunk_id", run("text").alias("m"))
    rows = (_by_video(made) if ends_only else made).select("video_id", "chunk_id", "m.error", F.explode_outer(F.arrays_zip("m.position", "m.score")).alias("x")).where("x is not null or error is not null")
    score = F.when(F.col("error").isNotNull(), 0.0).otherwise(F.coalesce("x.score", F.lit(float("nan"))))  # in an array no number comes as null
    return rows.select("video_id", "chunk_id", F.col("x.position").cast("long").alias("position"), score.alias("score"), "error")


def _by_video(rows: DataFrame) -> DataFrame:
    """Rows dealt by video, into as many parts as other shuffles have, so that they meet a video's words where these are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")


def tag_chunks(chunks: DataFrame, model: Callable[[str], tuple[list[tuple[int, int, str, str]], list[tuple[int, int]]]]) -> DataFrame:
    """Tokens and spans of chunk texts: ``video_id, chunk_id, token, start, head, dependency, pos, end, error``.

    The model gives tokens (first character, first character of the head, dependency, tag) and spans (first character, end)
    of a text. A span has null ``token`` and ``head``. A failing model gives one row with its error and nothing else. What the
    model says of a chunk travels as arrays, once, to where the words are, however often it is read.
    """
    names = ["start", "head", "dependency", "pos", "begin", "end", "error"]

    def tagged(text: str) -> tuple:
        try:
            tokens, spans = model(text)
            start, head, dependency, pos = map(list, zip(*tokens)) if tokens else ([], [], [], [])
            begin, end = map(list, zip(*spans)) if spans else ([], [])
            return start, head, dependency, pos, begin, end, None
        except Exception as e:  # the model is the user's: its failure is a result
            return None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("start array<int>, head array<int>, dependency array<string>, pos array<string>, begin array<int>, end array<int>, error string")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            yield pd.DataFrame([tagged(t) for t in texts], columns=names, dtype=object)

    m = _by_video(chunks.select("video_id", "chunk_id", run("text").alias("m"))).select("video_id", "chunk_id", "m.*")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = lambda c, name: F.col(c).cast("long").alias(name)
    tokens = m.select("video_id", "chunk_id", F.posexplode(F.arrays_zip("start", "head", "dependency", "pos")).alias("at", "x")).select("video_id", "chunk_id", whole("at", "token"), whole("x.start", "start"), whole("x.head", "head"), "x.dependency", "x.pos", none("long", "end"), none("string", "error"))
    spans = m.select("video_id", "chunk_id", F.explode(F.arrays_zip("begin", "end")).alias("x")).select("video_id", "chunk_id", none("long", "token"), whole("x.begin", "start"), none("long", "head"), none("string", "dependency"), none("string", "pos"), whole("x.end", "end"), none("string", "error"))
    failed = m.where("error is not null").select("video_id", "chunk_id", *[none("long", c) for c in ("token", "start", "head")], none("string", "dependency"), none("string", "pos"), none("long", "end"), "error")
    return tokens.unionByName(spans).unionByName(failed)
