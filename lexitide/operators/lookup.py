"""Dictionary and phrase look-up, and spans of terms in captions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases of more bytes than this do not travel to every task.
SHIPPED_BYTES = 16 << 20
_TERM = re.compile(r"[A-Za-z][A-Za-z'\-]*")

# Forms that have a base form of their own: form, base form, what the form is.
IRREGULAR = [
    ("am", "be", "第一人称单数"),
    ("is", "be", "第三人称单数"),
    ("are", "be", "现在时"),
    ("was", "be", "过去式"),
    ("were", "be", "过去式"),
    ("been", "be", "过去分词"),
    ("being", "be", "现在分词"),
    ("has", "have", "第三人称单数"),
    ("had", "have", "过去式或过去分词"),
    ("does", "do", "第三人称单数"),
    ("did", "do", "过去式"),
    ("done", "do", "过去分词"),
    ("went", "go", "过去式"),
    ("gone", "go", "过去分词"),
    ("made", "make", "过去式或过去分词"),
    ("took", "take", "过去式"),
    ("taken", "take", "过去分词"),
    ("came", "come", "过去式"),
    ("saw", "see", "过去式"),
    ("seen", "see", "过去分词"),
    ("got", "get", "过去式或过去分词"),
    ("gave", "give", "过去式"),
    ("given", "give", "过去分词"),
    ("found", "find", "过去式或过去分词"),
    ("thought", "think", "过去式或过去分词"),
    ("knew", "know", "过去式"),
    ("known", "know", "过去分词"),
    ("said", "say", "过去式或过去分词"),
    ("told", "tell", "过去式或过去分词"),
    ("felt", "feel", "过去式或过去分词"),
    ("left", "leave", "过去式或过去分词"),
    ("kept", "keep", "过去式或过去分词"),
    ("heard", "hear", "过去式或过去分词"),
    ("caught", "catch", "过去式或过去分词"),
    ("bought", "buy", "过去式或过去分词"),
    ("brought", "bring", "过去式或过去分词"),
    ("wrote", "write", "过去式"),
    ("written", "write", "过去分词"),
    ("spoke", "speak", "过去式"),
    ("spoken", "speak", "过去分词"),
    ("ran", "run", "过去式"),
    ("ate", "eat", "过去式"),
    ("eaten", "eat", "过去分词"),
    ("wore", "wear", "过去式"),
    ("worn", "wear", "过去分词"),
    ("chose", "choose", "过去式"),
    ("chosen", "choose", "过去分词"),
    ("built", "build", "过去式或过去分词"),
    ("lost", "lose", "过去式或过去分词"),
    ("met", "meet", "过去式或过去分词"),
    ("stood", "stand", "过去式或过去分词"),
    ("understood", "understand", "过去式或过去分词"),
]
# Endings and what such a form is.
ENDINGS = {"ies": "复数或第三人称单数", "ing": "现在分词或动名词", "ied": "过去式或过去分词", "ed": "过去式或过去分词", "es": "复数或第三人称单数", "s": "复数或第三人称单数"}
# Words that only look inflected, and consonants that double before an ending.
NOT_INFLECTED = "news series species physics mathematics this his is was".split()
DOUBLED = "bdgmnprt"
# Texts where nothing is found.
NO_MEANING, NO_WORD, NO_PHRASE = "词典中有该词，但暂无中文释义。", "本地词典暂未收录。", "本地短语库暂未收录。可以尝试点击其中的单词查询。"


def cleaned(term: Column) -> Column:
    """A term as it is looked up: lower case, straight quotes, letters, quotes and hyphens with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(term), "[‘’‛′]", "'"), r"[^a-z'\-\s]", " "), r"\s+", " "))


def clean_terms(lookups: DataFrame, column: str = "term") -> DataFrame:
    return lookups.withColumn(column, cleaned(F.col(column)))


def load_dictionary(entries: DataFrame) -> DataFrame:
    """Entries with escapes undone; the meaning is the translation, else the definition, else a fixed text."""
    undo = lambda c: F.trim(F.regexp_replace(F.replace(F.replace(F.replace(c, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" ")), "[ \t]+", " "))
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    return entries.select("word", F.coalesce("phonetic", F.lit("")).alias("phonetic"), undo(F.coalesce(given("translation"), given("definition"), F.lit(NO_MEANING))).alias("meaning"), undo(F.coalesce("definition", F.lit(""))).alias("definition"))


def first_lines(text: Column, lines: int, chars: int) -> Column:
    kept = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != ""), 1, lines)
    return F.left(F.array_join(kept, "\n"), F.lit(chars))


def summarize_entries(dictionary: DataFrame) -> DataFrame:
    """Meanings of five lines and 360 characters at most, definitions of three and 420."""
    return dictionary.withColumns({"meaning": first_lines(F.col("meaning"), 5, 360), "definition": first_lines(F.col("definition"), 3, 420)})


def lemma_candidates(term: Column) -> Column:
    """Base forms to try, in order. Irregular forms have one; words that only look inflected have none."""
    cut = lambda n: F.left(term, F.length(term) - n)
    ends = lambda e, n: term.endswith(e) & (F.length(term) > n)

    def undoubled(stem: Column) -> Column:
        last = F.right(stem, F.lit(1))
        twice = (F.length(stem) > 2) & (last == F.substring(F.right(stem, F.lit(2)), 1, 1)) & last.isin(list(DOUBLED))
        return F.when(twice, F.left(stem, F.length(stem) - 1))

    forms = F.create_map(*[F.lit(x) for form, base, _ in IRREGULAR for x in (form, base)])
    none = F.array().cast("array<string>")
    regular = (
        F.when(ends("ies", 4), F.array(F.concat(cut(3), F.lit("y"))))
        .when(ends("ing", 5), F.array(undoubled(cut(3)), cut(3), F.concat(cut(3), F.lit("e"))))
        .when(ends("ied", 4), F.array(F.concat(cut(3), F.lit("y"))))
        .when(ends("ed", 4), F.array(undoubled(cut(2)), cut(2), cut(1)))
        .when(ends("es", 4), F.array(cut(2), cut(1)))
        .when(ends("s", 3), F.array(cut(1)))
        .otherwise(none)
    )
    known = F.try_element_at(forms, term)
    return F.when(known.isNotNull(), F.array(known)).when(term.isin(NOT_INFLECTED), none).otherwise(F.filter(F.array_distinct(regular), lambda c: c.isNotNull() & (c != term)))


def inflection(term: Column) -> Column:
    """What kind of form a term is that has base forms to try."""
    irregular = F.try_element_at(F.create_map(*[F.lit(x) for form, _, label in IRREGULAR for x in (form, label)]), term)
    return F.coalesce(irregular, *[F.when(term.endswith(end), label) for end, label in ENDINGS.items()])


def guess_lemma(term: Column) -> Column:
    """The one base form that a plain look-up tries: any doubled letter is undone, and no ``e`` is added."""
    cut = lambda n: F.left(term, F.length(term) - n)
    stem = cut(3)
    short = F.when((F.length(stem) > 2) & (F.right(stem, F.lit(1)) == F.substring(F.right(stem, F.lit(2)), 1, 1)), cut(4)).otherwise(stem)
    ends = lambda e, n: term.endswith(e) & (F.length(term) > n)
    return F.when(ends("ies", 4), F.concat(cut(3), F.lit("y"))).when(ends("ing", 5), short).when(ends("ed", 4), cut(2)).when(ends("es", 4), cut(2)).when(ends("s", 3), cut(1)).otherwise(term)


def lookup_terms(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row for each distinct cleaned single word of ``term``: the first base form that the dictionary has, else the word.

    Where a base form answers, ``lemma`` is that form and ``inflection`` says what form of it the term is; else both are null.
    ``dictionary`` comes from ``load_dictionary``. Distinct terms are joined with it by key; Spark chooses the join by size.
    """
    asked = clean_terms(terms).select("term").where("term <> '' and not contains(term, ' ')").distinct()
    tries = asked.select("term", F.posexplode(lemma_candidates(F.col("term"))).alias("pos", "word"))
    base = tries.join(dictionary, "word").groupBy("term").agg(F.min_by(F.struct(F.col("word").alias("lemma"), "phonetic", "meaning", "definition"), "pos").alias("b"))
    exact = dictionary.select(F.col("word").alias("term"), F.struct("phonetic", "meaning", "definition").alias("e"))
    guess = dictionary.select(F.col("word").alias("guess"), F.struct("phonetic", "meaning", "definition").alias("g"))
    rows = asked.join(base, "term", "left").join(exact, "term", "left").withColumn("guess", guess_lemma(F.col("term"))).join(guess, "guess", "left")
    has_b, has_e, has_g = (F.col(c).isNotNull() for c in "beg")
    short = lambda b, e, g, none: F.when(has_b, b).when(has_e, e).when(has_g, g).otherwise(F.lit(none))
    spoken = F.when(F.trim(F.coalesce("e.phonetic", F.lit(""))) != "", F.col("e.phonetic")).otherwise(F.col("b.phonetic"))
    return rows.select(
        "term",
        short(spoken, F.col("e.phonetic"), F.col("g.phonetic"), "").alias("phonetic"),
        short(first_lines(F.col("b.meaning"), 5, 360), first_lines(F.col("e.meaning"), 5, 360), F.concat(F.col("g.meaning"), F.lit("\n原形："), F.col("guess")), NO_WORD).alias("meaning"),
        short(first_lines(F.col("b.definition"), 3, 420), first_lines(F.col("e.definition"), 3, 420), F.col("g.definition"), "").alias("definition"),
        F.col("b.lemma").alias("lemma"),
        F.when(has_b, inflection(F.col("term"))).alias("inflection"),
    )


def lookup_phrases(terms: DataFrame, phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row for each distinct cleaned term of several words: phrase table, then dictionary, else a fixed text."""
    asked = clean_terms(terms).select("term").where("contains(term, ' ')").distinct()
    rows = asked.join(phrases.select(F.col("phrase").alias("term"), F.col("meaning").alias("p")), "term", "left").join(dictionary.select(F.col("word").alias("term"), F.col("meaning").alias("d")), "term", "left")
    return rows.select("term", F.coalesce("p", "d", F.lit(NO_PHRASE)).alias("meaning"))


def annotate_terms(captions: DataFrame, phrases: DataFrame, shipped: int = SHIPPED_BYTES) -> DataFrame:
    """Spans of phrases (longest first, then leftmost, none over another) and of the words that are left.

    Columns ``video_id, idx, start, end, term, kind``. A phrase begins with a word and counts between word boundaries. All
    phrases are found in one pass over a text by an automaton, which every task has while the phrases together have at most
    ``shipped`` bytes. Above that words meet phrases by the phrase's first word, and only where that word occurs the whole
    phrase is compared with the text that follows.
    """
    known = phrases.select("phrase").where("phrase rlike '^\\\\w'").distinct()
    if known.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0] > shipped:
        return _annotated_by_join(captions, known)
    listed = captions.sparkSession.sparkContext.broadcast(sorted(r.phrase for r in known.collect()))
    rows = captions.select("video_id", "idx", "english_text", _folded(F.col("english_text")).alias("lower"))
    return rows.mapInArrow(partial(_annotated, listed), "video_id string, idx long, start int, end int, term string, kind string")


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[‘’‛′]", "'")


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _spans(found: Iterable[tuple[int, str]], text: str, lower: str) -> Iterator[tuple[int, int, str, str]]:
    """Spans of a text, of the phrases that end at these places: those on boundaries, long ones before short ones, then words."""
    good = []
    for last, phrase in found:
        start, end = last + 1 - len(phrase), last + 1
        if not (start and _word(lower[start - 1])) and (end < len(lower) and _word(lower[end])) != _word(phrase[-1]):
            good.append((start - end, start, end, phrase))
    used = bytearray(max(len(text), len(lower)))
    for _, start, end, phrase in sorted(good):
        if not any(used[start:end]):
            used[start:end] = b"\1" * (end - start)
            yield start, end, phrase, "phrase"
    for m in _TERM.finditer(text):
        if not any(used[m.start() : m.end()]):
            yield m.start(), m.end(), m[0], "word"


def _annotated(listed, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in listed.value:
        automaton.add_word(phrase, phrase)
    automaton.make_automaton()
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["video_id", "idx", "start", "end", "term", "kind"]
    for batch in batches:
        out: list[tuple] = []
        for video, idx, text, lower in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if text:
                out += [(video, idx, *x) for x in _spans(automaton.iter(lower) if listed.value else (), text, lower)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _annotated_by_join(captions: DataFrame, phrases: DataFrame) -> DataFrame:
    # word characters between boundaries; joined again they are the text
    cut = lambda c: F.split(c, r"(?<=\w)(?!\w)|(?<!\w)(?=\w)")
    rows = captions.select("video_id", "idx", "english_text", cut(_folded(F.col("english_text"))).alias("m"))
    known = phrases.withColumn("w", F.filter(cut(F.col("phrase")), lambda t: t != ""))
    known = known.select("phrase", F.get("w", F.lit(0)).alias("t"), F.size("w").alias("n"))
    tokens = rows.select("video_id", "idx", F.posexplode("m").alias("k", "t")).where(F.col("t").rlike(r"^\w"))
    tried = tokens.join(known, "t").groupBy("video_id", "idx").agg(F.collect_list(F.struct("k", "n", "phrase")).alias("tried"))  # a caption's words times phrases of one first word
    taken = rows.join(tried, ["video_id", "idx"], "left")
    hits = "filter(tried, c -> array_join(slice(m, c.k + 1, c.n), '') = c.phrase)"
    start = "aggregate(slice(m, 1, c.k), 0, (a, t) -> a + length(t))"
    spans = F.expr(f"array_sort(transform({hits}, c -> struct(-length(c.phrase) as order, {start} as start, {start} + length(c.phrase) as end, c.phrase as phrase)))")
    kept = F.expr("aggregate(spans, slice(spans, 1, 0), (a, x) -> if(exists(a, y -> y.start < x.end and x.start < y.end), a, array_append(a, x)))")
    taken = taken.withColumn("spans", spans).select("video_id", "idx", "english_text", kept.alias("kept"))
    pieces = F.split(F.col("english_text"), r"(?<![A-Za-z'\-])(?=[A-Za-z])|(?<=[A-Za-z'\-])(?![A-Za-z'\-])")
    place = F.expr("aggregate(m, cast(array() as array<struct<t: string, s: int>>), (a, x) -> array_append(a, struct(x as t, if(size(a) = 0, 0, element_at(a, -1).s + length(element_at(a, -1).t)) as s)))")
    singles = taken.withColumn("m", pieces).withColumn("m", place).withColumn("x", F.explode("m"))
    singles = singles.withColumn("term", F.regexp_extract("x.t", r"([A-Za-z][A-Za-z'\-]*)$", 1)).where("term <> ''")  # marks may stand before it
    singles = singles.withColumn("end", F.col("x.s") + F.length("x.t")).withColumn("start", F.col("end") - F.length("term"))
    free = F.coalesce(~F.exists("kept", lambda y: (y.start < F.col("end")) & (F.col("start") < y.end)), F.lit(True))
    one = singles.where(free).select("video_id", "idx", "start", "end", "term", F.lit("word").alias("kind"))
    many = taken.select("video_id", "idx", F.explode("kept").alias("y")).select("video_id", "idx", "y.start", "y.end", F.col("y.phrase").alias("term"), F.lit("phrase").alias("kind"))
    return many.unionByName(one)


def irregular_forms(spark) -> DataFrame:
    """The irregular forms as a table, for users who join it themselves."""
    return spark.createDataFrame(IRREGULAR, T.StructType().add("form", "string").add("lemma", "string").add("inflection", "string"))
