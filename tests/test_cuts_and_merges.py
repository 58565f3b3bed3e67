"""Greedy cuts, merges and reports by golden rows and brute force; places in words; text helpers in columns and in Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexitide.functions import models as M
from lexitide.functions import rules as R
from lexitide.functions import text as X
from lexitide.operators import captions as C
from lexitide.operators import segmentation as G

WORDS = "video_id string, idx long, start_ms long, end_ms long, text string, segment_end boolean, segment_complete boolean"
CAPTIONS = "video_id string, idx long, start_ms long, end_ms long, text string"


def words(text, step=350, pauses={}, lasts=280):
    at, rows = 0, []
    for i, w in enumerate(text.split()):
        rows.append(("v", i, at, at + lasts, w, False, False))
        at += step + pauses.get(i, 0)
    return rows


def cuts(spark, rows, rules="v2"):
    return sorted((r.word_start, r.word_end) for r in G.greedy_segments(spark.createDataFrame(rows, WORDS), rules).collect())


def test_v1_cuts_at_sentence_ends_and_two_limits(spark):
    assert cuts(spark, words("One two. Three four! five \"six.\" seven"), "v1") == [(0, 2), (2, 4), (4, 6), (6, 7)]
    long = cuts(spark, words(" ".join(["word"] * 60)), "v1")  # 280 ms + 39 * 350 ms = 13.93 s, so the 41st word passes 14 s; 36 words have 179 characters
    assert long == [(0, 37), (37, 60)]
    slow = cuts(spark, words("a " * 30, step=1000), "v1")
    assert slow == [(0, 15), (15, 30)]


def test_breaks_of_v2(spark):
    text = "one two three four five six seven eight nine ten"
    assert cuts(spark, words(text)) == [(0, 10)]
    assert cuts(spark, words(text, pauses={4: 1200})) == [(0, 5), (5, 10)]  # a forced silence
    assert cuts(spark, words(text, pauses={1: 1200})) == [(0, 10)]  # two words are too few
    assert cuts(spark, words(text.replace("five", "with"), pauses={4: 1200})) == [(0, 10)]  # a weak ending
    assert cuts(spark, words(text.replace("six", R.CONTINUATIONS[0]), pauses={4: 1200}))[0] == (0, 10)  # what follows continues
    assert cuts(spark, words(text, step=1000, pauses={6: 500})) == [(0, 7), (7, 10)]  # 6.28 s, a gap of 1.22 s
    assert cuts(spark, words(text.replace("six", "six,"), step=1000, pauses={5: 300}, lasts=900))[0] == (0, 6)  # a clause of the aimed length and a soft silence


def test_overlong_runs_are_cut_at_the_best_place(spark):
    text = " ".join(["word"] * 12 + ["end,"] + ["more"] * 30)
    assert cuts(spark, words(text))[0] == (0, 13)
    assert all(b - a <= 30 for a, b in cuts(spark, words(text)))


def merged(spark, rows, **kw):
    return [(r.start_ms, r.end_ms, r.text) for r in C.merge_incomplete(spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], CAPTIONS), **kw).orderBy("idx").collect()]


def test_merges_of_v1(spark):
    rows = [(0, 900, "So we went"), (1000, 2000, "to the lake in the hills."), (2100, 3000, "Then"), (4501, 5000, "later on"), (5100, 6000, "x" * 130), (7500, 8000, "a rather long text of words"), (8100, 8200, "end")]
    assert merged(spark, rows, rules="v1") == [(0, 2000, "So we went to the lake in the hills."), (2100, 3000, "Then"), (4501, 6000, "later on " + "x" * 130), (7500, 8000, "a rather long text of words"), (8100, 8200, "end")]


def test_merges_of_v2(spark):
    rows = [(0, 900, "We were going"), (1000, 2000, "home with our old friends"), (2100, 2500, "at last."), (2600, 3000, "All of the things"), (4201, 4500, "we saw there")]
    assert merged(spark, rows) == [(0, 2500, "We were going home with our old friends at last."), (2600, 3000, "All of the things"), (4201, 4500, "we saw there")]


def test_sentences_are_merged_up_to_limits(spark):
    rows = [("v", 0, 0, 3000, "One part"), ("v", 1, 3000, 5000, " of a sentence."), ("v", 2, 5000, 18000, "a long one"), ("v", 3, 18000, 19000, "apart"), ("v", 4, 19000, 19500, " "), ("w", 0, 0, 1000, "z " * 85), ("w", 1, 1000, 2000, "rest")]
    got = [(r.video_id, r.idx, r.start_ms, r.end_ms, r.text) for r in C.merge_sentences(spark.createDataFrame(rows, CAPTIONS)).orderBy("video_id", "idx").collect()]
    assert got == [("v", 1, 0, 5000, "One part of a sentence."), ("v", 2, 5000, 18000, "a long one"), ("v", 3, 18000, 19000, "apart"), ("w", 1, 0, 1000, ("z " * 85).strip()), ("w", 2, 1000, 2000, "rest")]


def test_a_long_island_takes_linear_time(spark):
    rows = spark.range(100_000).selectExpr("'v' video_id", "id idx", "id * 400 start_ms", "id * 400 + 300 end_ms", "'and so on' text")
    begun = time.time()
    assert C.merge_incomplete(rows).agg(F.max("end_ms")).first()[0] == 99_999 * 400 + 300
    assert C.merge_sentences(rows).count() > 3000
    assert time.time() - begun < 30


def test_python_helpers_are_the_columns(spark):
    rng = random.Random(2)
    pool = ["going", "and", "When", "because", "the", "of", "end.", 'stop!"', "so,", "it's", "　", " with ", "'but", "-", "日本", "x)", "a;"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = X.stripped(F.col("t"))
    rows = table.select("i", X.ends_sentence(t).alias("stops"), X.incomplete(t).alias("unfinished"), X.continues(F.col("t")).alias("goes_on"), X.joined(F.split("t", " ")).alias("joined"), X.is_blank(F.col("t")).alias("blank")).collect()
    for r in rows:
        own = texts[r.i]
        assert (r.stops, r.unfinished, r.goes_on) == (X.stops(own), X.unfinished(own.strip()), X.goes_on(own)), own
        assert r.joined == X.tidied(own.split(" ")) and r.blank == (not own.strip()), own


def test_reports(spark):
    names = list(G.cost_parts())
    rows = [tuple([5, -7, *[0] * (len(names) - 2)]), tuple([1, 0, *[0] * (len(names) - 3), 4])]
    out = {r.part: (r.n, r.total) for r in G.cost_report(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))).collect()}
    assert out == {names[0]: (2, 6), names[1]: (1, -7), names[-1]: (1, 4)}
    made = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "video_id string, used_fallback boolean")
    counts = spark.createDataFrame([(v,) for v in "aaabbc"], "video_id string")
    gone = spark.createDataFrame([("b",), ("b",)], "video_id string")
    assert sorted(map(tuple, G.segmentation_summary(made, counts, gone).select("video_id", "word_count", "segment_count", "removed_orphans", "used_fallback").collect())) == [("a", 3, 2, 0, True), ("b", 2, 1, 2, False), ("c", 1, 0, 0, False)]


def test_the_summary_agrees_with_the_tables(spark):
    from lexitide.plans import fixtures, segmentation_queries as Q

    sf = "/root/testdata/sf0.001"
    words_of = {r.video_id: r.n for r in Q.blocks(spark, sf).groupBy("video_id").agg(F.count("*").alias("n")).collect()}
    captions = {r.video_id: r.n for r in G.segment_corpus(fixtures.words(spark, sf)).groupBy("video_id").agg(F.count("*").alias("n")).collect()}
    out = Q.QUERIES["agg6_segmentation_summary"](spark, sf).collect()
    assert {r.video_id: r.word_count for r in out} == words_of and {r.video_id: r.segment_count for r in out if r.segment_count} == captions
    report = {r.part: r for r in Q.QUERIES["agg5_cost_report"](spark, sf).collect()}
    total = Q.QUERIES["win7_optimize_segments"](spark, sf).where("word_start >= 0").agg(F.sum("cost")).first()[0]
    assert sum(r.total for r in report.values()) == total and set(report) <= set(G.cost_parts())


def test_places_in_words(spark):
    w = spark.createDataFrame([("v", 0, 0, "ab"), ("v", 0, 1, "c"), ("v", 1, 2, "def")], "video_id string, chunk_id long, idx long, text string")
    asked = [("v", 0, p) for p in (0, 1, 2, 3, 4, 5)] + [("v", 1, p) for p in (0, 2, 3, 4, -1)] + [("x", 0, 0), ("v", 0, 3)]
    out = G.locate_words(w, spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "video_id string, chunk_id long, position long, tag int"))
    assert [r.word for r in out.orderBy("tag").collect()] == [0, 0, None, 1, 1, None, 2, 2, 2, None, None, None, 1]


def test_scores_of_models_that_fail(spark):
    w = spark.createDataFrame([("v", 0, 0, "ab"), ("v", 0, 1, "c"), ("v", 1, 2, "def"), ("v", 1, 3, "g")], "video_id string, chunk_id long, idx long, text string")

    def scores(text):
        if "d" in text:
            raise ValueError("no")
        return [0.1, float("nan"), 0.3, 7.0]

    def tags(text):
        if "a" in text:
            raise ValueError("no")
        return [(0, 4, "det", "DET"), (4, 4, "root", "NOUN")], [(0, 9)]

    texts = G.chunk_texts(w)
    out = G.boundary_scores(w, M.score_boundaries(texts, scores), M.tag_chunks(texts, tags)).orderBy("idx").collect()
    assert [tuple(r)[1:] for r in out] == [(0, 0.0, False), (1, 0.0, False), (2, 0.0, False), (3, 0.0, True)]


def test_scored_cuts_are_the_least_cost(spark):
    """The fast cut with scores costs what the written-out candidates cost, and scores move cuts."""
    from lexitide.plans import fixtures, segmentation_queries as Q

    w = G.normalize_words(fixtures.words(spark, "/root/testdata/sf0.001").where("cast(video_id as int) < 25"))
    blocks = G.hard_blocks(G.boundary_features(w))
    chunks = G.analysis_chunks(G.boundary_features(w)).select("video_id", "chunk_id", "idx", "text")
    texts = G.chunk_texts(chunks)
    scores = G.boundary_scores(chunks, M.score_boundaries(texts, Q.stub_characters), M.tag_chunks(texts, Q.stub_tagger)).checkpoint()
    fast = {(r.video_id, r.block_id): r.cost for r in G.least_cost_cuts(blocks, scores).groupBy("video_id", "block_id").agg(F.sum("cost").alias("cost")).collect()}
    slow = G.optimize_segments(G.candidate_costs(G.segment_candidates(blocks), blocks, scores)).groupBy("video_id", "block_id").agg(F.sum("cost").alias("cost"))
    slow = {(r.video_id, r.block_id): r.cost for r in slow.collect()}
    assert slow and all(fast[k] == slow[k] for k in slow)
    plain = {(r.video_id, r.word_start) for r in G.least_cost_cuts(blocks).collect()}
    assert plain != {(r.video_id, r.word_start) for r in G.least_cost_cuts(blocks, scores).collect()}


@pytest.mark.parametrize("tokens, text", [(["Hello", ",", "world", "."], "Hello, world."), (["it", "’S", "a", "well", "-", "known", "do", "n't"], "it’S a well-known don't"), (["　", "a", "b　c"], "a b c"), ([], "")])
def test_joined_tokens(spark, tokens, text):
    assert X.tidied(tokens) == text
    assert spark.createDataFrame([(tokens,)], "t array<string>").select(X.joined(F.transform("t", lambda t: X.stripped(t)))).first()[0] == text


def test_white_space_is_the_same_everywhere():
    assert [c for c in map(chr, range(0x3001)) if c.isspace()] == [c for c in map(chr, range(0x3001)) if re.fullmatch(X.PYTHON_WHITE, c)]

def test_words_scored_in_one_step_are_those_of_the_tables(spark):
    """Of random chunks, models and failures, with gaps in numbers and places outside of words."""
    import random

    def model(text):
        rng = random.Random(text)
        return rng, len(text)

    def scores(text):
        rng, n = model(text)
        if rng.random() < 0.2:
            raise ValueError("no")
        return [rng.choice([float("nan"), -1.0, 0.25, 0.5, 3.0]) for _ in range(n - rng.randrange(4))]

    def tags(text):
        rng, n = model(text)
        if rng.random() < 0.2:
            raise ValueError("no")
        at = lambda: rng.choice([None, *range(-1, n + 2)])
        return [(at(), at(), rng.choice(["det", "root", None]), rng.choice(["DET", "NOUN", "ADJ", None])) for _ in range(rng.randrange(3 * n))], [(at(), at()) for _ in range(rng.randrange(6))]

    rng, rows = random.Random(7), []
    for v in "abcdefghijklmno":
        at = 0
        for chunk in range(3):
            for _ in range(rng.randrange(1, 9)):
                at += rng.choice([1, 1, 1, 2, 5])
                rows.append((v, chunk, at, rng.choice(["a", "bc", "d e", "fghij"]) + v * rng.randrange(2)))
    words = spark.createDataFrame(rows, "video_id string, chunk_id long, idx long, text string").repartition(3)
    chunks = G.chunk_texts(words)
    want = sorted(map(tuple, G.boundary_scores(words, M.score_boundaries(chunks, scores), M.tag_chunks(chunks, tags)).collect()))
    made = G.scored_words(words.withColumn("more", F.col("idx") * 2), scores, tags)
    got = sorted(map(tuple, made.select("video_id", "idx", "boundary_probability", "protected").collect()))
    assert got == want and {r[3] for r in got} == {True, False} and {r[2] for r in got} == {0.0, 0.25, 0.5, 1.0}
    assert sorted(map(tuple, made.select("video_id", "chunk_id", "idx", "text", "more").collect())) == sorted((*r, 2 * r[2]) for r in rows)


def test_models_on_the_way_cut_as_scores_do(spark):
    from lexitide.plans import fixtures, segmentation_queries as Q

    w = fixtures.words(spark, "/root/testdata/sf0.001").where("cast(video_id as int) < 60 and idx % 97 <> 5")  # numbers have gaps
    scores = Q.S.scored_words(G.analysis_chunks(G.boundary_features(G.normalize_words(w))), Q.stub_characters, Q.stub_tagger)
    one, two = (sorted(map(str, G.segment_corpus(w, **how).collect())) for how in ({"scores": scores}, {"models": (Q.stub_characters, Q.stub_tagger)}))
    assert one == two and one != sorted(map(str, G.segment_corpus(w).collect()))


@pytest.mark.parametrize("scored", [False, True])
def test_totals_of_candidates_are_those_of_the_written_ones(spark, scored):
    """Of words with odd spacing, gaps in numbers, ends out of order and blocks of one word."""
    import random

    rng, rows = random.Random(5), []
    for v in "abcdef":
        at = idx = 0
        for _ in range(rng.randrange(1, 120)):
            idx, at = idx + rng.choice([1, 1, 1, 3]), at + rng.choice([100, 350, 700, 1900])
            rows.append((v, idx, at, at + rng.choice([5, 280, 2000, 12500]), rng.choice(["we", "of", "going", ",", "-", "'s", "n't", "a , b", "done.", "x" * 60, "4"]), 0.5, rng.random() < 0.1, rng.random() < 0.1))
    words = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string, probability double, segment_end boolean, segment_complete boolean")
    blocks = G.hard_blocks(G.boundary_features(G.normalize_words(words)))
    scores = words.select("video_id", "idx", (F.col("idx") % 10 / 10).alias("boundary_probability"), (F.col("idx") % 3 == 0).alias("protected")) if scored else None
    each = G.candidate_costs(G.segment_candidates(blocks), blocks, scores)
    sums = [F.count("*").alias("n"), F.max("word_end").alias("last_end"), F.sum("duration_ms").alias("durations"), F.sum(F.length("text")).alias("chars"), F.sum("cost").alias("cost"), F.min("cost").alias("least")]
    want = sorted(map(tuple, each.groupBy("video_id", "word_start").agg(*sums).collect()))
    assert sorted(map(tuple, G.candidate_totals(blocks, scores, costs=True).collect())) == want and len(want) > 100
    assert sorted(map(tuple, G.candidate_totals(blocks).collect())) == [r[:6] for r in want]


@pytest.mark.parametrize("name", ["win5_segment_candidates", "win6_candidate_costs"])
def test_no_candidate_is_written_out(spark, name):
    from lexitide.plans import segmentation_queries as Q

    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("Exchange ") == 1  # a text's words, which stay where it is


def test_runs_of_an_island_are_judged_by_their_words(monkeypatch):
    """The same as of the whole text, which is written out only where its spacing is repaired."""
    import random

    rng, known = random.Random(3), ["even", "though", "if", "we", "the", "going", "lake,", "it;", "4", "\"", "so:\"", "Because", "done", "n't", "-", ",", "a b", "’S", "when)"]
    for odd in (False, True):
        for _ in range(200):
            text = [t for t in (rng.choice(known[: 19 if odd else 13]) for _ in range(rng.randrange(1, 9)))]
            island = G._Island([("v", 0, i, 400 * i, 400 * i + 300, t, False, False) for i, t in enumerate(text)])
            for a in range(len(text)):
                for b in range(a + 1, len(text) + 1):
                    whole = X.tidied(text[a:b])
                    assert (island.string(a, b), island.length(a, b), island.unfinished(a, b)) == (whole, len(whole), X.unfinished(whole)), text[a:b]
    calls = []
    monkeypatch.setattr(X, "tidied", lambda tokens: calls.append(1) or " ".join(tokens))
    island = G._Island([("v", 0, i, 300 * i, 300 * i + 200, f"word{i}", False, False) for i in range(400)])
    assert sum(b - a for a, b in island.cuts(False)) == 400 and not calls
