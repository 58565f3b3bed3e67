"""Cuts of words into captions: golden rows, limits, and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from lexitide.functions import rules as R
from lexitide.functions import text as X
from lexitide.operators import captions as C
from lexitide.operators import segmentation as S

WORDS = "video_id string, idx long, segment_id long, start_ms long, end_ms long, text string, probability double, segment_end boolean, segment_complete boolean"


def words(spark, text, pauses=(), step=350, length=280, probability=0.95, video="v"):
    rows, at = [], 0
    for i, w in enumerate(text.split()):
        rows.append((video, i, 0, at, at + length, w, probability, False, False))
        at += step + (1500 if i in pauses else 0)
    return spark.createDataFrame(rows, WORDS)


def texts(df):
    return [r.text for r in df.orderBy("video_id", "word_start").collect()]


@pytest.mark.parametrize("tokens, text", [(["Hello", ",", "world", "!"], "Hello, world!"), (["it", "'s", "up", "-", "to", "you"], "it's up-to you"), (["do", "n't", "go"], "don't go"), (["4.0", "of"], "4.0 of"), ([], "")])
def test_caption_text(spark, tokens, text):
    assert spark.range(1).select(X.joined(F.array(*map(F.lit, tokens)).cast("array<string>"))).first()[0] == text


def test_no_cut_crosses_a_sentence_end_or_a_silence(spark):
    w = words(spark, "We walk up the hill today. I am here now and we go on to the lake with all of our gear because it is warm", pauses={12})
    out = S.segment_corpus(w).orderBy("word_start").collect()
    ends = {r.word_end for r in out}
    assert {6, 13} <= ends
    assert [r.word_start for r in out][1:] == [r.word_end for r in out][:-1] and out[0].word_start == 0 and out[-1].word_end == 26


def test_limits_hold_and_words_are_kept(spark):
    w = words(spark, " ".join(f"word{i}" for i in range(200)))
    out = S.segment_corpus(w).collect()
    assert all(r.end_ms - r.start_ms <= R.MAX_MS and r.word_end - r.word_start <= R.MAX_WORDS and len(r.text) <= R.MAX_CHARS for r in out)
    assert sum(r.word_end - r.word_start for r in out) == 200


def test_weak_endings_are_avoided(spark):
    out = texts(S.segment_corpus(words(spark, "we started walking early in the morning because the weather was going to be very hot and we wanted to reach the lake before noon with the whole group of friends")))
    assert all(t.split()[-1] not in R.FUNCTION_WORDS for t in out)


def test_same_cuts_under_any_partitioning(spark):
    w = words(spark, " ".join(f"w{i % 17}" for i in range(150)), pauses={30, 90}).unionByName(words(spark, "a short one.", video="u"))
    one = sorted(map(tuple, S.segment_corpus(w.coalesce(1)).collect()))
    assert one == sorted(map(tuple, S.segment_corpus(w.orderBy(F.rand(3)).repartition(7)).collect()))


def test_a_word_beyond_the_limits_falls_back(spark):
    out = S.segment_corpus(words(spark, "x" * 200 + " and then more words follow here")).collect()
    assert out and all(r.used_fallback for r in out)


def segments(spark, rows):
    return spark.createDataFrame([("v", i, i + 1, a, b, t, p) for i, (a, b, t, p) in enumerate(rows)], "video_id string, word_start long, word_end long, start_ms long, end_ms long, text string, probability double")


def test_orphans_merge_or_go(spark):
    kept, gone = S.merge_orphans(segments(spark, [(0, 300, "So", 0.9), (700, 3000, "we go on.", 0.8), (3100, 3400, "the", 0.2), (9400, 12000, "last one here.", 0.9)]))
    assert texts(kept) == ["So we go on.", "last one here."] and texts(gone) == ["the"]


def test_orphan_that_may_merge_twice_merges_once(spark):
    kept, _ = S.merge_orphans(segments(spark, [(0, 300, "and", 0.9), (400, 700, "so", 0.9), (800, 1100, "the", 0.9), (1200, 3000, "end of it.", 0.9)]))
    assert texts(kept) == ["and so", "the end of it."]


def test_greedy_cut_at_sentence_ends_and_limits(spark):
    w = words(spark, "First one. " + " ".join(f"word{i}" for i in range(70)))
    out = S.greedy_segments(w).orderBy("word_start").collect()
    assert (out[0].word_start, out[0].word_end) == (0, 2)
    assert all(r.word_end - r.word_start <= R.MAX_WORDS for r in out) and sum(r.word_end - r.word_start for r in out) == 72


def caption(spark, rows):
    return spark.createDataFrame([("v", i, a, b, t) for i, (a, b, t) in enumerate(rows)], "video_id string, idx long, start_ms long, end_ms long, text string")


def test_incomplete_captions_absorb_what_follows(spark):
    got = texts(C.merge_incomplete(caption(spark, [(0, 1000, "We want to"), (1100, 2000, "go up there."), (2100, 3000, "Done now"), (3100, 4000, "ok")])).withColumnRenamed("idx", "word_start"))
    assert got == ["We want to go up there.", "Done now ok"]


def test_overlong_captions_split_by_characters(spark):
    text = ", ".join("a" * 50 for _ in range(5))
    out = C.split_overlong(caption(spark, [(0, 10000, text)])).orderBy("idx").collect()
    assert len(out) == 2 and out[0].start_ms == 0 and out[-1].end_ms == 10000 and out[0].end_ms == out[1].start_ms and all(len(r.text) <= 160 for r in out)


@pytest.mark.parametrize("text, want", [("熊喷雾 很 好.", "防熊喷雾很好。"), ("，，露营旅行!!", "露营之旅！"), ("plain, text.", "plain, text."), (None, "")])
def test_chinese_marks(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.cjk_normalised(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("i think  this is the lost way around Africa", "I think This is the long way around Africa"), ("google maps it with the, with the map", "Google Maps it with the map"), ("", ""), ("123", "123")])
def test_corrections(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.corrected(F.col("t"))).first()[0] == want


def test_empty_tables(spark):
    none = words(spark, "a").where("false")
    assert S.segment_corpus(none).count() == 0 and S.greedy_segments(none).count() == 0


ODD = "We 're going , to the end of a well - known road . do n't stop at 5 % 's IT'S a-b - c walking ! é ñandú -x ok? 'quoted' 1 2 , , ; the".split()


def odd_words(spark, seed):
    import random

    rng = random.Random(seed)
    return words(spark, " ".join(rng.choice(ODD) for _ in range(150)), pauses={k for k in range(150) if rng.random() < 0.1}, step=rng.choice([200, 350, 900]))


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_words_equal_cuts_of_costed_candidates(spark, seed):
    blocks = S.hard_blocks(S.boundary_features(S.normalize_words(odd_words(spark, seed))))
    scores = blocks.select("video_id", "idx", (F.col("idx") % 7 / 10).alias("boundary_probability"), (F.col("idx") % 5 == 0).alias("protected"))
    want = S.optimize_segments(S.candidate_costs(S.segment_candidates(blocks), blocks, scores)).collect()
    assert sorted(map(tuple, S.least_cost_cuts(blocks, scores).collect())) == sorted(map(tuple, want))


def test_cuts_are_the_cheapest_of_all(spark):
    blocks = S.hard_blocks(S.boundary_features(S.normalize_words(odd_words(spark, 9))))
    costs = {(r.word_start, r.word_end): r.cost for r in S.candidate_costs(S.segment_candidates(blocks), blocks).collect()}
    bounds = [(r.a, r.b) for r in blocks.groupBy("block_id").agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b")).collect()]

    def least(a, b):
        return 0 if a == b else min((costs[a, c] + least(c, b) for c in range(a + 1, b + 1) if (a, c) in costs), default=10**15)

    got = {}
    for r in S.least_cost_cuts(blocks).collect():
        got[r.block_id] = got.get(r.block_id, 0) + r.cost
    short = [(k, a, b) for k, (a, b) in enumerate(sorted(bounds)) if b - a <= 12]
    assert len(short) > 10 and all(got[k] == least(a, b) for k, a, b in short)


def test_videos_that_break_the_limits_fall_back(spark):
    good, bad = words(spark, "We walk up the hill. And then we rest."), words(spark, "we go up the hill " + "x" * 170 + " and then of the lake we see all", video="w")
    out = S.segment_corpus(good.unionByName(bad)).orderBy("video_id", "word_start").collect()
    own = [r for r in out if r.video_id == "w"]
    assert {(r.video_id, r.used_fallback, r.error) for r in out} == {("v", False, None), ("w", True, "no caption within limits holds word 5")}
    assert own[0].word_start == 0 and own[-1].word_end == 14 and [r.word_start for r in own][1:] == [r.word_end for r in own][:-1]
    assert out[0].text == "We walk up the hill." and own[0].text[0] == "W" and out[0].start_ms == 0 and out[0].end_ms > 4 * 350 + 280


@pytest.mark.parametrize("shipped", [1 << 20, 0], ids=["automaton", "join"])
def test_phrases_of_any_length_are_found(spark, shipped):
    import re

    from lexitide.operators.lookup import annotate_terms

    pool = "as the crow flies at one point in time it's it’s a well-known so far, so good".split()
    phrases = ["as the crow flies", "in time", "at one point in time it's a well-known", "it's", "so far, so good", "so far", "absent phrase"]
    import random

    rng = random.Random(3)
    rows = [("v", k, " ".join(rng.choice([*pool, *phrases]) for _ in range(12))) for k in range(40)] + [("v", 90, ""), ("v", 91, None), ("v", 92, "He said 'in time' --'tis so-far, x-ray's-1 In Time_ in time"), ("v", 93, "日本 so far語 so far")]
    want = set()
    for v, k, text in rows:
        low = re.sub("[‘’‛′]", "'", (text or "").lower())
        spans = sorted((-len(p), m.start(), m.start() + len(p), p) for p in phrases for m in re.finditer(rf"(?a)(?<!\w)(?={re.escape(p)}(?!\w))", low))
        kept = []
        for _, a, b, p in spans:
            if not any(x < b and a < y for x, y, _ in kept):
                kept.append((a, b, p))
        words = [(m.start(), m.end(), m[0], "word") for m in re.finditer("[A-Za-z][A-Za-z'-]*", text or "")]
        want |= {(v, k, a, b, p, "phrase") for a, b, p in kept} | {(v, k, *w) for w in words if not any(x < w[1] and w[0] < y for x, y, _ in kept)}
    got = annotate_terms(spark.createDataFrame(rows, "video_id string, idx long, english_text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), shipped)
    got = {tuple(r) for r in got.collect()}
    assert got == want and len(want) > 60, (sorted(got - want)[:5], sorted(want - got)[:5])


@pytest.mark.parametrize(
    "english, chinese, style, want",
    [
        ("Oh my.", "哦，我的", "natural", "天啊。"),
        ("And let’s do it", "做", "natural", "我们出发吧。"),
        ("This is the lost way around Africa, he said.", "这是在非洲各地的迷路.", "natural", "这就是绕行非洲的漫长路线。"),
        ("Something else.", "这是在非洲各地的迷路.", "natural", "这是在绕行非洲的漫长路线。"),
        ("But we don't get to go straight as the crow flies today.", "但我们不能直接走直线, 乌鸦飞", "natural", "但我们不能按直线距离直接过去，直线距离"),
        ("Oh my.", " 哦  我的 ", "raw", "哦 我的"),
        ("Oh well.", None, "natural", ""),
    ],
)
def test_polished_translations(spark, english, chinese, style, want):
    rows = spark.createDataFrame([("v", 1, english, chinese)], "video_id string, idx long, english_text string, chinese_text string")
    assert C.polish_translations(C.apply_glossary(rows), style=style).first().chinese_text == want


def test_own_rules_of_translations(spark):
    rows = C.apply_glossary(spark.createDataFrame([("v", i, e, z) for i, (e, z) in enumerate([("a cat.", "甲"), ("the dog", "甲乙")])], "video_id string, idx long, english_text string, chinese_text string"))
    sentences = spark.createDataFrame([(r"a cat\.?", "猫")], "pattern string, replacement string")
    fragments = spark.createDataFrame([(2, None, "丙", "丁"), (1, r"\bdog\b", "乙", "丙")], "seq int, guard string, old string, new string")
    assert sorted(r.chinese_text for r in C.polish_translations(rows, sentences, fragments).collect()) == ["猫", "甲丁"]


def test_models_that_fail(spark):
    from lexitide.functions import models as M

    def broken(text):
        if "x" in text:
            raise ValueError("no")
        return [0.5] * len(text)

    chunks = spark.createDataFrame([("v", 0, "ab"), ("v", 1, "x")], "video_id string, chunk_id long, text string")
    got = sorted(map(tuple, M.score_boundaries(chunks, broken).collect()), key=str)
    assert got == [("v", 0, 0, 0.5, None), ("v", 0, 1, 0.5, None), ("v", 1, None, 0.0, "ValueError: no")]
    rows = spark.createDataFrame([("v", i, t, None) for i, t in enumerate(["ab", "x"])], "video_id string, idx long, english_text string, chinese_text string")
    one = M.translate(rows, lambda texts: ["译" + t for t in texts if broken(t)], batch=1).orderBy("idx").collect()
    assert [r.chinese_text for r in one] == ["译ab", ""]
