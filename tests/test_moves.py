"""What queries move between tasks: texts are dealt by video once, and what is done by video moves no words."""

import re

import pytest

from lexitide.functions import models as M
from lexitide.operators import segmentation as G
from lexitide.plans import catalog

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("name", ["win2_hard_blocks", "win3_analysis_chunks", "win5_segment_candidates", "win7_optimize_segments", "win10_greedy_segments_v1"])
def test_words_stay_where_their_text_is(spark, name):
    assert len(exchanges(catalog.QUERIES[name](spark, SF))) == 1


@pytest.mark.parametrize("name", ["win9_greedy_segments", "pipe1_segment_corpus"])
def test_no_words_by_block(spark, name):
    assert not [e for e in exchanges(catalog.QUERIES[name](spark, SF)) if "block_id" in e or "island" in e or "idx" in e]


@pytest.mark.parametrize("name", ["jn11_boundary_scores", "pipe1_scored_corpus"])
def test_scored_words_stay_where_their_text_is(spark, name):
    plan = catalog.QUERIES[name](spark, SF)
    assert not [e for e in exchanges(plan) if "idx" in e or "chunk_id" in e]
    assert len(exchanges(plan)) == (1 if name.startswith("jn11") else len(exchanges(catalog.QUERIES["pipe1_segment_corpus"](spark, SF))))


def test_scores_of_last_characters_are_the_same(spark):
    words = spark.createDataFrame([("v", 0, i, t) for i, t in enumerate(["one", "a b", "three"])], "video_id string, chunk_id long, idx long, text string")
    texts, tags = G.chunk_texts(words), spark.createDataFrame([], "video_id string, chunk_id long, token long, start long, head long, dependency string, pos string, end long, error string")
    model = lambda t: [i / 20 for i in range(len(t))]
    every, few = M.score_boundaries(texts, model), M.score_boundaries(texts, model, ends_only=True)
    assert (every.count(), few.count()) == (13, 3)
    got = [sorted(map(tuple, G.boundary_scores(words, s, tags).collect())) for s in (every, few)]
    assert got[0] == got[1] and [r[2] for r in got[0]] == [0.0, 0.1, 0.3]


def test_captions_count_the_words_they_have(spark):
    """Numbers of words may have gaps."""
    rows = [("v", i, 400 * k, 400 * k + 300, t, 0.5, False, False) for k, (i, t) in enumerate([(0, "we"), (3, "went"), (4, "up"), (9, "there.")])]
    blocks = G.hard_blocks(G.boundary_features(G.normalize_words(spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string, probability double, segment_end boolean, segment_complete boolean"))))
    assert [(r.word_start, r.word_end, r.n_words) for r in G.least_cost_captions(blocks).collect()] == [(0, 10, 4)]
