"""Pages, conversations, vectors and the pipeline: golden rows, brute force, SQL."""

import random
import time

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexitide.llm import chat_format, html_text, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain text with a number of words", "plain text with a number of words"),
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  <b>two</b>.<p>Three<br>four.</article><footer>&copy; x</footer>", "A & B\n\nOne two.\n\nThree four."),
        ("<body class='has-sidebar'><header><p>Site name</p></header><main><article><header><h1>T</h1></header><p>Text of the page.</p><aside>See also this one</aside></article><section id=comments><p>I liked this very much indeed, thank you for it</p></section></main>", "T\n\nText of the page."),
        ("<div class=ad>Buy now the very best thing there is in all the world today</div><p>Real words are here to be read by people.</p><script>var a='<p>no</p>'</script><style>p{}</style>", "Real words are here to be read by people."),
        ("<article><p>a < b and c &lt; d</p><form>Name <input> mail</form><p title='x > y'>Cut off", "a < b and c < d\n\nCut off"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_minimum_cut_against_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 7
        scores = rng.normal(0, 1, n).tolist()
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 9), rng.integers(0, n, 9), rng.random(9)) if a != b]

        def cost(side):
            return sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, side)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_text.minimum_cut(scores, edges)) - best) < 1e-9


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>Hello there, dear reader of pages.</p>", "y")], "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert sorted(r.text for r in out) == ["", "", "Hello there, dear reader of pages."] and out[0].asDict().keys() == {"page_id", "url", "text"}
    assert html_text.extract(pages.where("false")).count() == 0


def test_pages_of_the_tables(spark):
    import re
    from html import unescape

    got = {r.page_id: r.text for r in queries.op8_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1|article)>", article))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preference_formatting(spark):
    u, a, b = ("user", "Hi"), ("assistant", "Yes"), ("assistant", "No")
    table = spark.createDataFrame([(1, turns(u, a), turns(u, b)), (2, turns(u), turns(u, a)), (3, None, turns(a)), (4, turns(u, a), turns(u, a))], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r.pair_id: r for r in chat_format.format_pairs(table).collect()}
    assert (out[1].prompt, out[1].chosen, out[1].rejected) == ("<|user|>\nHi<|end|>\n", "<|assistant|>\nYes<|end|>\n", "<|assistant|>\nNo<|end|>\n")
    m = out[1].chosen_mask[0]
    assert out[1].chosen[m.start : m.end] == "Yes<|end|>\n"
    assert out[2].chosen == "" and out[2].prompt_turns == 1 and out[3].prompt == "" and out[3].rejected and out[4].chosen == out[4].rejected == ""


def test_gather_orders_and_defaults(spark):
    t = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert [tuple(x) for x in chat_format.gather(t, "conv_id").first().turns] == [("unknown", ""), ("assistant", "b"), ("user", "b")]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (400, 8)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, v[i].tolist()) for i in range(400)] + [(3, v[3].tolist()), (900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, v[1].tolist()), (1000, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = topk.top_k(table, table.where("vec_id % 100 = 0"), 10).collect()
    ints = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    for q in (0, 100, 200, 300):
        s = ints @ ints[q]
        want = [(i, int(s[i])) for i in sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:10]]
        assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in out} == {0, 100, 200, 300}
    assert topk.top_k(table.where("false"), table.where("false"), 10).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "embeddings conversations documents".split():
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    key = list(got.columns)
    assert got.astype(str).sort_values(key).values.tolist() == want[key].astype(str).sort_values(key).values.tolist()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.dtypes == docs.dtypes
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, kept))
        assert set(after) <= set(before) and 0.5 * len(before) < len(after)
        if name == "simhash_near_dedup":
            assert len(set(after.values())) == len(after)
        docs = kept
    benchmark = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in " ".join((t or "").split()) for b in benchmark for t in after.values())
    placed = corpus_pipeline.run(spark, SF)
    assert placed.select("doc_id").distinct().count() == len(after)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with the operators' own names."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    words = lambda n, seed: " ".join(f"w{(k * seed) % 9973}" for k in range(n))
    texts = [(1, None), (2, ""), (3, " \n"), (4, words(40, 7)), (4, words(40, 7)), (5, words(40, 7) + " tail"), (None, words(40, 7)), (None, None), (6, words(30000, 11)), (7, "one\ntwo"), (8, words(40, 13) + "\n" + words(40, 7))]
    extra = "score double, spans string, n_words int, starts int, ends int, kept string, rest string, item_id int, hash long, id long, fp long, root long, bin int, ids binary"
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 0.9, "s", 1, 2, 3, "k", "r", 4, 5, 6, 7, 8, 9, b"x") for i, t in texts], f"doc_id long, text string, lang string, source string, n_chars int, {extra}")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.dtypes == docs.dtypes, name
            kept = out.collect()
            assert all((r.score, r.spans, r.n_words, r.kept, r.rest, r.id, r.ids) == (0.9, "s", 1, "k", "r", 6, b"x") for r in kept)
            if rows is docs:
                want = {"toxicity": {1, 2, 3, 4, 5, 6, 7, 8, None}, "simhash_near_dedup": {1, 4, 6, 7, 8, None}, "substring_dedup": {1, 2, 3, 4, 5, 6, 7, 8, None}, "decontamination": {1, 2, 3, 4, 5, 6, 7, 8, None}}[name]
                assert {r.doc_id for r in kept} == want and sum(r.doc_id == 4 for r in kept) == 2, name
                if name == "substring_dedup":
                    assert {r.doc_id: r.text for r in kept if r.doc_id in (5, 7, 8)} == {5: "tail", 7: "one\ntwo", 8: words(40, 13) + "\n"}
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in packed) == rows.count()


def test_classifier_learns_names(spark):
    """Names that no list holds are learned from pages that mark their main text, and serve where nothing is marked."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(n))
    aside = lambda n: f'<div class="zqfeed">{words(n)}</div>'
    pages = [f"<body>{aside(14)}<article><p>{words(20)}</p><p>{words(5)}</p></article>{aside(9)}</body>" for _ in range(60)]
    model = html_text.fit(pages)
    assert model.names["zqfeed"] < -1
    page = f"<body>{aside(14)}<div><p>the main text of this page has some words</p><p>and more of them here</p></div>{aside(9)}</body>"
    assert html_text.main_text(page, model) == "the main text of this page has some words\n\nand more of them here"
    assert html_text.main_text(page) != html_text.main_text(page, model)
    table = spark.createDataFrame([(i, h) for i, h in enumerate([*pages, page, None, ""])], "page_id long, html string")
    assert len(html_text.sample(table)) == 60 and html_text.sample(table) == html_text.sample(table.repartition(5))
    assert html_text.extract(table, model=model).where("page_id >= 60").orderBy("page_id").collect()[0].text == html_text.main_text(page, model)


def test_marks_of_boilerplate_outweigh_an_article():
    long = "a long paragraph of words that goes on and on for more than twenty words so that nothing else is unsure about it"
    pages = [f'<body><nav><a>x</a></nav><div class="ad">{long}</div><article><h1>Title</h1><p>{long}</p></article><footer>end</footer></body>'] * 100
    for model in (html_text.Model(), html_text.fit(pages)):
        for inside in (f'<div class="ad"><p>{long}</p></div>', f'<section class="comments"><p>{long}</p></section>', f"<aside>{long}</aside>"):
            assert html_text.main_text(f"<article><h1>Title</h1><p>{long}</p>{inside}<p>{long}</p><ul><li>one</li></ul></article>", model) == f"Title\n\n{long}\n\n{long}\n\none"


def test_the_cut_turns_single_blocks():
    """A block that scores as boilerplate among neighbours of one parent that are content stays, and the other way round."""
    body = "<p>several words that make a paragraph of the text which is long enough</p>"
    page = f"<div>{body}{body}<div>ok</div>{body}{body}</div>"
    found = html_text.labelled(page, html_text.Model())
    assert [s > 0 for _, s, _ in found] == [True, True, False, True, True] and all(kept for *_, kept in found)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>some words of a text</p>" * 1000 + "</section>" * 20_000
    long = "<article>" + "<div><p>some words of a long page</p></div><p>x</p>" * 10_000 + "</article>"
    begun = time.time()
    assert html_text.main_text(deep).count("some words") == 1000 and html_text.main_text(long).count("long page") == 10_000
    assert time.time() - begun < 20


def test_next_ids(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ID_RANGE", 10)
    ids = [-25, -3, 0, 4, 9, 10, 11, 57, 58, 1000]
    rows = spark.createDataFrame([(i,) for i in ids + ids[:3]], "conv_id long")
    assert sorted(map(tuple, chat_format.next_ids(rows).collect())) == list(zip(ids, [*ids[1:], ids[0]]))
    assert chat_format.next_ids(rows.where("false")).count() == 0


def test_reply_pairs(spark):
    """Ids with gaps, a conversation without a reply, ties, nulls, repeated rows, very long texts and clashing columns."""
    long = "word " * 200_000
    talks = {2: ["u a", "a b"], 7: ["u a", "a b", "u c", "a d", "u e"], 8: ["u only"], 40: ["u a", "a b", "u x", "a " + long], 41: ["a "], 42: ["u q", "a q"]}
    rows = [(i, n, {"u": "user", "a": "assistant"}[t[0]], t[2:], "x", "y") for i, ts in talks.items() for n, t in enumerate(ts)]
    rows += [(None, 0, "user", "lost", "x", "y"), (42, 1, "assistant", "q", "x", "y"), (42, None, None, None, "x", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, pair_id string")
    pairs = {r.pair_id: ([t.text for t in r.chosen], [t.text for t in r.rejected]) for r in chat_format.reply_pairs(chat_format.gather(turns, "conv_id")).collect()}
    assert pairs == {
        2: (["a", "b"], ["a", "d"]),
        7: (["a", "b", "c", "d"], ["a", "b", "x", long]),  # one turn is kept, and the next is alike
        40: (["a", "b", "x", long], ["a", "b", "x", ""]),
        41: ([""], ["", "q", "q", "q"]),
        42: (["", "q", "q", "q"], ["", "q", "q", "b"]),
    }
    out = {r.pair_id: r for r in chat_format.format_pairs(chat_format.reply_pairs(chat_format.gather(turns, "conv_id"))).collect()}
    assert out[7].prompt_turns == 2 and out[7].chosen == "<|user|>\nc<|end|>\n<|assistant|>\nd<|end|>\n"
    assert [out[7].chosen[m.start : m.end] for m in out[7].chosen_mask] == ["d<|end|>\n"]
    assert [out[7].rejected[m.start : m.end] for m in out[7].rejected_mask] == [long + "<|end|>\n"]
    one = turns.where("conv_id = 2")
    assert chat_format.reply_pairs(chat_format.gather(one, "conv_id")).count() == 0
    assert chat_format.format_pairs(chat_format.reply_pairs(chat_format.gather(turns.where("false"), "conv_id"))).count() == 0
