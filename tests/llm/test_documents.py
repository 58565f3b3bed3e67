"""Document operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexitide.llm import decontamination, lm_scoring, packing, sharding, simhash, substring_dedup, toxicity
from lexitide.llm.words import hashed_ids, pack, squeeze, unpack, expand, words

COLUMNS = "doc_id long, text string, id long, key string, fp int, score string, shard string, n int, bin string, kept_extra string"
RNG = np.random.default_rng(5)


def sentence(n, seed, vocabulary=400):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


def rows():
    base = sentence(60, 1)
    long = sentence(9000, 2) + " É ünïcode\t\x0btabs\r\nlines  " + "y" * 5000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base.replace("w", "W", 1)), (7, base + " more words at the end"), (8, "one"), (9, "one two three"), (10, long), (11, sentence(20, 3) + " " + sentence(9000, 2)), (12, "same same " * 40), (13, "same same " * 40), (13, "same same " * 40), (None, base), (None, None), (-4, sentence(30, 4)), (2**40, sentence(30, 4) + " tail")]
    return [(i, t, 0, "k", 1, "s", "x", 2, "b", "e") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def listed(texts=None):
    return [(r[0], (r[1] or "").encode()) for r in (texts or rows())]


def test_word_helpers():
    data = b" ab  c\x0bd\n" + b"z" * 3_000_000 + b" end " + b"q" * 6000 + b" "
    s, e, h = words(data)
    assert [data[a:b] for a, b in zip(s, e)] == data.split()
    assert h[0] == words(b"x ab")[2][1] and h[3] == words(b"z" * 3_000_000)[2][0]
    v = np.sort(RNG.integers(0, 2**63, 1000).astype(np.uint64))
    assert (unpack(pack(v), 1000) == v).all() and (expand(squeeze(v[::-1], np.uint64), 1000, np.uint64) == v[::-1]).all()
    assert unpack(pack(v[:0]), 0).size == 0


def test_hashed_ids_are_sparks(spark):
    ids = [0, 1, -5, 2**62, 123456789]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x long").select(F.xxhash64("x")).collect()]
    assert got == hashed_ids(np.array(ids, np.int64)).tolist()


def test_substring_dedup(docs, none):
    seen: dict = {}
    for i, t in listed():
        w = t.split()
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j : j + 13])
                seen[k] = min(seen.get(k, i), i)
    want = []
    for i, t in listed():
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and seen[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want.append((str(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    out = substring_dedup.remove_repeats(docs, keep=("key", "n")).collect()
    got = [(str(r.doc_id), r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]
    assert sorted(got) == sorted(want) and all(r.key == "k" and r.n == 2 for r in out)
    assert all(a < b for r in out for a, b in zip(r.ends, r.starts[1:]))
    assert substring_dedup.remove_repeats(none).count() == 0


def fingerprint(text, width=3):
    w = text.lower().split()
    parts = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if parts and 2 * counts[k] > len(parts))


def rooted(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_long_words_with_equal_polynomial_hashes(spark):
    """Thue-Morse words have equal polynomials modulo powers of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [" ".join([*"abcdefghijkl", w]) for w in (one, one.translate(str.maketrans("ab", "ba")), one)]
    out = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: texts[0], 1: texts[1], 2: ""}


def test_what_is_left_of_a_text_keeps_its_lines(spark):
    passage = sentence(20, 77)
    table = spark.createDataFrame([(1, passage), (2, f"first line\n\n{passage}\n\nlast  line\n"), (3, f" {passage}"), (4, "a\nb")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_dedup.remove_repeats(table, lines=True).collect()} == {1: passage, 2: "first line\n\nlast  line\n", 3: " ", 4: "a\nb"}


def test_simhash(docs, none):
    all_of = listed()
    fps = [fingerprint(t) for _, t in all_of]
    roots = rooted(fps)
    want = sorted((str(i), f, str(min((j for (j, _), q in zip(all_of, roots) if q == r and j is not None), default=None))) for (i, _), f, r in zip(all_of, fps, roots))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_similar_documents(spark, docs, none):
    """Copies with a few words changed against the Jaccard similarity of all pairs; a crowd of copies of one text."""
    texts = [sentence(120, s) for s in range(20)]
    for k in range(60):
        w = texts[k % 12].split()
        for j in np.random.default_rng(k).integers(0, 120, 1 + k % 7):
            w[j] = f"new{k}x{j}"
        texts.append(" ".join(w))
    texts += [texts[0].upper().replace("W", "w"), "", None, " \n", "two words", "two  words"]
    texts += [texts[1] + f" end{k}" for k in range(90)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = dict(simhash.similar_documents(table).collect())
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: find(i) for i in range(len(texts))}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is grouped that is not alike
    dropped = [i for i in want if want[i] != i]
    assert sum(got[i] != i for i in dropped) >= 0.9 * len(dropped)
    assert simhash.similar_documents(docs).count() == len([r for r in rows() if r[0] is not None]) and simhash.similar_documents(none).count() == 0


def test_similar_documents_of_crowded_postings(spark):
    """Pairs of similarity 0.8125 that share half their words with 190 unlike texts; every pair is found."""
    shared = [f"all{k}" for k in range(60)]
    texts = [" ".join(shared + [f"own{k}x{j}" for j in range(60)]) for k in range(30)]
    for g in range(80):
        own = shared + [f"pair{g}x{j}" for j in range(60)]
        texts += [" ".join(own), " ".join(f"new{g}x{j}" if j in (70, 90, 118, 119) else w for j, w in enumerate(own))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = dict(simhash.similar_documents(table).collect())
    assert got == {i: i if i < 30 else i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("most", [512, 3])
def test_links_of_crowded_postings(spark, most):
    base = RNG.integers(0, 2**63, 12).tolist()
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in RNG.integers(0, 63, (15, 2))})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most=most).collect()
    at = {f: k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(at[r.a])] = find(at[r.b])
    want, got = rooted(fps), [find(x) for x in range(len(fps))]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def test_sharding(docs, none):
    out = sharding.shard_rows(docs.select("doc_id", "text", "shard", "n"), 7).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows()) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sorted(map(str, ((r.doc_id, r.text, r.n) for r in out))) == sorted(map(str, ((r[0], r[1], r[7]) for r in rows())))
    assert sharding.shard_rows(none, 7).count() == 0


def test_sharding_of_any_columns(spark):
    """Maps, and columns with the operator's own names and with dots."""
    rows = [(i, {"a": i, "b": None}, i, "k", [i], 7, 1) for i in range(50)] + [(None, None, None, None, None, None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, props map<string,int>, at long, `__at` string, keys array<int>, `a.b` int, p int").repartition(3)
    out = sharding.shard_rows(table.withColumn("row", F.struct("doc_id", "props")), 4).collect()
    assert Counter(r.shard for r in out) == {0: 14, 1: 13, 2: 13, 3: 13}
    assert sorted(map(str, ((r.doc_id, r.props, r.at, r["__at"], r["keys"], r["a.b"], r.p) for r in out))) == sorted(map(str, rows))


def test_sharding_in_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    out = sharding.shard_rows(spark.range(0, 3001, 1, 6), 4).toPandas()
    assert sorted(out.groupby("shard").size()) == [750, 750, 750, 751]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_communication_matrix_is_uniform():
    m = np.mean([sharding.communication_matrix([30, 10, 60], [50, 25, 25], s) for s in range(400)], 0)
    assert np.abs(m - np.outer([30, 10, 60], [0.5, 0.25, 0.25])).max() < 0.6
    big = sharding.communication_matrix([10**9, 2 * 10**9], [10**9] * 3, 1)
    assert (big.sum(0) == 10**9).all() and big.sum(1).tolist() == [10**9, 2 * 10**9] and abs(big[0, 0] - 10**9 / 3) < 10**6


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path).toPandas()
    want = Counter()
    for r in rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4").tobytes()
            want[str((r[0], k, a, len(part) // 4, zlib.crc32(part)))] += 1
    got = Counter(str((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)) for r in out.itertuples())
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and g.length.sum() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1
    assert packing.pack(none, path).count() == 0


def test_packed_sequences_hold_the_ids(docs, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "NODE_BINS", 3)
    out = packing.pack(docs, path).collect()
    want = Counter(tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows())
    whole = Counter()
    for _, own in groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert len(ids) <= 4096
        for r in own:
            if r.start == 0 and r.length < 4096:
                whole[tuple(ids[r.offset : r.offset + r.length])] += 1
    assert whole == Counter({k: n for k, n in want.items() if len(k) < 4096})


def test_whole_documents_are_sharded(spark, tmp_path, monkeypatch):
    """The digest comes from the sharded rows, which hold the texts."""
    from lexitide.llm import queries

    table = spark.createDataFrame([(i, sentence(30, i), "en", "web", 1) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    shard_rows = sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda rows, *a: seen.append(rows.columns) or shard_rows(rows, *a))
    out = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert seen == [table.columns]
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {r.doc_id: (len(r.text) + 16, zlib.crc32(r.text.encode())) for r in table.collect()}


@pytest.mark.parametrize("text", ["it's <|endoftext|>x a<|startoftext|>", "ǅ ΣΑΣ ΟΔΟΣ, I'LL é  nbsp\x1cfs", "日本語 テキスト 12345", "a b"])
def test_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode([text.encode()], path)[0], "<u4").tolist() == want


def test_packing_in_many_nodes(spark, monkeypatch):
    """Bins above what a node holds are dealt out again, none is given up: as many sequences as a single node makes, nearly."""
    path = public_tokenizers.path("word_bpe_49k.json")
    table = spark.createDataFrame([(i, "the " * int(n)) for i, n in enumerate(RNG.integers(300, 3000, 400))], "doc_id long, text string").repartition(40)
    one = packing.pack(table, path).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    monkeypatch.setattr(packing, "NODE_BINS", 40)
    out = packing.pack(table, path)
    fills = [r[1] for r in out.groupBy("sequence_id").agg(F.sum("length")).collect()]
    assert sum(fills) == one[1] and max(fills) <= 4096 and len(fills) <= 1.03 * one[0]


@pytest.mark.parametrize("seed", range(8))
def test_random_words_encode_like_whole_texts(seed):
    from tokenizers import Tokenizer

    rng, path = np.random.default_rng(seed), public_tokenizers.path("word_bpe_49k.json")
    letters = list("aBcéÉßÑ×÷,.'s!12WΣσςİ» …ÿþÀ=ſK <|>") + ["\u0301", "\u030a", "\u0338", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode([t.encode() for t in texts], path)] == want


def test_best_fit_fills_bins():
    bins = packing.best_fit([5, 5, 5, 3, 2, 10, 7], 10)
    assert sorted(sum(bins, [])) == list(range(7)) and len(bins) == 4


def test_decontamination(spark, none):
    item = "Yesterday my friend Alice bought 12 apples and 7 pears for 40 dollars at the old market near the river with Bob"
    changed = item.replace("Alice", "Carol").replace("12", "15").replace("40", "99")
    mixed = item.replace("12", "15", 1).replace("Alice", "Bob")  # two names of the item become one
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "other words " + sentence(20, 9))], "item_id long, text string")
    table = spark.createDataFrame([(1, "before it. " + item + " and after it."), (2, "x " + changed), (3, mixed), (4, sentence(500, 8)), (5, None), (6, ""), (None, item), (7, item), (7, item), (8, " ".join(item.split()[:9]))], "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(table, bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (7, 1)} and out[2, 1].changed and not out[1, 1].changed
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(table, bench.where("false")).count() == 0


def test_decontamination_of_odd_items(spark):
    """Short items, items of numbers only, and each text of an item id."""
    bench = spark.createDataFrame([(1, "What is left"), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (3, sentence(30, 1)), (3, sentence(30, 2))], "item_id long, text string")
    table = spark.createDataFrame([(1, "so what is left of it"), (2, "what was left"), (3, "x 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (4, "9 9 9 9 9 9 9 9 9 9 9 9 9 9 9"), (5, sentence(30, 1)), (6, sentence(30, 2)), (7, sentence(30, 3))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(table, bench).collect()} == {(1, 1), (3, 2), (5, 3), (6, 3)}


def leaks(docs, items, width=8, literals=3):
    """Decontamination by comparing all windows of all pairs of texts, in both readings of capitals that open a sentence."""

    def tokens(text):
        out, end = [], None
        for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text):
            w, opens = m[0], end is None or any(c in ".!?:\n" for c in text[end : m.start()])
            kind = "#" if w[0].isdigit() else "%" if out and not opens and out[-1][1] == "#" and w.lower() in decontamination.UNITS else "@" if w[0].isupper() and not opens else ""
            out.append((w, kind, "@" if w[0].isupper() and opens else kind))
            end = m.end()
        return out

    def window(own, reading):
        kinds = [(t[0], t[1 + reading]) for t in own]
        exact = sum(not k for _, k in kinds) < literals
        return exact, tuple(w.lower() if exact or not k else k for w, k in kinds)

    def readings(own):
        """A window of a document: as it is, and with opening capitals as names where that says something."""
        return [0, 1] if any(k != m for _, k, m in own) and not window(own, 1)[0] else [0]

    found = {}
    for d, text in docs:
        for i, item in items:
            a, b = tokens(text or ""), tokens(item or "")
            n = min(width, len(b))
            met = {}
            for x in range(len(a) - n + 1 if n else 0):
                for y in range(len(b) - n + 1):
                    for r in (0, 1):
                        for q in readings(a[x : x + n]):
                            if window(a[x : x + n], q) == window(b[y : y + n], r):
                                met.setdefault((x - y, r), []).append((x, y, q))
            for (_, r), places in met.items():
                pairs = {(b[y + k][0] if b[y + k][1 + r] else None, a[x + k][0]) for x, y, q in places for k in range(n) if a[x + k][1 + q]}
                covered = len({x + k for x, *_ in places for k in range(n)})
                if len({o for o, _ in pairs}) == len({v for _, v in pairs}) == len(pairs) and covered >= min(13, len(b) / 2):
                    key = (covered, not any(o != v for o, v in pairs), -min(x for x, *_ in places))
                    found[d, i] = max(found.get((d, i), key), key)
    return found


def test_names_that_open_sentences_and_short_items(spark):
    bench = spark.createDataFrame([(1, "Maria bought 12 red pens. Maria gave 5 pens away. Maria lost 3 pens."), (2, "What is 12 times 7?"), (3, "1 2 3")], "item_id long, text string")
    texts = ["Julia bought 15 red pens. Julia gave 9 pens away. Julia lost 4 pens.", "So: What is 13 times 9? And then", "Julia bought 15 red pens. Eve gave 9 pens away. Eve lost 4 pens.", "What is 13 plus 9?", "x 1 2 3 y", "4 5 6", "They say that Julia bought 15 red pens. Julia gave 9 pens away."]
    found = decontamination.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.changed) for r in found} == {(0, 1, True), (1, 2, True), (4, 3, False), (6, 1, True)}  # one name of the item cannot be two


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(11)
    pool = "the a buys sells has finds . . 3 4 17 Ann Bob Eve The A km days one two".split()
    items = [(k % 17, " ".join(rng.choice(pool, rng.integers(1, 26)))) for k in range(25)] + [(30, None), (31, "")]
    texts = []
    for k in range(70):
        own = [*rng.choice(pool, rng.integers(0, 12)), *(items[k % 25][1].split()), *rng.choice(pool, rng.integers(0, 12))]
        swap = dict(zip(["3", "4", "Ann", "Bob"], rng.permutation(["3", "4", "17", "99"])[:2].tolist() + rng.permutation(["Ann", "Bob", "Tom"])[:2].tolist())) if k % 3 else {}
        texts.append((k, " ".join(swap.get(w, w) for w in own)))
    found = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.matched, not r.changed, -r.first_token) for r in found}
    assert got == leaks(texts, items) and len(got) > 60


def test_language_model(docs, none, spark):
    corpus = spark.createDataFrame([(i, " ".join(("the cat sat on a mat . " if i % 2 else "le chat est sur un tapis , ") for _ in range(5)) + f"name{i}") for i in range(300)], "doc_id long, text string")
    train, held = corpus.where("doc_id % 5 <> 1"), corpus.where("doc_id % 5 = 1")
    out = lm_scoring.score(held, train).toPandas()
    assert out.score.sum() > out.base_score.sum() and (out.n_known == out.n_tokens - 1).all()
    counts = Counter()
    for r in rows():
        counts.update([*(r[1] or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = {str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in lm_scoring.score(docs, docs).collect()}
    want = set()
    for r in rows():
        own = [*(r[1] or "").encode().lower().split(), None]
        want.add(str((r[0], len(own), len(own), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6))))
    assert got == want
    assert lm_scoring.score(none, docs).count() == 0 and lm_scoring.score(docs, none).count() == len(rows())


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 3000)  # several shards
    table = spark.createDataFrame([(i, sentence(60, i % 40, 50)) for i in range(200)], "doc_id long, text string")
    one, other = ({r.doc_id: r.score for r in lm_scoring.score(t, t.where("doc_id % 5 <> 1")).collect()} for t in (table.repartition(3), table.repartition(11)))
    assert all(abs(one[i] - other[i]) < 1e-6 for i in range(200))


def test_normalisers_sum_to_one():
    p = lm_scoring.fresh(3)
    p = {k: x * 3 for k, x in p.items()}
    t = lm_scoring.tables(p)
    z = lm_scoring.normalisers(t, p["b"])
    for a, b, c in ((0, 1, 2), (255, 7, 9)):
        s = p["b"] + t[0][a] + t[1][b] + t[2][c]
        assert abs(np.exp(s - z[a, b, c]).sum() - 1) < 1e-3


def toxic_rows(n=400):
    out = []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(40, 1000 + i) + (" you utter grumphead and grumpling fool" if bad else "")
        out.append((i, text, int(bad)))
    return out


def test_toxicity(docs, none, spark):
    table = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic")
    model = toxicity.train(*toxicity.sample(table, labels.where("doc_id % 5 <> 0")))
    held = toxicity.score(table.where("doc_id % 5 = 0"), model).collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in held)
    texts = {r[0]: r[1] for r in toxic_rows()}
    marked = [texts[r.doc_id][s.start : s.end] for r in held if r.toxic for s in r.spans]
    assert marked and all("grump" in m for m in marked)
    out = toxicity.score(docs, model)
    assert out.count() == len(rows()) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(*toxicity.sample(none, labels.where("false")))
    assert toxicity.score(docs, blank).count() == len(rows())


def test_marginals_are_exact():
    model = toxicity.Model(np.zeros(1), np.array([0.1, -1.2]), np.log(np.array([[0.9, 0.1], [0.4, 0.6]])), np.zeros(5))
    first = np.array([0, 0, 150, 151, 400, 400])
    gain = np.random.default_rng(1).normal(0, 2, 400)
    got = toxicity.forward_backward(gain, first, model)[0]
    a = np.exp(model.moves)
    for s, e in zip(first, first[1:]):
        n = e - s
        if not n:
            continue
        x = np.stack([np.ones(n), np.exp(gain[s:e])], 1)
        f, b = np.ones((n, 2)), np.ones((n, 2))
        f[0] = np.exp(model.start) * x[0]
        for t in range(1, n):
            f[t] = f[t - 1] @ a * x[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (b[t + 1] * x[t + 1])
            b[t] /= b[t].sum()
        want = (f * b)[:, 1] / (f * b).sum(1)
        assert np.abs(want - got[s:e]).max() < 1e-9
