"""Token files, whitening and source divergence: round trips and brute force, odd rows, and the registered queries' columns."""

import glob
import io
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from lexitide.llm import divergence, queries, token_files, whitening
from lexitide.llm.transducer import CLASS, Transducer, built

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---- token files


def ids_of(text):
    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 2], np.uint32).tobytes()


@pytest.fixture(scope="module")
def texts():
    long = " ".join(f"word{k % 977} runs" for k in range(3000))
    return [(5, "Hello there, World"), (1, None), (2, ""), (9, long), (9, long), (3, " \n"), (None, "no id"), (None, None), (4, "é ünï 日本語"), (-7, "first"), (8, "x " * 30), *((100 + k, f"text {k} of some words") for k in range(40))]


@pytest.fixture(scope="module")
def token_docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, b"x", "p", 7) for i, t in texts], "doc_id long, text string, id int, ids binary, path string, n_tokens int").repartition(4)


def in_order(rows):
    return [(r.id, bytes(r.ids)) for r in sorted(rows, key=lambda r: (r.part, r.number, r.place))]


@pytest.mark.parametrize("frame_ids, file_records", [(1 << 16, 256), (16, 4), (64, 2)])
def test_token_files_round_trip(spark, texts, token_docs, tmp_path, frame_ids, file_records):
    path = token_files.write(token_docs, TOKENIZER, str(tmp_path / "out"), frame_ids=frame_ids, file_records=file_records)
    got = in_order(token_files.read(spark, path).collect())
    assert [i for i, _ in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    assert sorted(got, key=str) == sorted(((i, ids_of(t)) for i, t in texts), key=str)
    starts, at = [], 0
    for _, ids in got:
        starts.append((at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, path).collect()) == starts
    names = sorted(glob.glob(f"{path}/part-*"))
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(name, "rb"), read_across_frames=True).read() for name in names)
    assert whole == b"".join(ids for _, ids in got)  # the files are zstandard files
    assert frame_ids > 16 or len(names) > 8
    wanted = spark.createDataFrame([(9,), (101,), (777,), (101,)], "n long")
    some = token_files.read(spark, path, wanted).collect()
    assert sorted((r.id, bytes(r.ids)) for r in some) == sorted((i, ids_of(t)) for i, t in texts if i in (9, 101))


def test_only_the_frames_of_requested_documents_are_decompressed(spark, token_docs, tmp_path):
    path = token_files.write(token_docs.coalesce(1), TOKENIZER, str(tmp_path / "out"), frame_ids=32)
    for name in glob.glob(f"{path}/part-*"):
        data = open(name, "rb").read()
        if not data:
            continue
        file = token_files.TokenFile(io.BytesIO(data))
        for place in range(len(file.lengths)):
            one, span = token_files.TokenFile(io.BytesIO(data)), int(file.offsets[place] + file.lengths[place])
            ((_, ids),) = one.documents([place])
            assert len(ids) == 4 * file.lengths[place]
            assert one.decompressed == (1 if span <= 32 else -(-span // max(32, -(-span // 255))))
        torn = bytearray(data)
        torn[int(file.begins[0]) + file.seek[0, 0] // 2] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(token_files.TokenFile(io.BytesIO(bytes(torn))).documents())


def test_a_wrong_checksum_of_the_seek_table_is_found(spark, token_docs, tmp_path):
    path = token_files.write(token_docs.where("doc_id = 5"), TOKENIZER, str(tmp_path / "out"))
    (data,) = (d for d in (open(n, "rb").read() for n in glob.glob(f"{path}/part-*")) if d)
    torn = bytearray(data)
    torn[-len(token_files.GAP) - 9 - 4] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.TokenFile(io.BytesIO(bytes(torn))).documents())


def test_no_documents(spark, token_docs, tmp_path):
    path = token_files.write(token_docs.where("false"), TOKENIZER, str(tmp_path / "out"))
    assert token_files.read(spark, path).count() == token_files.index(spark, path).count() == token_files.digest(spark, path).count() == 0


def test_op11(spark):
    out = queries.op11_token_files(spark, SF)
    assert [(c, t) for c, t in out.dtypes] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got, at = {r.doc_id: tuple(r)[1:] for r in out.collect()}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(r.text)
        assert got[r.doc_id] == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


# ---- whitening


def brute_whitening(vectors, k):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(v, sums)] for v in x]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in y), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    w = np.array([[c / n for c in v] for v in y]) @ u[:, order] / np.sqrt(e[order])
    return [sum(c * c for c in v) for v in y], w, e[order] / np.trace(cov)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) + 1000).astype(np.float32)
    rows = [(int(i) % 250, v.tolist(), 1, 2, "x") for i, v in enumerate(good)] + [(None, good[0].tolist(), 1, 2, "x")]
    odd = [None, [], [None] * 6, [*good[0, :5].tolist(), float("nan")], [float("inf")] + [0.0] * 5, [1e30] * 6]
    table = spark.createDataFrame(rows + [(1000 + i, v, 1, 2, "x") for i, v in enumerate(odd)], "vec_id int, embedding array<float>, n int, id int, whitened string").repartition(5)
    out = whitening.whiten(table, components=4).collect()
    vectors = [*good, good[0]]
    deviations, w, shares = brute_whitening(vectors, 4)
    assert len(out) == 301 and {r.n for r in out} == {301}
    key = lambda d, v: (d, *np.round(np.abs(v), 6))  # noqa: E731  signs are free
    assert sorted(key(r.deviation, r.whitened) for r in out) == sorted(key(d, v) for d, v in zip(deviations, w))
    signs = {tuple(np.sign(np.array(r.whitened) / v)) for r in out for d, v in zip(deviations, w) if d == r.deviation and np.allclose(np.abs(r.whitened), np.abs(v))}
    assert len(signs) == 1  # the same for all rows
    assert all(np.allclose(r.explained, shares, rtol=1e-9) for r in out) and out[0].identity_error < 1e-9
    values = np.array([r.whitened for r in out])
    assert abs(np.cov(values.T, bias=True) - np.eye(4)).max() < 1e-9
    assert whitening.whiten(table.where("false")).count() == whitening.whiten(table.where("vec_id >= 1000")).count() == 0


def test_whitening_of_degenerate_vectors(spark):
    """Copies only, a flat dimension, another length, and values whose squares need more than 64 bits."""
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [5.0, 2.0, 4.0]), (5, [2.0, 2.0, 9.0]), (6, [2.0**50, 0.0, 0.0, 1.0]), (7, [-(2.0**50), 0.0, 0.0, 2.0])]
    out = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert out[1].whitened == [None, None] and out[1].explained == [0.0, 0.0] and (out[1].n, out[1].deviation, out[1].identity_error) == (2, 0, None)
    assert [x is None for x in out[3].whitened] == [False, False, True] and out[3].n == 3 and out[3].identity_error < 1e-9
    assert out[6].deviation is None and abs(abs(out[6].whitened[0]) - 1) < 1e-12 and abs(out[6].explained[0] - 1) < 1e-12


def test_whitening_does_not_depend_on_partitions(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = ({r.vec_id: (r.deviation, r.whitened, r.explained) for r in whitening.whiten(t).collect()} for t in (table.coalesce(1), table.repartition(7)))
    assert one.keys() == many.keys()
    assert all(one[i][0] == many[i][0] and one[i][2] == many[i][2] and np.allclose(one[i][1], many[i][1], atol=1e-12) for i in one)


def test_op12(spark):
    out = queries.op12_whitening(spark, SF)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = out.collect()
    assert Counter(r.component for r in rows) == {k: 500 for k in range(1, 33)}
    assert all(r.identity_error < 1e-4 for r in rows)


# ---- divergence


def test_transducer_numbers_terms_in_order():
    rng = random.Random(1)
    terms = {lang: sorted({"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)}) for lang in ("", "de", "en")}
    pairs = [(lang, t) for lang, own in terms.items() for t in own]
    one = Transducer.unpack(built(pairs).pack())
    texts = [(lang, t) for lang in terms for t in {x for own in terms.values() for x in own} | {b"zz", "日日日日日日日日日".encode()}]
    data = b" ".join(t for _, t in texts)
    ends = np.cumsum([len(t) + 1 for _, t in texts]) - 1
    starts = ends - [len(t) for _, t in texts]
    roots = np.array([one.roots[lang] for lang, _ in texts])
    found = one.ordinals(CLASS[np.frombuffer(data, np.uint8)], starts, ends, roots[:, 0], roots[:, 1])
    place = {p: k for k, p in enumerate(pairs)}
    assert found.tolist() == [place.get(x, -1) for x in texts]
    # No two states have the same terms after them.
    right = {}
    for state in range(len(one.final)):
        arcs = [(int(a % 256), int(t)) for a, t in zip(one.arcs, one.targets) if a // 256 == state]
        right[state] = frozenset({b""} if one.final[state] else ()) | {bytes([b]) + rest for b, t in arcs for rest in right[t]}
    assert len(set(right.values())) == len(right)


def test_transducer_of_nothing():
    one = Transducer.unpack(built([]).pack())
    assert one.roots == {} and one.ordinals(np.array([97, 0]), np.array([0]), np.array([1]), np.array([-1]), np.array([0])).tolist() == [-1]


def brute_audit(docs, least):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(lang or "", source or "", term.findall((text or "").translate(fold))) for lang, source, text in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        df = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        counts = {s: Counter() for s in sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)}
        for _, source, ts in (r for r in rows if r[0] == lang):
            counts[source].update(t for t in ts if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:10]
            out |= {(lang, s, part, item, v, k) for part, own in (("pair", pairs), ("term", terms)) for k, (item, v) in enumerate(own, 1)}
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(5)
    words = ["Alpha", "beta", "gämma", "ÄRGER", "日本", "x", "zz", "don't", "a1b", "É", "tail"] + [f"{a}{b}" for a in "abcdefg" for b in "hijklm"]
    docs = [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "sé", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(160)]
    docs += [("fr", "s1", "seul"), ("fr", "s9", None), ("en", "only", None), ("xx", "s1", ""), ("de", "s1", "lang " * 30000)] + [("en", "s2", "copy of a text")] * 12
    return docs


def test_audit_against_brute_force(spark, audited, monkeypatch):
    table = spark.createDataFrame([(*d, 1, "t", 2) for d in audited], "lang string, source string, text string, shard int, term string, n int").repartition(6)
    want = brute_audit(audited, 10)
    assert {tuple(r) for r in divergence.audit(table).collect()} == want
    monkeypatch.setattr(divergence, "RANGE_TERMS", 12)
    vocabulary = divergence.vocabulary(table)
    assert vocabulary.select("shard").distinct().count() > 3
    assert {tuple(r) for r in divergence.audit(table).collect()} == want
    assert {tuple(r) for r in divergence.audit(table, shipped=0).collect()} == want  # terms go to the transducers
    assert divergence.audit(table.where("false")).count() == 0
    few = table.where("lang = 'fr'")
    assert {tuple(r) for r in divergence.audit(few, shipped=0).collect()} == brute_audit([d for d in audited if d[0] == "fr"], 10)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    for text in (b"", b"short", b"one two three four five six seven eight", b"x" * 100, b"ab " + b"y" * 50 + b" cd", b"." * 60):
        pieces = list(divergence._pieces(text))
        assert b"".join(pieces) == text and [t for p in pieces for t in divergence._TERM.findall(p)] == divergence._TERM.findall(text)


def test_exact_shares():
    counts = np.array([0, 5, 10**12, 4 * 10**15])
    total, terms = 9 * 10**15, 7
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]


def test_op13(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    out = queries.op13_source_divergence(spark, SF)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert {tuple(r) for r in out.collect()} == set(con.sql(queries.ORACLE_SQL["op13_source_divergence"]).fetchall())
