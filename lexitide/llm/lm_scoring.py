"""Log-bilinear language model trained with noise-contrastive estimation; normalised token log-probabilities.

Tokens are lower-cased words and one end a text. The model predicts a symbol from the three symbols before it: a symbol
is the end, one of the ``TOP`` most frequent words, or one of ``FORMS`` classes of other words by their ending. Within a
class a word has its smoothed share of the class's training tokens (one unseen word more in each class), so the
probabilities of all words after a context sum to one.

Scores are bilinear: s(w, context) = sum_i r(c_i) C_i q(w) + b(w). Products of the small parameter matrices give the
three tables of r C_i q for all symbols, and one batched product gives the normaliser of every context.

In Spark: (1) counts of all training words, met by hash range; (2) all training texts become symbols, a byte a token,
and are dealt by hash into shards of about ``SHARD_TOKENS`` tokens, in an order of their own, so that the result does not
depend on how the rows were partitioned; each round takes noise-contrastive steps in every shard from common parameters,
and ends with their token-weighted mean; a small corpus is gone over until a round has seen ``LEAST_TOKENS``;
(3) one pass over all texts. Counts of the ``HEAD`` most frequent words go to every task; for other words
each task sends packed (hash, document, times) to the hash ranges, and the sums come back by task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.tables import durable
from lexitide.llm.words import bucket_of, expand, joined, mix, pack, squeeze, unpack, words

HEAD = 50_000
SYMBOLS, FORMS, SPAN, WIDTH = 256, 120, 3, 24
TOP = SYMBOLS - FORMS - 1
NOISE, STEP_TOKENS = 5, 20_000
SHARD_TOKENS, LEAST_TOKENS, MOST_PASSES = 4_000_000, 8_000_000, 20
RATES = (0.02, 0.004)  # of the rounds
CHUNK_WORDS = 1_500_000
END = 0x5851F42D4C957F2D  # the hash that stands for the end of a text
_ROW = "key bigint, kind int, chunk bigint, n int, a binary, b binary, c binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_COUNTS, _ASKED, _TEXTS, _ANSWER = range(4)
_tables: dict = {}

_ENDING = np.zeros(256, np.uint8)
_ENDING[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_ENDING[list(b".!?")] = 1
_suffix = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) % np.uint64(FORMS // 3)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def tokenised(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and form class of every token, and the first token of each text (and the end); ends are tokens of class -1."""
    data, bounds = joined(texts)
    data = data.lower()
    s, e, h = words(data)
    raw = np.frombuffer(data, np.uint8)
    mark = _ENDING[raw[e - 1]] if len(e) else np.zeros(0, np.uint8)
    stem = e.copy()
    for _ in range(4):
        stem -= (_ENDING[raw[stem - 1]] > 0) & (stem - s > 1)
    last = raw[stem - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
    before = np.where(stem - s > 1, raw[np.maximum(stem - 2, 0)], 0).astype(np.int64) if len(e) else last
    form = mark.astype(np.int64) * (FORMS // 3) + _suffix[last * 256 + before]
    first = np.searchsorted(s, bounds)
    n = len(texts)
    at = first[1:]  # an end goes in after the last word of each text
    hashes, forms = np.insert(h, at, np.uint64(END)), np.insert(form, at, -1)
    return hashes, forms, first + np.arange(n + 1)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
    """Parts of a batch of about 4 MB of text."""
    texts, at = batch.column(1).cast(pa.binary()), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < 4 << 20:
            size += len(texts[end].as_py() or b"")
            end += 1
        yield at, end, texts[at:end].to_pylist()
        at = end


# ---- counts ------------------------------------------------------------------------------------------------------


def _summed(hashes: np.ndarray, counts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return own, np.bincount(inverse, counts, len(own)).astype(np.int64), forms[first]


def _count_rows(hashes: np.ndarray, counts: np.ndarray, forms: np.ndarray, buckets: int) -> list[tuple]:
    keys = bucket_of(hashes, buckets)  # hashes are in order, so keys are too
    cuts = np.searchsorted(keys, np.arange(buckets + 1))
    return [(k, _COUNTS, -1, int(b - a), pack(hashes[a:b]), squeeze(counts[a:b], np.int64), squeeze(forms[a:b], np.int8)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _read_counts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(unpack(r["a"], r["n"]), expand(r["b"], r["n"], np.int64), expand(r["c"], r["n"], np.int8)) for r in rows]
    return tuple(np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.uint64, np.int64, np.int8)))


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """One packed row for each range of hashes: every word's hash, count and form. ``texts``: id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, part in _texts(batch):
                h, f, _ = tokenised(part)
                held.append(_summed(h, np.ones(len(h)), f))
                size += len(held[-1][0])
                if size > CHUNK_WORDS:
                    yield _rows(_count_rows(*_summed(*(np.concatenate(x) for x in zip(*held))), buckets))
                    held, size = [], 0
        if held:
            yield _rows(_count_rows(*_summed(*(np.concatenate(x) for x in zip(*held))), buckets))

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(_count_rows(*_summed(*_read_counts(table.to_pylist())), buckets))])

    return texts.mapInArrow(run, _ROW).groupBy("key").applyInArrow(merge, _ROW)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def vocabulary(counts: DataFrame) -> dict:
    """Totals by form, and the most frequent words: all down to the lowest level of counts that leaves ``HEAD`` at most."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, c, f = _read_counts(batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, FORMS)), pa.array(np.bincount(f + 1, c, FORMS + 1).astype(np.int64)), pa.array(np.bincount(f + 1, minlength=FORMS + 1))], names=["form", "n", "v"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, n = np.unique(_level(_read_counts(batch.to_pylist())[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], names=["level", "n"])

    above, least = 0, None
    for level, n in sorted(counts.mapInArrow(levels, "level bigint, n bigint").groupBy("level").agg(F.sum("n")).collect(), reverse=True):
        if above + n > HEAD:
            break
        above, least = above + n, level

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, f = _read_counts(batch.to_pylist())
            keep = _level(c) >= least if least is not None else np.zeros(len(c), bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep]), pa.array(f[keep].astype(np.int32))], names=["h", "c", "f"])

    by_form = {r.form: (r.n, r.v) for r in counts.mapInArrow(totals, "form bigint, n bigint, v bigint").groupBy("form").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    head = counts.mapInArrow(frequent, "h bigint, c bigint, f int").toPandas()  # at most HEAD rows
    h, c, f = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["f"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    h, c, f = h[order], c[order], f[order]
    tops = np.flatnonzero(h != np.uint64(END))[:TOP]
    n = np.array([by_form.get(k, (0, 0))[0] for k in range(FORMS)]) - np.bincount(f[tops], c[tops], FORMS)
    v = np.array([by_form.get(k, (0, 0))[1] for k in range(FORMS)]) - np.bincount(f[tops], minlength=FORMS)
    symbol = np.full(len(h), -1)
    symbol[tops] = 1 + np.arange(len(tops))
    order = np.argsort(h)
    every = [x for x in by_form.values()]
    return {"tokens": int(sum(n for n, _ in every)), "distinct": int(sum(v for _, v in every)), "head": h[order], "counts": c[order], "symbols": symbol[order], "shares": np.log10(n + 0.5 * (v + 1)), "top": h[tops]}


def symbols(hashes: np.ndarray, forms: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The end is 0, frequent words follow by rank, then classes of the others."""
    order = np.argsort(top)
    out = np.where(forms < 0, 0, 1 + TOP + forms)
    if len(top):
        at = np.minimum(np.searchsorted(top, hashes, sorter=order), len(top) - 1)
        hit = (top[order[at]] == hashes) & (forms >= 0)
        out[hit] = 1 + order[at[hit]]
    return out


def contexts(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbols 1, 2 and 3 places before each token; ends stand before a text begins."""
    place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    out = np.zeros((SPAN, len(symbol)), np.int64)
    for i in range(SPAN):
        inside = place > i
        out[i, inside] = symbol[np.flatnonzero(inside) - i - 1]
    return out


# ---- model -------------------------------------------------------------------------------------------------------


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"r": rng.normal(0, 0.1, (SYMBOLS, WIDTH)), "q": rng.normal(0, 0.1, (SYMBOLS, WIDTH)), "c": np.stack([np.eye(WIDTH)] * SPAN) * 0.5, "b": np.zeros(SYMBOLS)}


def tables(p: dict[str, np.ndarray]) -> np.ndarray:
    """Scores r(c_i) C_i q(w) of all symbols, for each place of the context."""
    return np.stack([p["r"] @ c @ p["q"].T for c in p["c"]])


def normalisers(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logs of the normalisers of all contexts, by batched products."""
    lift = [np.exp(x - x.max(1, keepdims=True)) for x in t]
    tops = [x.max(1) for x in t]
    out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS), np.float32)
    weight = np.exp(b)
    last = np.ascontiguousarray(lift[2].T, np.float32)
    for i in range(SYMBOLS):
        z = (lift[0][i] * weight * lift[1]).astype(np.float32) @ last
        out[i] = np.log(np.maximum(z, 1e-30)) + tops[0][i] + tops[1][:, None] + tops[2][None, :]
    return out


class Trainer:
    """Noise-contrastive steps with Adam; noise follows the symbols' counts."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, rate: float, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.noise, self.rate, self.rng = noise / noise.sum(), rate, np.random.default_rng(seed)
        self.m, self.v, self.i = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        self.offset = np.log(NOISE * np.maximum(self.noise, 1e-12))
        self.cum = np.cumsum(self.noise)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, t, n = self.p, tables(self.p), len(target)
        grad, bias = np.zeros((SPAN, SYMBOLS * SYMBOLS)), np.zeros(SYMBOLS)
        for j in range(NOISE + 1):
            w = target if j == 0 else np.minimum(np.searchsorted(self.cum, self.rng.random(n)), SYMBOLS - 1)
            s = p["b"][w] - self.offset[w]
            for i in range(SPAN):
                s += t[i][context[i], w]
            pull = (j == 0) - 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            bias += np.bincount(w, pull, SYMBOLS)
            for i in range(SPAN):
                grad[i] += np.bincount(context[i] * SYMBOLS + w, pull, SYMBOLS * SYMBOLS)
        g = grad.reshape(SPAN, SYMBOLS, SYMBOLS) / n
        slopes = {"b": bias / n, "r": sum(x @ p["q"] @ c.T for x, c in zip(g, p["c"])), "q": sum(x.T @ p["r"] @ c for x, c in zip(g, p["c"])), "c": np.stack([p["r"].T @ x @ p["q"] for x in g])}
        self.i += 1
        for k, x in slopes.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.99 * self.v[k] + 0.01 * x * x
            p[k] += self.rate * (self.m[k] / (1 - 0.9**self.i)) / (np.sqrt(self.v[k] / (1 - 0.99**self.i)) + 1e-8)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for at in range(0, len(target), STEP_TOKENS):
            now = order[at : at + STEP_TOKENS]
            self.step(context[:, now], target[now])


def _encoded(top: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _texts(batch):
                h, f, first = tokenised(part)
                own = symbols(h, f, top).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([own[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())], names=["k", "symbols"])

    return run


def _shard(begun: dict[str, np.ndarray], noise: np.ndarray, rate: float, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            cuts = np.unique(np.concatenate((np.searchsorted(first, np.arange(0, first[-1], 10 * STEP_TOKENS)), [len(texts)])))
            parts += [(np.frombuffer(b"".join(texts[x:y]), np.uint8), first[x : y + 1] - first[x]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            n += int(first[-1])
        if n:
            own = Trainer(begun, noise, rate, shard)
            for _ in range(passes):
                for symbol, first in parts:
                    symbol = symbol.astype(np.int64)
                    own.learn(contexts(symbol, first), symbol)
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)] + [np.ones(1)]) * n
            yield pa.RecordBatch.from_arrays([pa.array([shard % 64]), pa.array([shard]), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["g", "shard", "p"])

    return run


def _total(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")  # so that sums come out alike
    return pa.table({"g": table["g"].slice(0, 1), "p": pa.array([np.sum([np.array(x.as_py()) for x in table["p"]], 0).tolist()], pa.list_(pa.float64()))})


def train(texts: DataFrame, vocab: dict) -> dict[str, np.ndarray]:
    """Parameters from all ``texts`` (id, text), whatever their partitions."""
    p = fresh()
    p["b"] = np.log(vocab["symbol_counts"] / vocab["symbol_counts"].sum())
    if not vocab["tokens"]:
        return p
    shards, passes = -(-vocab["tokens"] // SHARD_TOKENS), min(MOST_PASSES, -(-LEAST_TOKENS // vocab["tokens"]))
    known = durable(texts.select(F.xxhash64("id", "text").alias("k"), "text").mapInArrow(_encoded(vocab["top"]), "k long, symbols binary"))
    dealt = durable(known.repartition(shards, "k").sortWithinPartitions("k", "symbols"))
    for rate in RATES:
        parts = dealt.mapInArrow(_shard(p, vocab["symbol_counts"], rate, passes), "g bigint, shard bigint, p array<double>")
        sums = [np.array(r.p) for r in parts.groupBy("g").applyInArrow(_total, "g bigint, p array<double>").sort("g").collect()]  # at most 64 rows
        mean, at, new = np.sum(sums, 0), 0, {}
        for k in sorted(p):
            new[k] = (mean[at : at + p[k].size] / mean[-1]).reshape(p[k].shape)
            at += p[k].size
        p = new
    return p


# ---- scoring -----------------------------------------------------------------------------------------------------


def _score_texts(model: dict, vocab: dict, buckets: int):
    key = float(model["b"].sum() + model["q"].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables:
            _tables.clear()
            t = tables(model)
            _tables[key] = t, normalisers(t, model["b"])
        t, z = _tables[key]
        head, counts, head_symbols, shares = vocab["head"], vocab["counts"], vocab["symbols"], vocab["shares"]
        gain = np.log10(counts + 0.5)
        held: list[tuple] = []
        made = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made, size
            chunk = (TaskContext.get().partitionId() << 24) + made
            ids, nulls, sums = (np.concatenate([x[i] for x in held]) for i in range(3))
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            h, owner = np.concatenate([x[3] for x in held]), np.concatenate([x[4] + b for x, b in zip(held, base)])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            h, owner = h[new], owner[new]
            cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
            rows = [(k, _ASKED, chunk, int(b - a), pack(h[a:b]), squeeze(owner[a:b], np.uint32), squeeze(times[a:b], np.uint32)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            rows.append((buckets + chunk, _TEXTS, chunk, len(ids), squeeze(ids, np.int64), np.ascontiguousarray(sums).tobytes(), nulls.astype(np.uint8).tobytes()))
            held, made, size = [], made + 1, 0
            return _rows(rows)

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b, part in _texts(batch):
                h, f, first = tokenised(part)
                whose = np.repeat(np.arange(b - a), np.diff(first))
                at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                known = head[at] == h if len(head) else np.zeros(len(h), bool)
                symbol = np.where(f < 0, 0, 1 + TOP + f)
                top = known & (f >= 0)
                top[top] = head_symbols[at[top]] > 0
                symbol[top] = head_symbols[at[top]]
                c = contexts(symbol, first)
                logs = (model["b"][symbol] + sum(t[i][c[i], symbol] for i in range(SPAN)) - z[c[0], c[1], c[2]]) / np.log(10)
                tail = symbol > TOP
                logs[tail] -= shares[symbol[tail] - 1 - TOP]
                share = np.where(known, gain[at] if len(head) else 0.0, 0.0)
                n = b - a
                sums = np.stack([np.diff(first), np.bincount(whose, known, n), np.bincount(whose, share, n), np.bincount(whose, logs + np.where(tail, share, 0.0), n)], 1)
                rest = ~known
                held.append((ids[a:b], nulls[a:b], sums, h[rest], whose[rest]))
                size += len(h)
                if size > CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """In a range of hashes: what each text's words add to its logs, and how many of them are known."""
    rows = table.to_pylist()
    h, c, _ = _read_counts([r for r in rows if r["kind"] == _COUNTS])
    out = []
    for r in rows:
        if r["kind"] == _ASKED:
            asked, owner, times = unpack(r["a"], r["n"]), expand(r["b"], r["n"], np.uint32), expand(r["c"], r["n"], np.uint32)
            at = np.minimum(np.searchsorted(h, asked), max(0, len(h) - 1))
            n = np.where(h[at] == asked, c[at], 0) if len(h) else np.zeros(len(asked), np.int64)
            own, inverse = np.unique(owner, return_inverse=True)
            out.append((r["chunk"], _ANSWER, r["chunk"], len(own), squeeze(own, np.uint32), np.bincount(inverse, times * np.log10(n + 0.5), len(own)).tobytes(), squeeze(np.bincount(inverse, times * (n > 0), len(own)), np.uint32)))
        elif r["kind"] == _TEXTS:
            out.append((r["chunk"], *(r[k] for k in _SCHEMA.names[1:])))
    return pa.Table.from_batches([_rows(out)])


def _finish(tokens: int, distinct: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        text = next(r for r in rows if r["kind"] == _TEXTS)
        n = text["n"]
        sums = np.frombuffer(text["b"]).reshape(n, 4).copy()
        for r in sorted((r for r in rows if r["kind"] == _ANSWER), key=lambda r: (r["n"], r["a"], r["b"])):  # one order, one sum
            own, more = expand(r["a"], r["n"], np.uint32), np.frombuffer(r["b"])
            sums[own, 1] += expand(r["c"], r["n"], np.uint32)
            sums[own, 2] += more
            sums[own, 3] += more
        base = sums[:, 2] - sums[:, 0] * np.log10(tokens + 0.5 * (distinct + 1))
        ids = pa.array(expand(text["a"], n, np.int64), mask=np.frombuffer(text["c"], np.uint8).astype(bool))
        return pa.table([ids, pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(base), pa.array(sums[:, 3])], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each text of ``docs``.

    Scores are sums of log10 probabilities: of smoothed word counts (base), and of the model. Both learn from
    ``training`` alone. A null or empty text is one end. Every row is returned, repeated ones too; ids (integers) may be
    null. Without training texts all words are unseen and the model is the fresh one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, learn = (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) for df in (docs, training))
    counts = durable(word_counts(learn, buckets))
    vocab = vocabulary(counts)
    ends = vocab["counts"][vocab["head"] == np.uint64(END)].sum()
    classes = np.maximum(0, 10 ** vocab["shares"] - 0.5)
    tops = np.zeros(TOP)
    known = vocab["symbols"] > 0
    tops[vocab["symbols"][known] - 1] = vocab["counts"][known]
    vocab["symbol_counts"] = np.concatenate(([ends], tops, classes)) + 0.5
    model = train(learn, vocab)
    sent = rows.mapInArrow(_score_texts(model, vocab, buckets), _ROW)
    met = counts.unionByName(sent).groupBy("key").applyInArrow(_meet, _ROW)
    out = met.groupBy("key").applyInArrow(_finish(vocab["tokens"], vocab["distinct"]), "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(vocab["tokens"]).cast("long")).select(id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")
