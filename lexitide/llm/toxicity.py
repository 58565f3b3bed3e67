"""Toxic spans and document scores from a linear-chain conditional random field.

Learning, on the driver, from a bounded sample of labelled documents (``TOXIC_ROWS`` and ``CLEAN_ROWS``, taken by a hash of
the id, equal texts once, texts of at most ``LEARNED_BYTES``): features (a word, its beginnings, its endings) that separate toxic from clean documents label
tokens of toxic documents; the field's weights and transitions are then fitted to these labelled tokens by gradient steps
over forward-backward marginals, and a logistic curve over summaries of the marginals is fitted to the document labels.

Scoring, in Spark over every whole text: forward-backward marginals of each token, exactly, in segments that run side by
side (a segment's transfer matrix carries what comes before it). No row waits for another; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.llm.words import _BASE, _BYTE, SLICE, joined, mix, powers

TOXIC_ROWS, CLEAN_ROWS, LEARNED_BYTES = 500, 2000, 1 << 16
BITS, SEGMENT, STEPS, DECAY = 18, 64, 25, 0.1
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (3, 4, 5)
KINDS = 1 + len(BEGINNINGS) + len(ENDINGS)
#: Least likelihood ratio statistic (twice the log) of a feature that labels tokens, whatever the size of the sample.
CLEAR = 20.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    weights: np.ndarray  # of features, for state 1 less state 0
    start: np.ndarray  # log weights of the first state
    moves: np.ndarray  # log weights of state pairs
    curve: np.ndarray  # the field's bias, then the curve's bias and a coefficient for each summary


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits (other bytes but ASCII's belong to them), and their feature numbers.

    Data is worked on in slices that end between tokens; a run longer than a slice is cut.
    """
    out, at, n = [], 0, len(data)
    lower = data.lower()
    while at < n:
        end = min(n, at + SLICE)
        while at + SLICE // 2 < end < n and _LETTER[lower[end - 1]] and _LETTER[lower[end]]:
            end -= 1
        raw = np.frombuffer(lower, np.uint8, end - at, at)
        inside = np.concatenate(([False], _LETTER[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = powers(_BASE, len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        kinds = np.empty((len(s), KINDS), np.int32)

        def number(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
            return (mix((total[b] - total[a]) * down[a] + np.uint64(0x632BE59BD9B4E019 * (kind + 1) & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int32)

        kinds[:, 0] = number(s, e, 0)
        for k, w in enumerate(BEGINNINGS, 1):  # a shorter token has its whole in place of a longer beginning
            kinds[:, k] = number(s, np.minimum(s + w, e), k)
        for k, w in enumerate(ENDINGS, 1 + len(BEGINNINGS)):
            kinds[:, k] = number(np.maximum(e - w, s), e, k)
        out.append((s + at, e + at, kinds))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, KINDS), np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


def forward_backward(gain: np.ndarray, first: np.ndarray, model: Model, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Marginals of state 1 for tokens of several texts (text i has tokens first[i] to first[i + 1]).

    With ``pairs``, also the expected counts of moves and of first states.
    """
    lengths = np.diff(first)
    texts = np.flatnonzero(lengths)
    lengths, begin = lengths[texts], first[:-1][texts]
    if not len(texts):
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    per = -(-lengths // SEGMENT)
    segment0 = np.concatenate(([0], np.cumsum(per)))
    whose = np.repeat(np.arange(len(texts)), per)
    seg_at = np.arange(segment0[-1]) - segment0[whose]
    where = begin[whose][:, None] + seg_at[:, None] * SEGMENT + np.arange(SEGMENT)
    real = seg_at[:, None] * SEGMENT + np.arange(SEGMENT) < lengths[whose][:, None]
    x = np.where(real, np.exp(np.clip(gain, -30, 30))[np.where(real, where, 0)], 1.0)
    a, n = np.exp(model.moves), segment0[-1]

    def step(f: np.ndarray, t: int, m: np.ndarray) -> np.ndarray:
        g = f @ m
        g[..., 1] *= x[:, t].reshape(-1, *[1] * (g.ndim - 2))
        return g / g.max(-1, keepdims=True) if g.ndim == 2 else g / g.max((-1, -2), keepdims=True)

    transfer = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()  # from the state before a segment to its last state
    for t in range(SEGMENT):
        new = step(transfer, t, a)
        transfer = np.where(real[:, t, None, None], new, transfer)
    # the state before the first token: a row vector that gives the start weights after one move
    before = np.linalg.solve(a.T, np.exp(model.start))
    enter, leave = np.empty((n, 2)), np.empty((n, 2))
    order = np.argsort(-per, kind="stable")
    for k in range(per.max()):
        on = order[: np.searchsorted(-per[order], -k, "left")]
        s = segment0[on] + k
        if k:
            f = np.einsum("ni,nij->nj", enter[s - 1], transfer[s - 1])
            enter[s] = f / f.sum(1, keepdims=True)
        else:
            enter[s] = before
        z = segment0[on + 1] - 1 - k
        if k:
            b = np.einsum("nij,nj->ni", transfer[z + 1], leave[z + 1])
            leave[z] = b / b.sum(1, keepdims=True)
        else:
            leave[z] = 1.0
    fs, bs = np.empty((SEGMENT, n, 2)), np.empty((SEGMENT, n, 2))
    f = enter
    for t in range(SEGMENT):
        f = np.where(real[:, t, None], step(f, t, a), f)
        fs[t] = f
    b = leave
    for t in range(SEGMENT - 1, -1, -1):
        bs[t] = b
        g = b.copy()
        g[:, 1] *= x[:, t]
        g = g @ a.T
        b = np.where(real[:, t, None], g / np.abs(g).max(1, keepdims=True), b)
    both = fs * bs
    state = (both / both.sum(-1, keepdims=True)).transpose(1, 0, 2)
    if not pairs:
        return state[..., 1][real], None, None
    old = np.concatenate((enter[None], fs[:-1]))
    new = bs.copy()
    new[..., 1] *= x.T
    joint = old[..., :, None] * a * new[..., None, :]
    joint /= joint.sum((-1, -2), keepdims=True)
    move = real.T.copy()
    move[0, segment0[:-1]] = False
    return state[..., 1][real], joint[move].sum(0), state[segment0[:-1], 0].sum(0)


def _gain(weights: np.ndarray, kinds: np.ndarray, bias: float) -> np.ndarray:
    gain = np.full(len(kinds), bias, np.float64)
    for k in range(KINDS):
        gain += weights[kinds[:, k]]
    return gain


def _summaries(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: log of the largest marginal and of the expected number and share of toxic tokens."""
    n = np.diff(first)
    some = n > 0
    most, total = np.zeros(len(n)), np.zeros(len(n))
    if some.any():
        most[some] = np.maximum.reduceat(marginals, first[:-1][some])
        total[some] = np.add.reduceat(marginals, first[:-1][some])
    return np.stack([np.log(most + 1e-3), np.log1p(total), np.log(total / np.maximum(n, 1) + 1e-3)], 1)


def _labelled(kinds: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic texts with a feature that clearly separates the two kinds of text."""
    whose = np.repeat(np.arange(len(toxic)), np.diff(first))
    counts = np.zeros((2, 1 << BITS))
    for k in range(KINDS):
        pairs = np.unique(kinds[:, k].astype(np.int64) * len(toxic) + whose)
        for label in (0, 1):
            counts[label] += np.bincount((pairs // len(toxic))[toxic[pairs % len(toxic)] == label], minlength=1 << BITS)
    totals = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    p, all_of = counts.sum(0) / totals.sum(), counts.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.nan_to_num(c * np.log(c / (t * p))) + np.nan_to_num((t - c) * np.log((t - c) / (t * (1 - p)))) for c, t in zip(counts, totals))
    clear = (ratio >= CLEAR) & (counts[1] / totals[1] > 8 * (counts[0] + 0.5) / (totals[0] + 1)) & (all_of > 0)
    return (clear[kinds].any(1) & (toxic[whose] == 1)).astype(np.float64)


def train(texts: list[bytes], toxic: np.ndarray, share: float | None = None, steps: int = STEPS) -> Model:
    """Fit the field to the tokens that ``_labelled`` marks, then the curve to the labels of the texts.

    ``share`` is that of toxic documents among all labelled ones; the curve is moved to it from the sample's.
    """
    data, bounds = joined(texts)
    starts, _, kinds = tokens(data)
    first = np.searchsorted(starts, bounds)
    target = _labelled(kinds, first, toxic) if len(texts) and len(set(toxic.tolist())) == 2 else np.zeros(len(starts))
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros(2), np.log(np.array([[0.95, 0.05], [0.6, 0.4]])), np.zeros(5))
    bias = np.log((target.sum() + 1) / (len(target) + 2))
    opens, inner = first[:-1][np.diff(first) > 0], np.ones(len(target), bool)
    inner[opens] = False
    seen_moves, seen_start = np.zeros((2, 2)), np.array([(target[opens] == 0).sum(), (target[opens] == 1).sum()], float)
    if len(target):
        np.add.at(seen_moves, (target[np.flatnonzero(inner) - 1].astype(int), target[inner].astype(int)), 1)
    m, v = np.zeros(1 << BITS), np.zeros(1 << BITS)
    cuts = np.unique(np.concatenate((np.searchsorted(first, np.arange(0, len(starts), 200_000)), [len(texts)])))
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))  # texts by the 200,000 tokens, to bound memory
    for i in range(1, steps + 1 if target.any() else 1):
        slope, moves, start = -DECAY * model.weights.astype(np.float64), np.zeros((2, 2)), np.zeros(2)
        for x, y in parts:
            own = kinds[first[x] : first[y]]
            marginals, more, began = forward_backward(_gain(model.weights, own, bias), first[x : y + 1] - first[x], model, pairs=True)
            pull = target[first[x] : first[y]] - marginals
            for k in range(KINDS):
                slope += np.bincount(own[:, k], pull, 1 << BITS)
            moves, start = moves + more, start + began
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        model.weights += (0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        model.moves += 0.5 * (seen_moves - moves) / (1 + seen_moves.sum(1, keepdims=True))
        model.start += 0.5 * (seen_start - start) / (1 + seen_start.sum())
    found = [_summaries(forward_backward(_gain(model.weights, kinds[first[x] : first[y]], bias), first[x : y + 1] - first[x], model)[0], first[x : y + 1] - first[x]) for x, y in parts]
    x = np.concatenate([np.ones((len(texts), 1)), np.concatenate([np.zeros((0, 3)), *found])], 1)
    model.curve = np.array([bias, 0, 0, 0, 0.0])
    w = np.zeros(4)
    for _ in range(25):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (toxic - p) - 0.1 * w)
    if share and len(texts) and 0 < share < 1 and 0 < toxic.mean() < 1:
        w[0] += np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    model.curve[1:] = w
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[bytes], np.ndarray, float | None]:
    """At most TOXIC_ROWS and CLEAN_ROWS labelled documents by a hash of the id; equal texts once, nulls and texts above
    LEARNED_BYTES left out, so that what the driver learns from is bounded in bytes too.

    Also the share of toxic ones among all labelled ids. An id with several labels is toxic if one of them is.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    ranked = known.orderBy(F.xxhash64(id_col), id_col)
    ids = ranked.where("__label = 1").limit(TOXIC_ROWS).unionByName(ranked.where("__label = 0").limit(CLEAN_ROWS))
    rows = docs.where(F.octet_length(text_col) <= LEARNED_BYTES).join(F.broadcast(ids), id_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.col("__label").cast("int").alias("y")).toLocalIterator()  # ids: a bounded number
    unlike = {bytes(r.t): r.y for r in sorted(rows, key=lambda r: r.id)}
    return list(unlike), np.array(list(unlike.values()), np.int64), known.agg(F.avg("__label")).first()[0]


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``score`` and ``spans`` if not given), ``score`` (0 to 1) and ``spans``: start and end character offsets of runs of tokens whose marginal is 0.5 or more.

    Null and empty texts have no token: their score is the curve's value at zero and they have no spans. Every row is
    returned, repeated ones too; kept columns, null or not, are passed on. An empty table gives an empty result.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("score", "spans") and (keep is None or f.name in keep)]
    span = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    bias, curve = model.curve[0], model.curve[1:]
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            scores, spans, at = [], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1 << 20:
                    size += len(texts[end].as_py() or b"")
                    end += 1
                data, bounds = joined(texts[at:end].to_pylist())
                starts, ends, kinds = tokens(data)
                first = np.searchsorted(starts, bounds)
                marginals = forward_backward(_gain(weights, kinds, bias), first, model)[0]
                x = np.concatenate([np.ones((end - at, 1)), _summaries(marginals, first)], 1)
                scores.append(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))))
                bad = marginals >= 0.5
                for i in range(end - at):
                    own = np.flatnonzero(bad[first[i] : first[i + 1]]) + first[i]
                    found: list[dict] = []
                    if len(own):
                        raw = np.frombuffer(data, np.uint8, bounds[i + 1] - bounds[i], bounds[i])
                        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
                        for part in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                            found.append({"start": int(chars[starts[part[0]] - bounds[i]]), "end": int(chars[ends[part[-1]] - bounds[i]])})
                    spans.append(found)
                at = end
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(spans, kind)], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
