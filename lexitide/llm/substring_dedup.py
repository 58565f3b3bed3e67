"""Substring deduplication: Rabin-Karp hashes of every word window, met in Spark by hash range.

1. Each task hashes all windows of its rows, keeps for each hash its smallest document (so that a window which
   a third of all documents hold leaves a task once) and sends sorted, packed hashes to ranges of the hash space.
2. Each range finds the smallest document of every hash and answers to the group of each larger document.
3. Texts meet the answers for their group; repeated windows merge into maximal intervals of words, which go.

Volume: about 7 bytes a window, the texts once, and 10 bytes for each repeated window. Nothing goes to the driver.
Windows of w words are equal if their 64-bit hashes are; among n windows a false match has probability n*n/2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexitide.llm.words import bucket_of, expand, hashed_ids, joined, pack, squeeze, unpack, windows, words

CHUNK_WORDS = 1_000_000
_SENT = "key int, n int, hashes binary, owner binary, n_ids int, ids binary"
_FIELDS = pa.schema([("key", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("owner", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])


def _groups(ids: np.ndarray, groups: int) -> np.ndarray:
    return hashed_ids(ids).astype(np.int64) % groups


def _rows(keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """A row for each key: its hashes in order, and whose they are."""
    order = np.lexsort((hashes, keys))
    keys, hashes, ids = keys[order], hashes[order], ids[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        own, owner = np.unique(ids[a:b], return_inverse=True)
        yield int(keys[a]), int(b - a), pack(hashes[a:b]), squeeze(owner, np.uint32), len(own), squeeze(own, np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)] if rows else [pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, h, o, k, own in zip(*(table[c].to_pylist() for c in ("n", "hashes", "owner", "n_ids", "ids"))):
        hashes.append(unpack(h, n))
        ids.append(expand(own, k, np.int64)[expand(o, n, np.uint32)])
    return np.concatenate(hashes), np.concatenate(ids)


def _repeats(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document of each hash, and the pairs that a smaller document has too."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    least = ids[first][np.cumsum(first) - 1]
    new = first.copy()
    new[1:] |= ids[1:] != ids[:-1]
    later = new & (ids > least)
    return hashes[first], ids[first], hashes[later], ids[later]


def _flush(held: list[tuple[np.ndarray, np.ndarray]], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    if held:
        h, d, again, whose = _repeats(*(np.concatenate(x) for x in zip(*held)))
        yield _batch([*_rows(bucket_of(h, buckets), h, d), *_rows(buckets + _groups(whose, groups), again, whose)])


def _hash_windows(width: int, buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(ids):
                end, n = at, 0
                while end < len(ids) and n < 1 << 20:
                    n += len(texts[end].as_py())
                    end += 1
                data, bounds = joined(texts[at:end].to_pylist())
                starts, _, h = words(data)
                first = np.searchsorted(starts, bounds)
                where, w = windows(h, first, width)
                held.append((w, ids[at:end][np.searchsorted(first, where, "right") - 1]))
                size, at = size + len(w), end
                if size >= CHUNK_WORDS:
                    yield from _flush(held, buckets, groups)
                    held, size = [], 0
        yield from _flush(held, buckets, groups)

    return run


def _meet(buckets: int, groups: int):
    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # answered within a task
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(np.asarray(table["key"]) - buckets, pa.int32()), *(table[c].combine_chunks() for c in _FIELDS.names[1:])], schema=_FIELDS)])
        _, _, again, whose = _repeats(*_read(table))
        return pa.Table.from_batches([_batch([*_rows(_groups(whose, groups), again, whose)])])

    return run


def _cut(width: int, keep: list[str], lines: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, ids = _read(answers)
        order = np.argsort(ids, kind="stable")
        hashes, ids = hashes[order], ids[order]
        out: dict[str, list] = {k: [] for k in ("n_words", "starts", "ends", "kept")}
        for doc, text in zip(texts["__row_id"].to_pylist(), texts["__row_text"].cast(pa.binary()).to_pylist()):
            own = (text or b"").split()
            a, b = (np.searchsorted(ids, [doc, doc + 1]) if doc is not None and doc < 2**63 - 1 else (np.searchsorted(ids, doc), len(ids)) if doc is not None else (0, 0))
            starts, ends, kept = [], [], text if lines else b" ".join(own)
            if b > a and len(own) >= width:
                begin, _, h = words(text)
                cut = np.flatnonzero(np.isin(_all(h, width), hashes[a:b]))
                if len(cut):
                    breaks = np.flatnonzero(np.diff(cut) > width)
                    starts = cut[np.concatenate(([0], breaks + 1))].tolist()
                    ends = (cut[np.concatenate((breaks, [len(cut) - 1]))] + width).tolist()
                    edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(own)]
                    if lines:
                        place = np.append(begin, len(text)).tolist()  # words go with the white space after them
                        bounds = [0, *(place[x] for x in edges[1:-1]), len(text)]
                        kept = b"".join(text[bounds[i] : bounds[i + 1]] for i in range(0, len(bounds), 2))
                    else:
                        kept = b" ".join([w for i in range(0, len(edges), 2) for w in own[edges[i] : edges[i + 1]]])
            for k, v in (("n_words", len(own)), ("starts", starts), ("ends", ends), ("kept", kept)):
                out[k].append(v)
        kinds = {"n_words": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
        return pa.table({**{c: texts[c] for c in ("__row_id", *keep)}, **{k: pa.array(out[k], t) for k, t in kinds.items()}, "kept": pa.array(out["kept"], pa.binary()).cast(pa.string())})

    return run


def _all(hashes: np.ndarray, width: int) -> np.ndarray:
    return windows(hashes, np.array([0, len(hashes)]), width)[1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, keep: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """Remove every word that a window covers whose words also start in a document with a smaller id.

    ``docs`` needs an integer id and a text; other columns are left out but those in ``keep``, whose names must differ
    from the result's. Returns for each row ``id_col``, these, ``n_words``, ``starts`` and ``ends`` (maximal removed intervals of word positions, end excluded) and ``kept``
    (the words that stay, joined by one space). Null or empty texts, and texts shorter than a window, have no
    windows and lose nothing. A row with a null id is neither smaller nor larger than another: it loses nothing
    and removes nothing. Rows with equal ids do not remove each other's words, but both lose what a smaller id has.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * groups
    rows = docs.select(F.col(id_col).cast("long").alias("__row_id"), F.col(text_col).cast("string").alias("__row_text"), *[F.col(f"`{c}`") for c in keep])
    long_enough = rows.where(F.col("__row_id").isNotNull() & (F.octet_length("__row_text") >= 2 * width - 1))
    sent = long_enough.select("__row_id", "__row_text").mapInArrow(_hash_windows(width, buckets, groups), _SENT)
    answers = sent.groupBy("key").applyInArrow(_meet(buckets, groups), _SENT)
    keyed = rows.withColumn("__group", F.expr(f"cast(pmod(xxhash64(__row_id), {groups}) as int)"))  # as _groups
    kinds = StructType([StructField("__row_id", LongType()), *(docs.schema[c] for c in keep), *StructType.fromDDL("n_words long, starts array<long>, ends array<long>, kept string")])
    cut = keyed.groupBy("__group").cogroup(answers.groupBy("key")).applyInArrow(_cut(width, list(keep), lines), kinds)
    return cut.withColumnRenamed("__row_id", id_col)
