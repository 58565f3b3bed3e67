"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most two bits share at least six of
them (the guaranteed minimum), so of the four pairs of neighbouring positions at least two agree whole. The postings
are therefore kept by two such pairs (four positional bytes, six keys a fingerprint): postings by single bytes hold
one fingerprint in 256, and tallying them would grow with the square of the table. Within a posting the shared
positional bytes of each pair are tallied, pairs below the minimum are dropped, and the rest verified bit by bit.

Equal fingerprints are one entry. A posting of more than ``most`` different fingerprints is not tallied pair by pair:
two fingerprints differ in at most two bits exactly if some value lies within one bit of both, so its entries meet
at their 65 such values, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.graph import components
from lexitide.llm.tables import durable
from lexitide.llm.words import bucket_of, expand, squeeze, window_hashes, words

MAX_BITS = 2
MIN_MATCHES = 8 - MAX_BITS
_GROUPS = list(combinations(range(4), 2))


def _fingerprint(text: bytes | None, width: int) -> int:
    own = (text or b"").lower().split()
    if not own:
        return 0
    hashed = xxhash.xxh64_intdigest
    line = b" ".join(own)
    if len(own) < width:
        values = [hashed(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        values = [hashed(line[a:b], 42) for a, b in zip(starts[: len(own) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]
    return _majority(np.array(values, np.uint64))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):  # sums of 255 rows fit a byte
        part = h[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp``: the SimHash of the text's ``width``-word shingles (A-Z lower-cased, repeats counted).

    A text of fewer words is one shingle; a null, empty or blank text has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.fromiter((_fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _keys(fp: F.Column) -> F.Column:
    """Which two pairs of positions, and their four bytes."""
    part = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    return F.array(*[F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for k, (i, j) in enumerate(_GROUPS)])


def _tally(fps: np.ndarray) -> np.ndarray:
    """Links of one posting: pairs that share enough positional bytes and are verified, one row for each link."""
    a, b = np.triu_indices(len(fps), 1)
    x = fps[a] ^ fps[b]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = shared >= MIN_MATCHES
    a, b, x = a[near], b[near], x[near]
    near = np.bitwise_count(x) <= MAX_BITS
    return np.stack([fps[a[near]], fps[b[near]]], 1)


def _spanning(links: np.ndarray) -> np.ndarray:
    """A forest with the same components, so that a posting of many alike fingerprints emits few rows."""
    if len(links) < 2:
        return links
    nodes, ends = np.unique(links, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, ends[:, 0], root[ends[:, 1]])
        np.minimum.at(least, ends[:, 1], root[ends[:, 0]])
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    far = root != np.arange(len(nodes))
    return np.stack([nodes[far], nodes[root[far]]], 1)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; a run of equal keys may go on in the next batch."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        out = [_spanning(_tally(np.sort(fps[a:b]))) for a, b in zip(cuts, [*cuts[1:], len(keys)]) if b - a > 1]
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        keys, fps = (np.concatenate((old, new.to_numpy(zero_copy_only=False))) for old, new in zip((keys, fps), batch.columns))
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield links(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
    yield links(keys, fps)


def links(fps: DataFrame, most: int = 512) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all different values of column ``fp`` that differ in at most two bits.

    Not every pair is returned, but the components are those of all pairs.
    """
    entries = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    sizes = entries.groupBy("key").count().where("count > 1")
    met = durable(entries.join(sizes, "key"))
    few = met.where(F.col("count") <= most).select("key", "fp")
    tallied = few.repartition("key").sortWithinPartitions("key").mapInArrow(_postings, "a long, b long")
    hot = met.where(F.col("count") > most).select("fp").distinct()
    near = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)]))
    balls = hot.select("fp", near.alias("z")).groupBy("z").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")  # at most 65 lie within one bit
    chained = balls.select(F.explode(F.expr("transform(sequence(2, size(fps)), i -> struct(fps[i - 1] as a, fps[i - 2] as b))")).alias("x")).select("x.*").distinct()
    return tallied.unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col``, ``fp`` (long) and ``component_id``: the smallest id among rows reachable over links of two bits or fewer.

    Every row is returned, repeated rows too. Rows with equal fingerprints are linked, blank and null texts by
    fingerprint 0. A null id is never the smallest; a component of null ids alone has a null id. An empty table
    gives an empty result.
    """
    rows = durable(fingerprints(docs, id_col, text_col, width))
    entries = durable(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(links(entries.select("fp")))
    rooted = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# ---- similarity of word shingles ------------------------------------------------------------------------------------

#: Postings of at most ``SMALL`` entries give all their pairs at once; larger ones are decided in two rounds, both exact.
SMALL = 8
SKETCH_BITS, SAMPLED = 22, 16
_SLACK = 1e-9  # a product such as 0.8 n may exceed its whole value by a rounding error


def _shingle_set(text: bytes | None, width: int) -> np.ndarray:
    _, _, h = words((text or b"").lower())
    # fewer words than a shingle: the whole sequence
    return np.unique(window_hashes(h, min(width, max(1, len(h)))))


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                np.add.at(counts, _shingle_set(t.as_py(), width) >> np.uint64(64 - SKETCH_BITS), 1)
        parts = counts.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([squeeze(x, np.uint32) for x in parts], pa.binary())], names=["part", "counts"])

    return run


def _add_counts(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    n = (1 << SKETCH_BITS) // 64
    total = sum(expand(x, n, np.uint32).astype(np.int64) for x in table["counts"].to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([squeeze(np.minimum(total, 65535), np.uint16)], pa.binary())], names=["part", "counts"])


def _sketch(rows: DataFrame, width: int) -> bytes:
    """How often shingles occur, by the leading bits of their hash, in every ``SAMPLED``-th document.

    It only fixes an order of all shingles, common ones last. Any order gives the same result, so a sample will do.
    """
    some = rows.where(F.xxhash64("id") % SAMPLED == 0).select("text").mapInArrow(_counts(width), "part int, counts binary")
    parts = {r.part: bytes(r.counts) for r in some.groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()}
    n = (1 << SKETCH_BITS) // 64
    return squeeze(np.concatenate([expand(parts[k], n, np.uint16) if k in parts else np.zeros(n, np.uint16) for k in range(64)]), np.uint16)


def _profiles(width: int, similarity: float, sketch: bytes):
    """A hash of the shingle set, its fingerprint and size, and its rarest shingles: two alike sets share one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = expand(sketch, 1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            whole, fps, sizes, rare = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                h = _shingle_set(t.as_py(), width)
                n = len(h)
                first = n - ceil(similarity * n - _SLACK) + 1
                whole.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                fps.append(_majority(h) if n else 0)
                sizes.append(n)
                rare.append(h[np.lexsort((h, counts[h >> np.uint64(64 - SKETCH_BITS)]))[:first]].tobytes())
            kinds = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, fps)), pa.array(sizes, pa.int32()), pa.array(rare, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kinds], names=["id", "whole", "fp", "n", "rare"])

    return run


_POST = pa.schema([("key", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])
_POST_DDL = "key int, hashes binary, ids binary, sizes binary, places binary"


def _post(buckets: int):
    """Postings of the rarest shingles, with set sizes and the shingle's place in its set, by ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column(2)]
            each = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
            h = np.frombuffer(b"".join(raw), np.uint64)
            if not len(h):
                continue
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), each)
            sizes = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32), each)
            places = (np.arange(len(h)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
            order = np.argsort(h, kind="stable")
            own = bucket_of(h[order], buckets)
            cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
            out = [(int(own[i]), *[x[order[i:j]].tobytes() for x in (h, ids, sizes, places)]) for i, j in zip(cuts, [*cuts[1:], len(h)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _POST)], schema=_POST)

    return run


def _may_be_alike(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be alike if the first they share is at places ``i`` and ``j``."""
    return np.minimum(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - _SLACK


def _join_posts(similarity: float):
    """Pairs of small postings; of larger ones the pairs with the smallest id, and the entries for the second round."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        h, ids, sizes, places = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("hashes", np.int64), ("ids", np.int64), ("sizes", np.int32), ("places", np.int32)))
        order = np.lexsort((ids, h))
        h, ids, sizes, places = h[order], ids[order], sizes[order], places[order]
        cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.append(cuts, len(h)))
        pairs, large = [np.zeros((0, 2), np.int64)], np.zeros(len(h), bool)
        for n in np.unique(length[length > 1]).tolist():
            at = cuts[length == n][:, None]
            if n <= SMALL:
                a, b = np.triu_indices(n, 1)
            else:
                a, b = np.zeros(n - 1, np.int64), np.arange(1, n)
                large[(at + np.arange(n)).ravel()] = True
            x, y = np.broadcast_to(at + a, (len(at), len(a))).ravel(), (at + b).ravel()
            x, y = (z[_may_be_alike(sizes[x], sizes[y], places[x], places[y], similarity)] for z in (x, y))
            pairs.append(np.stack([ids[x], ids[y]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        no = pa.nulls(len(pairs), pa.int64())
        out = [pa.concat_arrays([x, pa.array(y)]) for x, y in zip((pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), no), (ids[large], np.zeros(large.sum(), np.int64), h[large]))]
        more = [pa.concat_arrays([pa.nulls(len(pairs), pa.int32()), pa.array(x[large])]) for x in (sizes, places)]
        return pa.table([*out, *more], names=["a", "b", "shingle", "n", "place"])

    return run


def _cross(similarity: float):
    """All pairs of a posting that are not yet in one component and can be alike."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        ids, roots, n, place = (table[c].to_numpy()[order] for c in ("id", "root", "n", "place"))
        ends = np.searchsorted(n, n / similarity + _SLACK, "right")
        out = [np.zeros((0, 2), np.int64)]
        for k in range(len(ids) - 1):
            at = np.arange(k + 1, ends[k])
            at = at[(roots[at] != roots[k]) & _may_be_alike(n[k], n[at], place[k], place[at], similarity)]
            if len(at):
                out.append(np.stack([np.minimum(ids[at], ids[k]), np.maximum(ids[at], ids[k])], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_set(t.as_py(), width) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _alike(similarity: float):
    """Of verified pairs a forest for each task, which has the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros((0, 2), np.int64)
        for batch in batches:
            kept = []
            for one, other, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(x, "V5"), np.frombuffer(y, "V5")
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    shared = len(a) + len(b) - len(set(a.tolist()) | set(b.tolist()))
                    if shared >= similarity * (len(a) + len(b) - shared):
                        kept.append((one, other))
            if kept:
                links = np.concatenate((links, np.array(kept, np.int64)))
            if len(links) > 1 << 20:
                links = _spanning(links)
        links = _spanning(links)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def _verified(rows: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links that connect what the alike ones of ``pairs`` connect."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = durable(rows.join(asked, "id", "left_semi").select("id", "text").mapInArrow(_shingles(width), "id long, shingles binary"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return durable(both.select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long"))


def _near_fingerprints(entries: DataFrame) -> DataFrame:
    """Pairs of ids that connect all entries whose fingerprints differ in at most two bits, by the byte-position index."""
    first = durable(entries.groupBy("fp").agg(F.min("id").alias("id")))
    equal = entries.join(first.select("fp", F.col("id").alias("a")), "fp").where("a <> id").select("a", F.col("id").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col`` and ``component_id``: the smallest id reachable over pairs with Jaccard similarity of ``width``-word shingles.

    Equal shingle sets are one entry. Entries whose SimHash fingerprints link by the byte-position index meet first. Two
    bits are far fewer than alike sets may differ in, so the index alone misses pairs. Sets of at least this similarity share one of their rarest shingles (so many that
    the others are too few), in whatever order all shingles are taken, so postings of these miss no pair. In a posting of
    more than ``SMALL`` entries each first meets the smallest id; then all entries that are not in one component yet meet
    each other, however many. Pairs whose sizes and places in their sets rule the similarity out are passed over; every
    other is verified on the shingle sets themselves (40-bit hashes). Texts of fewer words than a shingle are one
    shingle; blank texts equal each other. Rows with a null id are left out; equal ids are one document.
    """
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = durable(rows.mapInArrow(_profiles(width, similarity, _sketch(rows, width)), "id long, whole long, fp long, n int, rare binary"))
    entries = durable(known.groupBy("whole").agg(F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("fp", "n", "rare")]))
    posted = entries.select("id", "n", "rare").mapInArrow(_post(buckets), _POST_DDL)
    met = durable(posted.groupBy("key").applyInArrow(_join_posts(similarity), "a long, b long, shingle long, n int, place int"))
    pairs = durable(met.where("shingle is null").select("a", "b").unionByName(_near_fingerprints(entries.select("fp", "id"))).distinct())
    first = _verified(rows, pairs, width, similarity)
    roots = components(first)
    large = met.where("shingle is not null").select("shingle", F.col("a").alias("id"), "n", "place")
    large = large.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = large.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    rest = large.join(open_, "shingle").groupBy("shingle").applyInArrow(_cross(similarity), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = durable(rest)
    if not rest.isEmpty():
        roots = components(first.unionByName(_verified(rows, rest, width, similarity)))
    least = entries.select("whole", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("whole", F.coalesce("root", "id").alias("component_id"))
    return known.select("id", "whole").join(least, "whole").select(F.col("id").alias(id_col), "component_id")
