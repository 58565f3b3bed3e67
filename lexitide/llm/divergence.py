"""Divergence between the sources of a language, over the terms that enough of its documents hold.

The kept terms, sorted by range, become minimal acyclic transducers: one a range of about ``RANGE_TERMS`` terms, in one task
each. A term's ordinal is its place in its range, so (range, ordinal) is in the order of the terms. All texts then pass
through the transducers a second time and are counted by ordinal. Where all transducers together are no larger than
``SHIPPED_BYTES``, every task has them; beyond that terms are counted as they are, added up, and streamed through the
transducer of their range. Counts travel packed, a row for each source and block of ``BLOCK_TERMS`` ordinals; sources are
compared in these blocks, so a language that holds most of the table is many tasks; only sums travel on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitide.llm.tables import durable
from lexitide.llm.transducer import CLASS, Builder, Transducer
from lexitide.llm.words import joined

LEAST_DOCUMENTS, TOP = 10, 10
RANGE_TERMS, SHIPPED_BYTES, BLOCK_TERMS = 200_000, 32 << 20, 1024
#: Words of a text are taken this many bytes at a time, and counts leave a task when it holds this many.
SLICE, HELD, HELD_COUNTS = 4 << 20, 400_000, 8_000_000
ONE = 1_000_000_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


_KINDS = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "shard": pa.int32()}


def _counts(counts: dict[tuple, int], *names: str) -> Iterator[pa.RecordBatch]:
    if counts:
        parts = [pa.array(c, _KINDS[name]) for c, name in zip(zip(*counts), names)]
        parts = [p.cast(pa.string()) if pa.types.is_binary(p.type) else p for p in parts]
        yield pa.RecordBatch.from_arrays([*parts, pa.array(counts.values(), pa.int64())], names=[*names, "n"])


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes that end between terms, or with the text."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and not len(gaps := np.flatnonzero(CLASS[np.frombuffer(text, np.uint8, end - at, at)] == 0)):
            end = min(len(text), 2 * end - at)  # a term of over a slice
        cut = at + int(gaps[-1]) + 1 if end < len(text) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents, how many of each language hold each term."""
    held: dict[str, Counter] = {}
    flat = lambda: {(lang, term): n for lang, own in held.items() for term, n in own.items()}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            held.setdefault(lang, Counter()).update({term for piece in _pieces(text.as_py().lower()) for term in _TERM.findall(piece)})
        if sum(map(len, held.values())) > HELD:
            yield from _counts(flat(), "lang", "term")
            held = {}
    yield from _counts(flat(), "lang", "term")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's terms with their ordinals, and in one more row its transducer and its first term."""
    shard, builder, first, last = TaskContext.get().partitionId(), Builder(), None, []
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("ordinal", pa.int64()), ("transducer", pa.binary())])
    for batch in batches:
        langs, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if langs:
            first = first or (langs[0], terms[0])
            numbers = [builder.add(lang, term.encode()) for lang, term in zip(langs, terms)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(langs), pa.int32()), batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), pa.nulls(len(langs), pa.binary())], schema=schema)
    if first:
        last = [[shard], [first[0]], [first[1]], [builder.count], [builder.done().pack()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(last, schema)], schema=schema)


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``shard, lang, term, ordinal, transducer``: the kept terms; a shard's last row, the only one with a transducer, has its first term and its size."""
    found = _documents(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    kept = durable(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    ranges = -(-kept.count() // RANGE_TERMS) or 1
    return durable(kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_build, "shard int, lang string, term string, ordinal long, transducer binary"))


class _Cells:
    """Counts of ordinals by group (language and source) and range, until they leave packed by blocks."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, shard: int, groups: np.ndarray, ordinals: np.ndarray, counts: np.ndarray | None = None) -> None:
        keys, n = _added((groups.astype(np.int64) << 40) | ordinals, counts)
        self.held.setdefault(shard, []).append((keys, n))
        self.size += len(keys)

    def out(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size <= HELD_COUNTS and not force:
            return
        names, rows = list(self.groups), []
        for shard, parts in self.held.items():
            keys, counts = _added(*(np.concatenate(x) for x in zip(*parts)))
            block = (keys & (1 << 40) - 1) // BLOCK_TERMS
            cut = [0, *(np.flatnonzero(np.diff(block) | np.diff(keys >> 40)) + 1).tolist(), len(keys)]
            for a, b in zip(cut, cut[1:]):
                rows.append((*names[int(keys[a] >> 40)], shard, int(block[a]), int(counts[a:b].sum()), _packed(keys[a:b] & (1 << 40) - 1, counts[a:b])))
        self.__init__()
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 5000]), _CELLS)], schema=_CELLS)


def _added(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts (1 each by default)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])
_CELLS_DDL = "lang string, source string, shard int, block long, n long, cells binary"


def _packed(ordinals: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in a block, two bytes each, and then the counts, in as few bytes as the largest needs."""
    width = np.dtype(f"u{1 << max(0, int(int(counts.max()).bit_length() - 1).bit_length() - 3)}")
    return bytes([width.itemsize]) + (ordinals % BLOCK_TERMS).astype(np.uint16).tobytes() + counts.astype(width).tobytes()


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(cells) - 1) // (2 + cells[0])
    return np.frombuffer(cells, np.uint16, n, 1), np.frombuffer(cells, f"u{cells[0]}", n, 1 + 2 * n).astype(np.int64)


def _recount(packed, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts pass through all transducers; their counts by language, source, range and ordinal."""
    shards = [(shard, Transducer.unpack(x)) for shard, x in packed.value]
    held = _Cells()
    taken: list[tuple[str, str, bytes]] = []

    def pass_through() -> None:
        data, bounds = joined([piece for *_, piece in taken])
        raw = CLASS[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(raw != 0, prepend=False))  # a line end follows every piece
        starts, ends = edge[::2], edge[1::2]
        group = np.array([held.group(lang, source) for lang, source, _ in taken])
        whose, left = np.searchsorted(bounds, starts, "right") - 1, np.arange(len(starts))
        for shard, one in shards:
            roots = np.array([one.roots.get(lang, (-1, 0)) for lang, *_ in taken])[whose[left]]
            found = one.ordinals(raw, starts[left], ends[left], roots[:, 0], roots[:, 1])
            hit = found >= 0
            held.add(shard, group[whose[left[hit]]], found[hit])
            left = left[~hit]
        taken.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            for piece in _pieces(text.as_py()):
                taken.append((lang, source, piece))
                size += len(piece)
                if size >= SLICE:
                    pass_through()
                    size = 0
                    yield from held.out()
    if taken:
        pass_through()
    yield from held.out(force=True)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their keys, added up: one a source and block. A block's counts are held, and no more."""
    key, total, done = None, np.zeros(BLOCK_TERMS, np.int64), []

    def row() -> tuple:
        at = np.flatnonzero(total)
        return (*key, int(total.sum()), _packed(at, total[at]))

    for batch in batches:
        for *own, cells in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
            if own != key:
                if key is not None:
                    done.append(row())
                    total[:] = 0
                key = own
            at, n = _unpacked(cells)
            total[at] += n
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CELLS)], schema=_CELLS)
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(row()), _CELLS)], schema=_CELLS)


def _term_counts(firsts: list[tuple[str, bytes]], shards: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's terms with their counts and the range that each falls into."""
    held: dict[tuple[str, str], Counter] = {}
    shard_of = lambda lang, term: shards[max(0, bisect_right(firsts, (lang, term)) - 1)]
    flat = lambda: {(lang, source, shard_of(lang, term), term): n for (lang, source), own in held.items() for term, n in own.items()}
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            for piece in _pieces(text.as_py().lower()):
                held.setdefault((lang, source), Counter()).update(_TERM.findall(piece))
        if sum(map(len, held.values())) > HELD:
            yield from _counts(flat(), "lang", "source", "shard", "term")
            held = {}
    yield from _counts(flat(), "lang", "source", "shard", "term")


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range: its transducer first, and then the terms that pass through it."""
    one, held = None, _Cells()
    for batch in batches:
        packed = batch.column(5)
        cuts = [*np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(batch)]
        for begin, end in zip([0, *(c + 1 for c in cuts[:-1])], cuts):
            part = batch.slice(begin, end - begin)
            if len(part):
                data, bounds = joined(part.column(3).cast(pa.binary()).to_pylist())
                roots = np.array([one.roots.get(lang, (-1, 0)) for lang in part.column(0).to_pylist()])
                found = one.ordinals(CLASS[np.frombuffer(data, np.uint8)], bounds[:-1], bounds[1:] - 1, roots[:, 0], roots[:, 1])
                hit = found >= 0
                groups = np.array([held.group(lang, source) for lang, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
                held.add(part.column(2)[0].as_py(), groups[hit], found[hit], part.column(4).to_numpy()[hit])
                yield from held.out()
            if end < len(batch):
                one = Transducer.unpack(packed[end].as_py())
    yield from held.out(force=True)


def recount(docs: DataFrame, terms: DataFrame, shipped: int = SHIPPED_BYTES) -> DataFrame:
    """``lang, source, shard, block, n, cells``: occurrences of the kept terms, by blocks of their ordinals."""
    spark, texts = docs.sparkSession, _documents(docs)
    shards = terms.where(F.col("transducer").isNotNull())
    size = shards.agg(F.coalesce(F.sum(F.octet_length("transducer")), F.lit(0))).first()[0]
    if size <= shipped:
        packed = spark.sparkContext.broadcast([(r.shard, bytes(r.transducer)) for r in shards.orderBy("shard").collect()])
        found = texts.mapInArrow(partial(_recount, packed), _CELLS_DDL)
    else:
        firsts = [(r.lang, r.term.encode(), r.shard) for r in shards.select("lang", "term", "shard").orderBy("lang", "term").collect()]
        words = texts.mapInArrow(partial(_term_counts, [x[:2] for x in firsts], [x[2] for x in firsts]), "lang string, source string, shard int, term string, n long")
        words = words.groupBy("lang", "source", "shard", "term").agg(F.sum("n").alias("n")).withColumn("transducer", F.lit(None).cast("binary"))
        both = words.unionByName(shards.select(F.lit("").alias("lang"), F.lit("").alias("source"), "shard", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), "transducer"))
        found = both.repartition(len(firsts), "shard").sortWithinPartitions("shard", F.col("transducer").isNull()).mapInArrow(_through, _CELLS_DDL)
    keys = ("lang", "source", "shard", "block")
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sum_cells, _CELLS_DDL)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) by long division in steps of 1000, exact below 9e15."""
    below = total + 2 * terms
    out, rest = np.zeros_like(counts), counts + 2
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _compare(top: int):
    schema = pa.schema([("source", pa.string()), ("other", pa.string()), ("shard", pa.int32()), ("ordinal", pa.int64()), ("value", pa.int64())])

    def run(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
        """Sums over a block of terms for each two sources, and the ``top`` terms of each source against the language."""
        rows: list[tuple] = []
        sources, totals, terms = groups["source"].to_pylist(), groups["total"].to_pylist(), groups["terms"][0].as_py() if len(groups) else 0
        place = {s: i for i, s in enumerate(sources)}
        counts = np.zeros((len(sources), BLOCK_TERMS), np.int64)
        for source, packed in zip(cells["source"].to_pylist(), cells["cells"].to_pylist()):
            at, n = _unpacked(packed)
            counts[place[source], at] = n
        held = np.flatnonzero(counts.any(0))  # a kept term occurs in some source; a block may begin in another language
        counts, ordinals = counts[:, held], key[2].as_py() * BLOCK_TERMS + held
        p = np.stack([shares(c, n, terms) for c, n in zip(counts, totals)])
        q = shares(counts.sum(0), sum(totals), terms)
        for i, source in enumerate(sources):
            sums = distance(p[i], p).sum(1).tolist()
            rows += [(source, other, None, None, v) for other, v in zip(sources, sums) if other != source]
            f = distance(p[i], q)
            at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            at = at[np.lexsort((ordinals[at], -f[at]))[:top]]
            rows += [(source, None, key[1].as_py(), o, v) for o, v in zip(ordinals[at].tolist(), f[at].tolist())]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, shipped: int = SHIPPED_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language (part ``pair``), and
    the ``top`` terms that it has more of than its language (part ``term``).

    A null language, source or text is an empty one; every row is a document, so repeated rows count each. Ties go to the
    item that comes first by UTF-8 bytes. A language without kept terms has value 0 for every pair, one with a single
    source has no pair. Other columns are left out. An empty table gives an empty result. Counts are exact below 9e15.
    """
    terms = vocabulary(docs, least)
    counts = durable(recount(docs, terms, shipped))
    sizes = terms.where(F.col("transducer").isNull()).groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = _documents(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = durable(found.select("lang", "source", zero("total"), zero("terms")))
    blocks = counts.select("lang", "shard", "block").distinct().join(groups, "lang").toDF("in_lang", "in_shard", "in_block", "source", "total", "terms")
    met = counts.groupBy("lang", "shard", "block").cogroup(blocks.groupBy("in_lang", "in_shard", "in_block"))
    partial_sums = met.applyInArrow(_with_lang(_compare(top)), "lang string, source string, other string, shard int, ordinal long, value long")
    partial_sums = durable(partial_sums)
    others = groups.select("lang", F.col("source").alias("item"))
    sums = partial_sums.where(F.col("other").isNotNull()).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(others, "lang").where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", zero("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "shard", "ordinal")
    tops = partial_sums.where(F.col("other").isNull()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    named = tops.join(terms.where(F.col("transducer").isNull()).select("shard", "ordinal", F.col("term").alias("item")), ["shard", "ordinal"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(named.withColumn("part", F.lit("term")).select(*columns))


def _with_lang(compare):
    """The result of a block with its language."""

    def run(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
        out = compare(key, cells, groups)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * len(out), pa.string()))

    return run
