"""Benchmark decontamination by canonical templates.

Texts become templates: numbers, names and units give way to typed placeholders, other words are lower-cased. Windows of
``WIDTH`` template tokens are hash-joined with those of the benchmark, so that a question with other numbers and names is
found too. A capital letter at the beginning of a sentence doesn't tell a name from a word, so such a token is tried as
both: a window that has one gives two templates. A window of fewer than ``LITERALS`` ordinary words would fit anything, so it
keeps its numbers, names and units as they are. An item of fewer than ``WIDTH`` tokens is one window of its own length.
Windows that lie on one diagonal (document position less item position) are one alignment, for either reading of the item; an
alignment counts only if the slots agree: each value of the item stands for one value of the document, and the other way
round.

Before the join each task drops windows whose hash is not in a bitmap of the benchmark's hashes. The bitmap has a fixed
size (``FILTER_BITS``), whatever the benchmark's; a larger benchmark lets more windows through, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.tables import durable
from lexitide.llm.words import _BASE, _BYTE, LONG_WORD, SLICE, digest, joined, mix, powers, windows

WIDTH, LITERALS, ENOUGH = 8, 3, 13
FILTER_BITS = 1 << 23
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons "
    "ms s second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh w kw watt watts volt volts"
).split()

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))
_FOUND = "doc: {id}, at: bigint, width: int, hash: bigint, slots: array<string>, reading: int"


def _hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(_BASE, len(folded))
    total = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(_BYTE[folded] * up[: len(folded)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        h[k] = digest(folded[starts[k] : ends[k]].tobytes())
    return h


def _unit_hashes() -> np.ndarray:
    data, _ = joined([u.encode() for u in UNITS])
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return _hashes(np.frombuffer(data, np.uint8), np.concatenate(([0], ends[:-1] + 1)), ends)


_units = _unit_hashes()


def template(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens (runs of letters and digits), the hash of each in the template and of each as it is, which are slots, and which may be.

    A token that begins with a digit is a number; one that begins with a capital is a name, or may be one where it opens a
    sentence; a unit is one of ``UNITS`` after a number of the same sentence. A token longer than a slice of the data is cut.
    """
    out, at, n, before = [], 0, len(data), True
    while at < n:
        end = min(n, at + SLICE)
        while at + SLICE // 2 < end < n and _ALNUM[data[end - 1]] and _ALNUM[data[end]]:
            end -= 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], _ALNUM[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            h = _hashes(_FOLD[raw], s, e)
            head, follow = raw[s], raw[np.minimum(s + 1, len(raw) - 1)]
            stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
            opens = stops[s] > stops[np.concatenate(([0], e[:-1]))]
            opens[0] |= before
            number = (head >= 48) & (head <= 57)
            capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (follow >= 0x80) & (follow <= 0x9E)
            name = capital & ~opens
            unit = np.isin(h, _units)
            unit[1:] &= number[:-1] & ~opens[1:]
            unit[0] = False
            kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
            out.append((s + at, e + at, kind, h, number | name | unit, capital & opens))
            before = bool(stops[-1] > stops[e[-1]])
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def template_windows(rows: DataFrame, id_col: str, text_col: str, widths: list[int], literals: int, allowed: np.ndarray | None = None) -> DataFrame:
    """``doc``, ``at`` (token number), ``width``, ``hash``, ``slots``, ``reading`` of the windows of each text.

    Of a benchmark (``allowed`` not given) a text has windows of the largest width, or the whole of a shorter text is one
    window. Of documents all windows of all ``widths`` are taken whose hash is in the bitmap ``allowed``. Slots are the
    texts of all tokens of the window that are placeholders, null for ordinary words. ``reading`` is 1 where capitals that
    open a sentence are names, else 0; a window without any is given once, but of a benchmark in both readings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).cast(pa.binary()), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1 << 20:
                    size += len(texts[end].as_py() or b"")
                    end += 1
                data, bounds = joined(texts[at:end].to_pylist())
                starts, ends, h, own, sure, maybe = template(data)
                first, opening = np.searchsorted(starts, bounds), np.concatenate(([0], np.cumsum(maybe)))
                readings = [(0, h, sure), (1, np.where(maybe, _NAME, h), sure | maybe)]
                for width, (reading, kinds, slot) in ((w, r) for w in widths for r in readings):
                    ordinary = np.concatenate(([0], np.cumsum(~slot)))
                    where, hashes = windows(kinds, first, width)
                    _, exact = windows(own, first, width)
                    poor = ordinary[where + width] - ordinary[where] < literals
                    hashes = mix(np.where(poor, exact ^ _NUMBER, hashes) + np.uint64(width))
                    whose = np.searchsorted(first, where, "right") - 1
                    if allowed is not None:
                        bit = hashes & np.uint64(FILTER_BITS - 1)
                        keep = (allowed[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                        if reading:
                            keep &= (opening[where + width] > opening[where]) & ~poor
                    else:
                        keep = (first[whose + 1] - first[whose] == width) | (width == max(widths))
                    where, hashes, whose = where[keep], hashes[keep], whose[keep]
                    slots = [[data[starts[k] : ends[k]].decode("utf-8", "replace") if slot[k] else None for k in range(w, w + width)] if slot[w : w + width].any() else [] for w in where.tolist()]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose + at)), pa.array(where - first[whose]), pa.array(np.full(len(where), width, np.int32)), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(where), reading, np.int32))], names=["doc", "at", "width", "hash", "slots", "reading"])
                at = end

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string")).mapInArrow(run, _FOUND.format(id=kind))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id_col``, ``item_col``, ``matched`` and ``item_tokens``, ``first_token`` and ``last_token`` (of the document), ``changed`` (slots differ).

    One row for each document and item with a consistent alignment that covers at least 13 tokens of the item, or half
    of a shorter item's tokens, or all of an item of fewer than eight tokens. The best alignment is given. Windows and items
    of fewer than ``LITERALS`` ordinary words must be the same, numbers and names included. Null and empty
    texts have no windows. Of an item id with several texts each is searched. Rows with a null id take no part; rows of
    one document id are one document. Empty tables give an empty result.
    """
    text = F.col(item_text_col).cast("string")
    items = benchmark.where(F.col(item_col).isNotNull() & text.isNotNull()).select(F.struct(F.col(item_col).alias("item"), F.xxhash64(text).alias("variant")).alias("__id"), text.alias("__text")).dropDuplicates(["__id"])
    asked = durable(template_windows(items, "__id", "__text", list(range(1, width + 1)), LITERALS))
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, mask in asked.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m")).collect():  # at most FILTER_BITS / 64 rows
        bits[word] = mask & (1 << 64) - 1
    widths = sorted(r.width for r in asked.select("width").distinct().collect())  # at most ``width`` rows
    found = template_windows(docs.where(F.col(id_col).isNotNull()), id_col, text_col, widths, LITERALS, bits)
    total = asked.groupBy(F.col("doc").alias("item")).agg(F.max(F.col("at") + F.col("width")).alias("item_tokens"))
    met = found.join(asked.select(F.col("doc").alias("item"), F.col("at").alias("item_at"), "width", "hash", F.col("slots").alias("asked"), F.col("reading").alias("item_reading")), ["hash", "width"])
    pairs = met.select("doc", "item", "width", "item_reading", (F.col("at") - F.col("item_at")).alias("diagonal"), "at", F.expr("array_distinct(filter(transform(slots, (s, i) -> struct(get(asked, i) as old, s as new)), p -> p.new is not null))").alias("pairs"))
    aligned = pairs.distinct().groupBy("doc", "item", "width", "diagonal", "item_reading").agg(F.array_sort(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))  # as many windows as an item has
    agreeing = aligned.where("size(pairs) = size(array_distinct(pairs.old)) and size(pairs) = size(array_distinct(pairs.new))")
    covered = F.expr("aggregate(ats, struct(0L as n, -1L as upto), (a, x) -> struct(a.n + x + width - greatest(x, a.upto) as n, x + width as upto), a -> a.n)")
    scored = agreeing.select("doc", "item", covered.alias("matched"), F.element_at("ats", 1).alias("first_token"), (F.element_at("ats", -1) + F.col("width") - 1).alias("last_token"), F.exists("pairs", lambda p: ~p.old.eqNullSafe(p.new)).alias("changed"))
    enough = scored.join(total, "item").where(f"matched >= least({ENOUGH}, item_tokens / 2)").withColumn("item", F.col("item.item"))
    best = enough.groupBy("doc", "item").agg(F.max_by(F.struct("matched", "item_tokens", "first_token", "last_token", "changed"), F.struct("matched", ~F.col("changed"), -F.col("first_token"))).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "x.*")
