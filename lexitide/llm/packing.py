"""Hierarchical residual best-fit packing of tokenised documents into sequences of bounded length.

Each task tokenises its documents, packs their pieces best-fit in decreasing order, and closes bins that are nearly
full. Bins that stay underfull become items: in every round a node of a tree takes those of ``FAN_IN`` nodes of the round
before and packs them best-fit again. A node holds about ``NODE_BINS`` bins: where more are left, a round has more nodes
and deals the bins out anew, until a single node is left or a round saves hardly any bin. So no bin is given up for the
size of a table, and no task grows with it. Only bin numbers and fills travel in these rounds; the token ids stay,
compressed, with the pieces, and meet the result in one join.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.tables import durable
from lexitide.llm.words import expand, squeeze

MAX_TOKENS, END_ID = 4096, 1
NEARLY_FULL = 16
FAN_IN, NODE_BINS = 16, 50_000
#: Rounds of several nodes end when one saves less than this share of its bins.
LEAST_SAVING = 0.001
LOCAL_PIECES, LOCAL_TOKENS, CACHED_WORDS = 200_000, 16_000_000, 250_000
BATCH_PIECES = 2000
_state: dict = {}


#: A word that normalisation leaves as it is and that is one run of letters, and marks after it, which are another run.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write a byte that is no printable letter as the next free character from 256 on.
_LETTERS = {b: chr(256 + b - 94 if b < 161 else 323 if b == 173 else b) for b in range(128, 256)}


class _Words(dict):
    """Ids of words met so far, two generations: words in use move to the younger one, others are forgotten."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def __missing__(self, w: bytes) -> bytes:
        ids = self.older.get(w)
        if ids is None:
            if (m := _PLAIN.fullmatch(w)) is None:
                ids = array("I", self.tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids).tobytes()
            elif m[2]:
                ids = self[m[1]] + self[m[2]]
            else:
                ids = array("I", [t.id for t in self.model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_LETTERS))]).tobytes()
        self[w] = ids
        return ids

    def forget(self) -> None:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


def _folded(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased, as the tokenizer does, but not if it may hold combining marks or special tokens."""
    text = text or b""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def encode(texts: list[bytes | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text. The tokenizer cuts at white space, so words are encoded once each.

    It also cuts letters from marks, so a plain word is its letters, which the model takes as they are, and its marks.
    """
    known = _state.get(path)
    if known is None:
        _state.clear()
        known = _state[path] = _Words(path)
    out = []
    for t in texts:
        out.append(b"".join(map(known.__getitem__, _folded(t).split())))
        known.forget()
    return out


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: items in decreasing order go to the bin with the least room that holds them."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fitting := rooms >> n:
            r = n + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
            bins[b].append(i)
        else:
            r, b = size, len(bins)
            bins.append([i])
        if left := r - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _pack_documents(path: str, size: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("bin", pa.int64()), ("within", pa.int64()), ("fill", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, tokens = TaskContext.get().partitionId() << 40, 0, 0
        held: list[tuple] = []
        end = array("I", [END_ID]).tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made, tokens
            rows = []
            for own in best_fit([p[3] for p in held], size):
                within, fill = 0, sum(held[i][3] for i in own)
                for i in own:
                    rows.append((*held[i], first + made, within, None if within else fill))
                    within += held[i][3]
                made += 1
            for at in range(0, len(rows), BATCH_PIECES):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + BATCH_PIECES]), schema)], schema=schema)
            held, tokens = [], 0

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(docs), 256):
                for doc, ids in zip(docs[at : at + 256], encode(texts[at : at + 256].to_pylist(), path)):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        part = np.frombuffer(ids[a : a + 4 * size], np.uint32)
                        held.append((doc, k, a // 4, len(part), squeeze(part, np.uint32)))
                    tokens += len(ids) // 4
                if len(held) >= LOCAL_PIECES or tokens >= LOCAL_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _pack_bins(size: int):
    """A node's underfull bins become items; ``parts`` keeps which first bins a bin consists of and where they begin."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("bin", "fill", "parts"))), key=lambda x: x[0])
        out = []
        for own in best_fit([fill for _, fill, _ in rows], size):
            parts, fill = [], 0
            for i in own:
                parts += [(p["bin"], p["base"] + fill) for p in rows[i][2]]
                fill += rows[i][1]
            out.append((rows[own[0]][0], fill, [{"bin": b, "base": base} for b, base in parts]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bin", "fill", "parts"])

    return run


def _expand_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        ids = pa.array([expand(x, n, np.uint32).tobytes() for x, n in zip(batch.column(at).to_pylist(), batch.column("length").to_pylist())], pa.binary())
        yield batch.set_column(at, "ids", ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row a piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``ids`` are the piece's token ids, little-endian of 32 bits each; the pieces of a sequence in order of ``offset``,
    joined, are the sequence. ``ids_crc32`` is their checksum.

    A document is its ids and then id 1; only documents above ``max_tokens`` are cut. A null or empty text is the one
    id 1. Repeated rows and rows with a null id are packed like any others. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    made = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary, bin long, within long, fill long"
    pieces = durable(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_pack_documents(tokenizer_path, max_tokens, to_arrow_type(kind)), made))
    is_open = F.col("fill") < max_tokens - NEARLY_FULL
    level = pieces.where(is_open).select("bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("parts"))
    nodes, left = level.agg(F.count_distinct(F.shiftright("bin", 40)), F.count("*")).first()
    done, turn = [level.where(F.lit(False))], 0
    while left:
        turn, nodes = turn + 1, max(-(-nodes // FAN_IN), -(-left // NODE_BINS))
        dealt = level.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(nodes)))
        level = durable(dealt.groupBy("node").applyInArrow(_pack_bins(max_tokens), "bin long, fill long, parts array<struct<bin: bigint, base: bigint>>"))
        now = level.count()
        last = nodes == 1 or left - now < LEAST_SAVING * left and nodes == -(-left // NODE_BINS)
        done.append(level if last else level.where(~is_open))
        if last:
            break
        level = level.where(is_open)
        left = level.count()
    moved = reduce(DataFrame.unionByName, done).select(F.col("bin").alias("sequence_id"), F.explode("parts").alias("part")).select("sequence_id", "part.*")
    offset = (F.coalesce("base", F.lit(0).cast("long")) + F.col("within")).alias("offset")
    placed = pieces.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids", F.coalesce("sequence_id", "bin").alias("sequence_id"), offset)
    out = placed.mapInArrow(_expand_ids, placed.schema)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
