"""Token ids in files of independent zstandard frames, of which a reader decompresses only those it needs.

A file is, from its start: frames of little-endian 32-bit ids, each with a checksum of its own; a skippable frame with the
index of its documents; a skippable frame with the seek table (of each frame the compressed and decompressed size and the
checksum, then their number, a flag byte and a magic number, as in zstandard's seekable format). An empty skippable frame
follows every record. So any zstandard decoder turns a file into its ids, and the files in order of their names into those
of the whole table.

Documents are dealt by ranges of their ids and encoded where they are written, in order, one file after another. Spark's
text writer puts the records into files and commits them, so a lost executor leaves no half of a file; a file is full at
``FILE_RECORDS`` records. A document lies in one file: one of many ids has longer frames, not more than a file holds.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitide.llm.packing import encode
from lexitide.llm.tables import durable, shared_folder

END_ID = 2
FRAME_IDS, FRAME_DOCUMENTS, FILE_RECORDS = 1 << 16, 4096, 256
LEVEL = 3
# Fixed values of the format: magic numbers of skippable frames and of a seek table, and the flag of one with checksums.
INDEX_MAGIC, TABLE_MAGIC, GAP_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x184D2A50
FOOTER_MAGIC, WITH_CHECKSUMS = 0x8F92EAB1, 0x80
#: What the writer puts after each record, which must be text: an empty skippable frame.
GAP = struct.pack("<II", GAP_MAGIC, 0).decode("ascii")
_FOOTER = struct.Struct("<IBI")


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class _Writer:
    """Records of the files of one task."""

    def __init__(self, id_type: pa.DataType, frame_ids: int, file_records: int):
        self.id_type, self.frame_ids, self.most = id_type, frame_ids, file_records - 1
        self.part, self.number = TaskContext.get().partitionId(), 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._begin()

    def _begin(self) -> None:
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []  # id, frame, ids before it there, ids
        self.open: list[bytes] = []
        self.open_ids = 0

    def _frame(self, raw: bytes) -> bytes:
        frame = self.zstd.compress(raw)
        self.seek.append((len(frame) + len(GAP), len(raw), _checksum(raw)))
        return frame

    def _flush(self) -> Iterator[bytes]:
        if self.open:
            raw, self.open, self.open_ids = b"".join(self.open), [], 0
            yield self._frame(raw)

    def _tail(self) -> bytes:
        columns = [pa.array(c, t) for c, t in zip(zip(*self.index), (self.id_type, pa.int32(), pa.int64(), pa.int64()))]
        table, held = pa.RecordBatch.from_arrays(columns, names=["id", "frame", "offset", "n"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(held, table.schema.with_metadata({"part": str(self.part), "number": str(self.number)})) as stream:
            stream.write_batch(table)
        index = self.zstd.compress(held.getvalue().to_pybytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.seek) + _FOOTER.pack(len(self.seek), WITH_CHECKSUMS, FOOTER_MAGIC)
        return struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)) + struct.pack("<II", TABLE_MAGIC, len(entries)) + entries

    def add(self, doc, ids: bytes) -> Iterator[bytes]:
        n = len(ids) // 4
        if self.open_ids + n > self.frame_ids or len(self.open) == FRAME_DOCUMENTS:
            yield from self._flush()
        size = max(self.frame_ids, -(-n // self.most))
        if not self.open and len(self.seek) + -(-n // size) > self.most:
            yield from [b""] * (self.most - len(self.seek))  # up to the number of records at which the file ends
            yield from self.end()
        self.index.append((doc, len(self.seek), self.open_ids, n))
        if n <= self.frame_ids:
            self.open.append(ids)
            self.open_ids += n
        else:
            for at in range(0, len(ids), 4 * size):
                yield self._frame(ids[at : at + 4 * size])

    def end(self) -> Iterator[bytes]:
        yield from self._flush()
        if self.index:
            yield self._tail()
            self.number += 1
            self._begin()


def _records(path: str, end_id: int, id_type: pa.DataType, frame_ids: int, file_records: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer, end = _Writer(id_type, frame_ids, file_records), array("I", [end_id]).tobytes()

    def records() -> Iterator[bytes]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(ids), 256):
                for doc, own in zip(ids[at : at + 256], encode(texts[at : at + 256].to_pylist(), path)):
                    yield from writer.add(doc, own + end)
        yield from writer.end()

    held: list[bytes] = []
    for record in records():
        held.append(record)
        if len(held) == 16:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_records: int = FILE_RECORDS) -> str:
    """Writes every text's ids, and ``end_id`` after them, in ascending order of ``id_col``; returns the folder.

    Without ``path`` it is a new folder in the shared one. A null or empty text has the end id only. Rows with a null id
    come first; rows with equal ids are written one after another. Other columns are left out. An empty table gives a
    folder from which nothing is read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    path = path or os.path.join(shared_folder(spark), f"tokens-{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    # The row's place splits a range even where one id holds a large part of the table.
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "at").sortWithinPartitions("id", "at")
    records = dealt.select("id", "text").mapInArrow(partial(_records, tokenizer_path, end_id, to_arrow_type(docs.schema[id_col].dataType), frame_ids, file_records), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", GAP).option("maxRecordsPerFile", file_records).text(path)
    return path


class TokenFile:
    """A file of ids, read from any seekable object: its tail first, and then the frames that are asked for."""

    def __init__(self, file: BinaryIO):
        self.file, self.zstd, self.decompressed = file, zstandard.ZstdDecompressor(), 0
        end = file.seek(0, os.SEEK_END) - len(GAP)
        frames, flags, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = end - _FOOTER.size - 12 * frames
        self.seek = np.frombuffer(self._read(table, 12 * frames), "<u4").reshape(frames, 3)
        self.begins = np.concatenate(([0], np.cumsum(self.seek[:, 0], dtype=np.int64)))
        (size,) = struct.unpack("<I", self._read(table - 12, 4))
        with pa.ipc.open_stream(self.zstd.decompress(self._read(table - 12 - size, size))) as stream:
            index = stream.read_all()
        meta = index.schema.metadata
        self.part, self.number = int(meta[b"part"]), int(meta[b"number"])
        self.ids = index["id"]
        self.frames, self.offsets, self.lengths = (index[c].to_numpy() for c in ("frame", "offset", "n"))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        """The ids of a frame; an error if they are not those that were written."""
        compressed, size, checksum = self.seek[k].tolist()
        raw = self.zstd.decompress(self._read(int(self.begins[k]), compressed - len(GAP)))
        if len(raw) != size or _checksum(raw) != checksum:
            raise ValueError(f"frame {k} does not have its checksum")
        self.decompressed += 1
        return raw

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """Place in the index and ids of these documents (all by default), each frame decompressed once."""
        known, raw = -1, b""
        for place in range(len(self.lengths)) if places is None else sorted(places):
            k, at, left, parts = int(self.frames[place]), 4 * int(self.offsets[place]), 4 * int(self.lengths[place]), []
            while left:
                if k != known:
                    known, raw = k, self.frame(k)
                parts.append(raw[at : at + left])
                left, k, at = left - len(parts[-1]), k + 1, 0
            yield place, b"".join(parts)


_PLACE = "part int, number int, place int"


def _index(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = TokenFile(pa.BufferReader(content.as_buffer()))
            n = len(file.lengths)
            yield pa.RecordBatch.from_arrays([file.ids.combine_chunks(), pa.array([path] * n), pa.array([file.part] * n, pa.int32()), pa.array([file.number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(file.starts), pa.array(file.lengths)], schema=schema)


def _read(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(batch)
        for content, places in zip(batch.column(0), wanted):
            file, held, size = TokenFile(pa.BufferReader(content.as_buffer())), [], 0
            for place, ids in file.documents(places):
                held.append((place, ids))
                size += len(ids)
                if size > 4 << 20:
                    yield _documents(file, held, schema)
                    held, size = [], 0
            yield _documents(file, held, schema)


def _documents(file: TokenFile, held: list[tuple[int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    places, n = np.array([p for p, _ in held], np.int32), len(held)
    ids = file.ids.combine_chunks().take(pa.array(places))
    return pa.RecordBatch.from_arrays([ids, pa.array([file.part] * n, pa.int32()), pa.array([file.number] * n, pa.int32()), pa.array(places), pa.array(file.starts[places]), pa.array(file.lengths[places]), pa.array([x for _, x in held], pa.binary())], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _schema(id_type: str, path: bool = False, ids: bool = False) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    place = [("part", pa.int32()), ("number", pa.int32()), ("place", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())]
    return pa.schema([("id", to_arrow_type(DataType.fromDDL(id_type))), *[("path", pa.string())][: int(path)], *place, *[("ids", pa.binary())][: int(ids)]])


def index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``id, path, part, number, place, start, n_tokens`` of every document, without decompressing any; ``start`` is in its file."""
    return _files(spark, path).mapInArrow(partial(_index, _schema(id_type, path=True)), f"id {id_type}, path string, {_PLACE}, start long, n_tokens long")


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None, id_type: str = "bigint") -> DataFrame:
    """``id, part, number, place, start, n_tokens, ids`` of all documents, or of those whose id is in the one column of ``wanted``.

    Files are in order of (part, number), documents in order of ``place``. With ``wanted`` only frames that hold such a
    document are decompressed.
    """
    files, out = _files(spark, path), f"id {id_type}, {_PLACE}, start long, n_tokens long, ids binary"
    if wanted is None:
        chosen = files.select("content")
    else:
        places = index(spark, path, id_type).join(wanted.toDF("id").distinct(), "id", "left_semi").groupBy("path").agg(F.collect_list("place").alias("places"))
        chosen = files.join(places, "path").select("content", "places")
    return chosen.mapInArrow(partial(_read, _schema(id_type, ids=True)), out)


def digest(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, from the files: ``start`` counts the ids of all documents before."""
    found = durable(read(spark, path, id_type=id_type).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    sizes = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return found.join(sizes.select("part", "number", before.alias("before")), ["part", "number"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
