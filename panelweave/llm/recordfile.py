"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

``path/data`` holds the files, ``path/index`` an index of their records (Parquet, in their order): file,
offset, length, document id, token count, checksum of the ids and how many ids stand before. It is made
by reading the files once, so every checksum has been verified when it is there. ``read_at_offsets``
reads any records by it, in any order, without touching the rest of a file.

A data file is a sequence of frames. A frame is, little-endian,

    uint64 length of the payload
    uint32 masked CRC-32 of those eight bytes
    payload: int64 document id, uint32 bytes per id (2 or 4), then the ids as that wide unsigned integers
    uint32 masked CRC-32 of the payload
    one byte 0x0A

mask(c) = rotate c right by 15 bits, plus 0xA282EAD8, modulo 2^32: a checksum of data that hold
checksums stays a good one. A frame's last byte is the line end that Spark's text writer puts after
every row: frames are rows of one binary column, so the files go through Spark's own committer to
any store Spark can write, and a task that is run again leaves no half file. Documents are sorted by
id over all files; ``part-00000`` has the smallest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PIECE_BYTES, Vocabulary, _worker
from .common import discard, record_batch, slices, small_batches, store, text_bytes, work_path

#: Fixed values of the frame: the checksum's mask and the id that stands for a null document id.
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
#: Files are about ``file_bytes`` large up to this number, and hold this many bytes of text at most (but for one text).
MOST_FILES, LARGEST_FILE = 100_000, 512 << 20
_HEAD, _U32, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qI")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """One frame without its last byte; ``ids`` are ``width`` bytes each."""
    payload = _PAYLOAD.pack(NULL_ID if doc_id is None else doc_id, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _U32.pack(masked(zlib.crc32(length))), payload, _U32.pack(masked(zlib.crc32(payload)))))


class CorruptRecord(ValueError):
    """A length or payload that doesn't agree with its checksum, or a file that ends in a frame."""


def frames(data: bytes | memoryview):
    """``(offset, bytes of the frame, doc_id, ids)`` of every frame of a file, ids as an array of
    little-endian uint32; raises CorruptRecord."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        if at + 12 > end:
            raise CorruptRecord(f"the file ends in the head of the frame at {at}")
        length, crc = _HEAD.unpack_from(view, at)
        if masked(zlib.crc32(view[at : at + 8])) != crc:
            raise CorruptRecord(f"length of the frame at {at}")
        stop = at + 12 + length
        if stop + 5 > end or length < 12 or view[stop + 4] != 10:
            raise CorruptRecord(f"bounds of the frame at {at}")
        payload = view[at + 12 : stop]
        if masked(zlib.crc32(payload)) != _U32.unpack_from(view, stop)[0]:
            raise CorruptRecord(f"payload of the frame at {at}")
        doc_id, width = _PAYLOAD.unpack_from(payload)
        if width not in (2, 4) or (length - 12) % width:
            raise CorruptRecord(f"width of the ids at {at}")
        yield at, stop + 5 - at, None if doc_id == NULL_ID else doc_id, np.frombuffer(payload[12:], f"<u{width}").astype("<u4")
        at = stop + 5


def write_token_files(docs: DataFrame, path: str, vocabulary: Vocabulary, end_id: int | None = 2, file_bytes: int = 12 << 20) -> str:
    """Writes every row of ``docs`` (``doc_id, text``) as a frame below ``path/data``, then the index
    below ``path/index``; returns ``path``.

    The number of files follows from the bytes of text: about ``file_bytes`` of text each, up to
    ``MOST_FILES`` files, then larger ones; a file is read by one task. Rows of one id are spread over files
    by their texts. Ids take two bytes where the vocabulary allows it. Null and empty texts have ``end_id`` alone (none, if that is None);
    null ids come first; rows that repeat an id stand in the order of their texts; an empty table
    writes no record. Other columns play no part."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(text_bytes()), F.count("*")).first()
    files = max(1, min(MOST_FILES, max(-(-(total[0] or 0) // file_bytes), -(-total[1] // 200_000))), -(-(total[0] or 0) // LARGEST_FILE))
    shared = spark.sparkContext.broadcast(vocabulary)
    narrow = max(len(vocabulary.tokens) - 1, end_id or 0) < 1 << 16
    tail = b"" if end_id is None else _U32.pack(end_id)

    def framed(doc_id, ids):
        return frame(doc_id, np.frombuffer(ids, "<u4").astype("<u2").tobytes(), 2) if narrow else frame(doc_id, ids)

    def run(batches):
        encoder = _worker(shared.value)
        for batch in slices(batches, PIECE_BYTES):
            ids = encoder(batch.column(1).to_pylist())
            out = [framed(d, x + tail) for d, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # an id that many rows bear is cut into ranges by the beginnings of its texts, whose order is the texts' own
    start = F.coalesce(F.substring("text", 1, 64), F.lit(""))
    ordered = docs.repartitionByRange(files, "doc_id", start).sortWithinPartitions("doc_id", "text")
    with small_batches(spark):
        ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    found = store(_scan(spark, path), "token-index")
    with_starts(found).write.parquet(f"{path}/index")
    discard(found)
    return path


_READ = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_READ_DDL = "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the files below ``path``: ``file, offset, length`` (of the frame), ``doc_id,
    n_tokens, ids_crc32, start``."""
    return spark.read.schema(_READ_DDL + ", start long").parquet(f"{path}/index")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Reads all files below ``path``, checks every checksum and returns the index with ``inside``, the ids
    before a record in its file, instead of ``start``."""
    schema = _READ.append(pa.field("inside", pa.int64()))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, inside = [], 0
                for at, size, doc_id, ids in frames(memoryview(data.as_buffer())):
                    rows.append((name, at, size, doc_id, len(ids), zlib.crc32(ids), inside))
                    inside += len(ids)
                for i in range(0, len(rows), 10_000):
                    yield record_batch(schema, **dict(zip(schema.names, map(list, zip(*rows[i : i + 10_000], strict=True)), strict=True)))

    return _files(spark, path).mapInArrow(run, _READ_DDL + ", inside long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids array<long>`` of every record below ``path``, checksums checked."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for data in batch.column(1):
                rows = [(d, x.astype(np.int64)) for _, _, d, x in frames(memoryview(data.as_buffer()))]
                for i in range(0, len(rows), 1000):
                    yield record_batch(schema, doc_id=[d for d, _ in rows[i : i + 1000]], ids=[x for _, x in rows[i : i + 1000]])

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def read_at_offsets(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``file, offset, doc_id, ids array<long>`` of the records ``wanted(file, offset)``, such as a sample or
    a shuffled part of the index; frames in between are skipped. A place wanted twice is read twice."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for name, data, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(data.as_buffer())
                for i in range(0, len(offsets), 1000):
                    some = offsets[i : i + 1000]
                    got = [read_at(view, o) for o in some]
                    yield record_batch(schema, file=[name] * len(some), offset=some, doc_id=[d for d, _ in got], ids=[x.astype(np.int64) for _, x in got])

    # a file's records are no more than its bytes
    places = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return _files(spark, path).join(places, "file").select("file", "content", "offsets").mapInArrow(run, "file string, offset long, doc_id long, ids array<long>")


def read_at(data: bytes | memoryview, offset: int) -> tuple[int | None, np.ndarray]:
    """The record whose frame begins at ``offset`` of a file, as the index has it."""
    length, _ = _HEAD.unpack_from(data, offset)
    _, _, doc_id, ids = next(frames(memoryview(data)[offset : offset + 17 + length]))
    return doc_id, ids


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def with_starts(index: DataFrame) -> DataFrame:
    """``start`` in place of ``inside``: the ids of all records before, in the order of files and offsets.
    Sums of whole files, a row each (``MOST_FILES`` or, of large ones, a few thousand a TB), are added up first."""
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(F.broadcast(per_file), "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def token_file_digests(docs: DataFrame, vocabulary: Vocabulary, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as token files (below ``path``, or the shared folder), reads them back and
    returns ``doc_id, start, n_tokens, ids_crc32, file, offset`` from the index of what was read, one row per
    row of ``docs``; cases as in ``write_token_files``."""
    spark = docs.sparkSession
    path = write_token_files(docs, path or work_path(spark, "token-files"), vocabulary, end_id)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")
