"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

Writing. Payloads are grouped by SHA-1 digest and length; of a group the row with the largest
``page_id`` becomes the response, the others revisit it. A record is a row of one binary column, and
its last line end is the one that Spark's text writer puts after every row, so archives go through
Spark's committer to any store.

Reading. Files are cut at the magic ``WARC/1.0`` by Spark's text reader, which may split them anywhere.
The magic may also stand inside a payload, so each piece is only a candidate record: its header
says where its successor begins. A first pass emits, per block of a file (what one task has read),
each candidate's offset and where the chain from it leaves the block; no body goes further. Pointer
jumping along these links from the start of each file, over log2(blocks) rounds, finds the true
entry of every block; candidates that no chain from the start reaches are payload. A second pass
reads the files again and walks each block from its entry; only the record that crosses a block's end
is shuffled, as one part per block, and put together.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, record_batch, slices, store, work_path

#: Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of a table of repeated payloads, or of blocks, that is still broadcast.
BROADCAST_ROWS = 50_000


def base32_sha1(payload):
    """Column: bare upper-case base32 of the SHA-1 of a binary column."""
    h = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, refers_to`` of every row; refers_to is the
    largest ``page_id`` with an equal payload of at least ``least_bytes`` bytes, null for that row
    itself (for all of them, if rows repeat the id) and for payloads that no other row has. Null
    ids revisit, unless all are null."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    big = pages.where(F.col("payload_bytes") >= least_bytes)
    # a row per digest and task is all that is shuffled; payloads that stand alone go no further
    owners = store(big.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "owners")
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    out = pages.join(owners, ["digest", "payload_bytes"], "left")
    return out.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(F.col("page_id").isNull() | (F.col("owner") != F.col("page_id")), F.col("owner")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> str:
    """Writes one record per row of ``pages(page_id, url, html)`` below ``path`` and returns it.

    A null html is an empty payload; a null url gives no target; blanks and controls in a url are
    percent-encoded; a null ``page_id`` is written as ``null``; rows that repeat a ``page_id`` have
    one record id. Other columns play no part; an empty
    table writes no record. Files are uncompressed, so that a large one is read by many tasks; with
    ``compression='gzip'`` each is compressed as a whole, and read by one."""
    p = revisits(pages, least_bytes)
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts]).cast("binary")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), "\r\n\r\n")
    block = F.concat(http, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "%0A"), " ", "%20")
    head = text(
        MAGIC.decode(),
        "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), "\r\n",
        "WARC-Record-ID: ", name("page_id"), "\r\n",
        f"WARC-Date: {date}\r\n",
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        "WARC-Payload-Digest: sha1:", F.col("digest"), "\r\n",
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        "Content-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length("block").cast("string"), "\r\n\r\n",
    )
    rows = p.withColumn("block", block).select(F.concat(head, "block", F.lit(b"\r\n")).cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", compression).text(path)
    return path


def fields(header: bytes) -> dict[str, str]:
    """Named fields of a record's or message's header, names in lower case."""
    out = {}
    for line in header.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _span(piece: bytes) -> int | None:
    """Bytes from a candidate's magic to its successor's, by its own header; null if it has none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    f = fields(piece[:end])
    length = f.get("content-length", "")
    return len(MAGIC) + end + 8 + int(length) if "warc-type" in f and length.isascii() and length.isdigit() else None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, body``: what stands between magics, in order within a block (the place where the
    task's part of the file begins)."""
    lines = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("body"))


_CANDIDATE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("leaves", pa.int64()), ("bytes", pa.int64())])


def _candidates(lines: DataFrame) -> DataFrame:
    """``file, block, at, leaves, bytes``: per candidate its place in the block and the place, beyond the
    block, to which its chain leads (null, if it breaks off before); per block a row with its bytes."""

    def block_rows(place, sizes, spans):
        # a piece is preceded by its magic; the first of a file is what stands before any magic
        ends = np.cumsum(np.array(sizes, np.int64) + len(MAGIC))
        at = (ends - np.array(sizes, np.int64) - len(MAGIC) - len(MAGIC)).tolist()
        leaves: dict[int, int | None] = {}
        for o, span in zip(reversed(at), reversed(spans), strict=True):
            if span is not None:
                # a place in the block that is no candidate breaks the chain
                n = o + span
                leaves[o] = n if n > at[-1] else leaves.get(n)
        places = sorted(leaves)
        for i in range(0, len(places), 20_000):
            some = places[i : i + 20_000]
            yield record_batch(_CANDIDATE, file=[place[0]] * len(some), block=[place[1]] * len(some), at=some, leaves=[leaves[o] for o in some], bytes=[None] * len(some))
        yield record_batch(_CANDIDATE, file=[place[0]], block=[place[1]], at=[None], leaves=[None], bytes=[int(ends[-1])])

    def run(batches):
        now, sizes, spans = None, [], []
        for batch in slices(batches):
            for f, b, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, b) != now:
                    if now:
                        yield from block_rows(now, sizes, spans)
                    now, sizes, spans = (f, b), [], []
                sizes.append(len(body)), spans.append(_span(body))
        if now:
            yield from block_rows(now, sizes, spans)

    return lines.mapInArrow(run, "file string, block long, at long, leaves long, bytes long")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, base, entry``: each block's place in its file, and the place in the block where the
    first record of the file's chain begins (null, if none does)."""
    found = store(_candidates(_lines(spark, path)), "candidates")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = store(found.where("at is null").select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")), "blocks")
    placed = found.where("at is not null").join(base, ["file", "block"]).select("file", "block", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("leaves")).alias("leaves"), "at")
    placed = store(placed, "chain")
    # pointer jumping: after k rounds, the entries at most 2^k blocks from the start are known
    jumps = placed.where("leaves is not null").select("file", "offset", "leaves")
    entries = store(placed.where("offset = 0").select("file", "offset"), "entries")
    known = entries.count()
    while True:
        more = entries.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        after = store(entries.union(more).distinct(), "entries")
        discard(entries)
        entries, before = after, known
        if (known := entries.count()) == before:
            break
        # as long as the archives: never broadcast
        doubled = jumps.join(jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("then")).hint("merge"), ["file", "leaves"], "left")
        doubled = store(doubled.select("file", "offset", F.coalesce("then", "leaves").alias("leaves")), "jumps")
        discard(jumps)
        jumps = doubled
    # places where a chain ends and no record begins are in no block's candidates
    entry = placed.join(entries, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    out = store(base.join(entry, ["file", "block"], "left"), "block-entries")
    discard(found, base, placed, entries, jumps)
    return out


_RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_DDL = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, payload binary"


class BrokenRecord(ValueError):
    """A record that ends early, or whose payload doesn't have the declared digest."""


def _record(file: str, offset: int, body: bytes, with_payload: bool) -> tuple:
    end = body.index(b"\r\n\r\n")
    f = fields(body[:end])
    block = memoryview(body)[end + 4 : end + 4 + int(f["content-length"])]
    if len(block) < int(f["content-length"]):
        raise BrokenRecord(f"{file} at {offset} ends early")
    declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, size, digest, payload = body.find(b"\r\n\r\n", end + 4), None, declared, None
    if f["warc-type"] in ("response", "revisit") and http >= 0:
        size = int(fields(body[end + 4 : http]).get("content-length", 0))
    if f["warc-type"] == "response":
        payload = block[http - end :] if http >= 0 else block
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if declared and digest != declared:
            raise BrokenRecord(f"{file} at {offset}: payload digest {digest}, declared {declared}")
    return (file, offset, f["warc-type"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), declared, size, digest, bytes(payload) if with_payload and payload is not None else None)


_PART = _RECORD.append(pa.field("head", pa.bool_())).append(pa.field("part", pa.binary()))


def _walk(batches, with_payload: bool):
    """Records of blocks ``file, block, base, entry, body`` in order; of records that cross a block's
    end the parts, with their place in ``offset`` and ``head`` where they begin the record."""
    done, names = [], _PART.names
    place = now = after = None  # the block, the record's place in the file, its successor's
    at, held = 0, []  # the place of the next piece's magic; pieces of the record

    def close(complete: bool):
        if held and complete:
            done.append((*_record(place[0], now, MAGIC.join(held), with_payload), None, None))
        elif held:
            done.append((place[0], now, *[None] * (len(_RECORD.names) - 2), after is not None, MAGIC.join(held)))

    def flush():
        out = record_batch(_PART, **dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))
        done.clear()
        return out

    for batch in slices(batches):
        for f, b, base, entry, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (f, b) != place:
                # only a record whose successor would begin right here ends with the block
                close(after == at)
                place, at, now, after, held = (f, b), base - len(MAGIC), base - len(MAGIC), None, []
                first = None if entry is None else base + entry
            if at == (after if after is not None else first):
                close(after is not None)
                now, held, span = at, [], _span(body)
                if span is None:
                    raise BrokenRecord(f"{f} at {at}: no record's header")
                after = at + span
            held.append(body)
            at += len(MAGIC) + len(body)
        if len(done) >= 500:
            yield flush()
    close(after == at)
    if done:
        yield flush()


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``, found by boundary chains.

    ``payload`` is null for revisits (and unless ``with_payload``); the length and digest of a
    revisit's payload are those its header declares, those of a response are taken from the payload,
    which must agree with the declared digest. A file that doesn't begin with a record has none; a chain
    that ends at a magic without a header is a BrokenRecord. No file gives no row."""
    entries = _entries(spark, path)
    lines = _lines(spark, path)
    if entries.count() <= BROADCAST_ROWS:
        known = lines.join(F.broadcast(entries), ["file", "block"])
    else:
        known = lines.withColumn("seq", F.monotonically_increasing_id()).join(entries, ["file", "block"]).sortWithinPartitions("file", "block", "seq")
    walked = known.select("file", "block", "base", "entry", "body").mapInArrow(lambda batches: _walk(batches, with_payload), _RECORD_DDL + ", head boolean, part binary")
    walked = store(walked, "records")

    def run(batches):
        for batch in slices(batches):
            rows = [_record(f, o, b, with_payload) for f, o, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield record_batch(_RECORD, **dict(zip(_RECORD.names, map(list, zip(*rows, strict=True)), strict=True)))

    # a record's parts: the head, and what the blocks after it have before their entries
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = walked.where("part is not null").select("file", "offset", F.max(F.when(F.col("head"), F.col("offset"))).over(upto).alias("record"))
    parts = walked.where("part is not null").select("file", "offset", "part").join(places.where("record is not null"), ["file", "offset"])
    # the magics between parts were cut off with the pieces
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    body = F.reduce("parts", F.lit(None).cast("binary"), lambda a, x: F.coalesce(F.concat(a, F.lit(MAGIC), x["part"]), x["part"]))
    return walked.where("part is null").drop("head", "part").union(joined.select("file", "record", body.alias("body")).mapInArrow(run, _RECORD_DDL))


def page_records(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri``; cases as in ``write_warc``."""
    spark = pages.sparkSession
    path = write_warc(pages, path or work_path(spark, "warc"), least_bytes)  # several tasks may read a file
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as long)")
    out = read_warc(spark, path, with_payload=False)
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri")
