"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line that isn't empty. Each is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2^32 in every lane: equal for equal
multisets of paragraphs, whatever their order, and kept up to date by adding or subtracting the
vectors of paragraphs that come or go. The vector has two parts: ``DENSE`` lanes from a
cryptographic hash of the paragraph, which decide equality, and ``SKETCH`` lanes, in which each of
the paragraph's three-word shingles counts +1 or -1 in a lane of its hash. The latter are a linear
sketch of the shingle counts, so the cosine of two sketches estimates the documents' likeness
(standard error about 1 / sqrt(SKETCH)).
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHasher, mix64, record_batch, slices, text_bytes

DENSE, SKETCH = 16, 256
_TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Fingerprinter:
    """Fingerprints as vectors of ``DENSE + SKETCH`` uint32."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        """The sum over the paragraphs of ``text``; zero for null, empty and all-newline texts."""
        out = np.zeros(DENSE + SKETCH, np.uint32)
        paragraphs = [p for p in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if p]
        if not paragraphs:
            return out
        digests = b"".join([hashlib.blake2b(p, digest_size=4 * DENSE).digest() for p in paragraphs])
        out[:DENSE] = np.frombuffer(digests, "<u4").reshape(-1, DENSE).sum(0, dtype=np.uint32)
        split = [p.translate(LOWER).split() for p in paragraphs]
        lengths = np.array([len(w) for w in split])
        h = self.hasher([w for words in split for w in words])
        if len(h):
            out[DENSE:] = _sketch(h, lengths[lengths > 0])
        return out


def _sketch(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Signed lane counts of three-word shingles that don't cross paragraphs (shorter paragraphs
    are one shingle)."""
    n = len(h)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # words from here to the paragraph's end
    whole = np.repeat(lengths, lengths)
    ahead = np.concatenate((h, np.zeros(2, np.uint64)))
    with np.errstate(over="ignore"):
        s = h + np.where(left > 1, ahead[1 : n + 1] * _TWO, 0).astype(np.uint64) + np.where(left > 2, ahead[2 : n + 2] * _THREE, 0).astype(np.uint64)
    s = mix64(s[(left >= 3) | ((whole < 3) & (left == whole))])
    lane = (s >> np.uint64(8)).astype(np.int64) % SKETCH
    sign = 1 - 2 * (s & np.uint64(1)).astype(np.int64)
    return np.bincount(lane, sign, SKETCH).astype(np.int64).astype(np.uint32)


def insert(fingerprint: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of the document with the other's paragraphs added."""
    return fingerprint + part


def delete(fingerprint: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of the document with the other's paragraphs removed."""
    return fingerprint - part


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches, not below 0 and below 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[DENSE:].view(np.int32).astype(np.float64) for v in (a, b))
    scale = math.sqrt(float(x @ x) * float(y @ y))
    return min(max(float(x @ y) / scale, 0.0), math.nextafter(1.0, 0.0)) if scale else 0.0


def as_text(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        f = Fingerprinter()
        for batch in slices(batches):
            yield record_batch(schema, doc_id=batch.column(0).cast(pa.int64()), fingerprint=[as_text(f(x)) for x in batch.column(1).to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, range_bytes: int = 4 << 20, most_ranges: int = 8192) -> DataFrame:
    """``of, flag, doc_id, text`` partitioned and sorted so that each row's next one in the order
    of ``doc_id`` follows it: rows of the range ``of`` (flag 0), then the first of the next range
    (flag 1; the first of all after the last). Null ids come first, equal ids in the order of text.

    Ranges are cut at approximate quantiles, so they are even whatever the ids are; what the driver
    sees is one number per range, ``most_ranges`` at most."""
    from pyspark.ml.feature import Bucketizer

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(text_bytes())).first()[0] or 0
    ranges = min(most_ranges, max(128, total // range_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    splits = [-math.inf, *(sorted({float(c) for c in cuts}) or [0.0]), math.inf]
    bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_of", handleInvalid="keep")
    rows = bucket.transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    rows = rows.select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_of").cast("int")).alias("of"), "doc_id", "text")
    heads = sorted(rows.groupBy("of").agg(F.min("doc_id")).collect())
    if not heads:
        return rows.select("of", F.lit(0).alias("flag"), "doc_id", "text")
    before = {of: heads[i - 1][0] for i, (of, _) in enumerate(heads)}
    back = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("of"))
    ids = [x for _, x in heads if x is not None]
    is_head = F.col("doc_id").isNull() | (F.col("doc_id").isin(ids) if ids else F.lit(False))
    plain = F.struct(F.col("of").alias("of"), F.lit(0).alias("flag"))
    places = F.when(is_head, F.array(plain, F.struct(back.alias("of"), F.lit(1).alias("flag")))).otherwise(F.array(plain))
    rows = rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.of", "at.flag", "doc_id", "text")
    return rows.repartition(ranges, "of").sortWithinPartitions("of", "flag", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NEXT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    One row per input row. Null texts count as empty; an empty text stays empty when edited; a
    single document follows itself. Null ids come first and repeated ids follow in the order of
    their texts. Texts are held two at a time."""

    def run(batches):
        f, at, last, done = Fingerprinter(), None, None, []

        def pair(row, text, vector):
            changed = edited(row[1], text)
            e = f(changed)
            done.append((row[0], len(row[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(row[2]), as_text(e), likeness(row[2], e), likeness(row[2], vector)))

        for batch in slices(batches):
            for of, flag, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if flag and last is None:
                    continue  # further rows with the id of the next range's first
                text = text or ""
                vector = f(text)
                if last is not None and of == at:
                    pair(last, text, vector)
                at, last = of, None if flag else (doc_id, text, vector)
            if done:
                yield record_batch(_NEXT, **dict(zip(_NEXT.names, map(list, zip(*done, strict=True)), strict=True)))
                done = []

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, ddl)
