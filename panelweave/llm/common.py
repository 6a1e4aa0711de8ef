"""Shared pieces: work tables in the cluster's shared folder, words, hashing, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: anything but the space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (as in tests, on one machine) a temporary folder
    stands in; on a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="panelweave-"))
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/panelweave/{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while work tables are written: texts and sets of thousands of rows at once fill a worker.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession):
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS`` for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there,
    and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = work_path(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``store`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            remove_path(t.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case): ``name``, or with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(col: str = "text"):
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- words and hashes (NumPy side)

#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHasher:
    """64-bit hashes of words, kept in a dictionary of bounded size."""

    def __init__(self, limit: int = 250_000):
        import xxhash

        self.limit, self.known, self.digest = limit, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.digest
        if len(known) > self.limit:
            known.clear()
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    out[i] = known[w] = digest(w)
        return np.array(out, dtype=np.uint64)


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


_SHINGLE_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    acc = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        acc = mix64(acc * _SHINGLE_STEP + hashes[j : n - width + 1 + j])
    acc.sort()
    keep = np.empty(len(acc), dtype=bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


# ---------------------------------------------------------------- Arrow helpers


def slices(batches, limit_bytes: int = 8 << 20, limit_rows: int = 2048):
    """Record batches cut so that a slice has few rows and a bounded size, unless one row is larger."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, min(limit_rows, int(n * limit_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema)
