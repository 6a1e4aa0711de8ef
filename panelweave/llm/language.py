"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader and an elastic net, then temperature calibration.

Texts are lower-cased, everything but letters becomes one space between words, and n-grams of one
to three characters are hashed into ``2**bits`` places. Document frequencies are counted over all
training rows, in the cluster; one vector per task is all that is shuffled. The weights are fit on
the driver on a bounded sample of the training rows (``sample`` per language, those with the
smallest hashes), a fifth of which is kept out of training to fit the temperature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, record_batch, slices

BITS = 15
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's n-grams, and how often each occurs; none for a text without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    space = codes == 32
    if space.all():
        return np.zeros(0, np.int64), np.zeros(0)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    shift = np.uint64(64 - bits)
    one = codes * np.uint64(0x9E3779B97F4A7C15)
    two = (codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[1:]) * np.uint64(0x9E3779B97F4A7C15)
    three = (two[:-1] ^ (codes[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(np.concatenate((mix64(one) >> shift, two >> shift, three >> shift)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    """``weights[place, language]`` (mostly zero), the idf of each place, and the temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (tf_idf(at, counts, self.idf) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 1 for a text without a letter (and for
        every text, with 0, if no language was learned)."""
        at, counts = grams(text)
        if not len(at):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        p = self.probabilities(at, counts)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(rows: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of ``rows`` (column ``text``) each place occurs, and the number of rows."""

    def run(batches):
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                at, _ = grams(text, bits)
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["place", "n"])

    df, n = np.zeros(1 << bits), 0
    for place, count in rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).toLocalIterator():
        if place < 0:
            n = count
        else:
            df[place] = count
    return df, n


class FTRL:
    """Follow-the-regularised-leader (proximal) with L1 and L2 penalties, one column per class."""

    def __init__(self, size: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at, x: np.ndarray, error: np.ndarray) -> None:
        g = x[:, None] * error[None, :]
        w = self.weights(at)
        square = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(square) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = square


def _softmax(z):
    p = np.exp(z - z.max())
    return p / p.sum()


def train(rows: DataFrame, sample: int = 400, passes: int = 3, bits: int = BITS, seed: int = 5) -> LanguageModel:
    """Fits the model on ``rows(doc_id, text, lang)``: rows whose ``lang`` is null are ignored.

    ``sample`` bounds the rows per language that the weights are fit on; their n-gram counts are
    made in the cluster. At most ``most`` = 1,000 languages are accepted."""
    most = 1000
    rows = rows.where("lang is not null").select("doc_id", "text", "lang")
    languages = sorted(r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count")).limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    df, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    empty = LanguageModel(tuple(languages), np.zeros((1 << bits, len(languages)), np.float32), np.zeros(len(languages)), idf, 1.0)
    if not languages:
        return empty
    # the rows with the smallest hashes of each language: a threshold first, so that the window gets few
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    limit = F.element_at(F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, int((1 << 40) * min(1.0, 2 * sample / c + 64 / c)))]), F.col("lang"))
    near = rows.withColumn("key", key).where(F.col("key") <= limit)
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("r") <= sample)
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            g = [grams(x, bits) for x in batch.column(2).to_pylist()]
            yield record_batch(schema, lang=batch.column(0).cast(pa.string()), key=batch.column(1), at=[a.astype(np.int32).tobytes() for a, _ in g], n=[c.astype(np.int32).tobytes() for _, c in g])

    got = sorted(chosen.select("lang", "key", "text").mapInArrow(run, "lang string, key long, at binary, n binary").collect(), key=lambda r: (r["key"], r["lang"]))
    number = {name: i for i, name in enumerate(languages)}
    data = [(a := np.frombuffer(r["at"], np.int32).astype(np.int64), tf_idf(a, np.frombuffer(r["n"], np.int32), idf), number[r["lang"]]) for r in got if r["at"]]
    fit, calibrate = [d for i, d in enumerate(data) if i % 5], data[::5]
    model, bias = FTRL(1 << bits, len(languages)), FTRL(1, len(languages), l1=0.0)
    zero, one, eye = np.zeros(1, np.int64), np.ones(1), np.eye(len(languages))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(fit)):
            at, x, y = fit[i]
            p = _softmax(x @ model.weights(at) + bias.weights(zero)[0])
            model.update(at, x, p - eye[y])
            bias.update(zero, one, p - eye[y])
    weights, b = model.weights(slice(None)).astype(np.float32), bias.weights(zero)[0]
    logits = [(x @ weights[at] + b, y) for at, x, y in calibrate]
    loss = lambda t: sum(math.log(max(_softmax(z / t)[y], 1e-300)) for z, y in logits)
    temperature = max(np.geomspace(0.02, 20, 121), key=lambda t: (loss(t), -abs(math.log(t)))) if logits else 1.0
    return LanguageModel(tuple(languages), weights, b, idf, float(temperature))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole ``text`` alone.

    ``und`` with score 1 for null texts and texts without a letter. Null and repeated ids stay as
    they are; other columns play no part. The model is broadcast: its size is fixed by ``bits`` and
    the number of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            got = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield record_batch(schema, doc_id=batch.column(0).cast(pa.int64()), lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def select(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has a letter and a language that the model
    knows with probability ``least`` or more (all rows with a letter, if no language was learned)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            got = [shared.value.predict(x) for x in batch.column(place).to_pylist()]
            keep = [(lang != UNKNOWN and p >= least) or (lang == UNKNOWN and p == 0.0) for lang, p in got]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    """Rows that no training sees: crc32 of the id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train_and_predict(docs: DataFrame, sample: int = 400) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from rows that aren't held out."""
    model = train(docs.where(~held_out()), sample)
    return predict(docs, model).withColumn("held_out", held_out())
