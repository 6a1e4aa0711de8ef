"""Quality classifier: ordinal cumulative-link (logistic) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
t_0 < t_1 < ... cut its score: P(grade <= j) = sigmoid(t_j - w.x). That gives an expected grade and
the probability of each tail. Features are words (by the root of their share of the text, so that long
texts don't add up the small weights of ordinary words), beginnings of words, what punctuation hangs on
words, and shares of capitals, repeated and distinct words. Only features whose occurrence differs between grades (by a
likelihood ratio test) get a weight.

The model is fit on the driver on a bounded sample of rated documents (``sample`` ratings, those with
the smallest hashes); their features are made in the cluster. Scoring covers every row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import LOWER, fresh, record_batch, slices

BITS = 18
_hash = xxhash.xxh3_64_intdigest
#: Seeds of the hashes of each kind of feature.
WORD, STEM, MARKS = 1, 2, 3
_WORDLIKE = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Places of the share features; hashed ones come after them.
CAPITALS, REPEATED, DISTINCT, SHORT, SHARES = range(5)
#: Lengths, in characters, of the beginnings of words that are features.
STEMS = (3, 5)


class Features:
    """Places and values of a text's features; of those of words only the ones that ``weights``, if
    given, gives a weight."""

    def __init__(self, bits: int = BITS, limit: int = 150_000, weights: np.ndarray | None = None):
        self.size, self.limit, self.known = 1 << bits, limit, {}
        self.used = None if weights is None else weights != 0

    def _of(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """Places whose value is the root of a share, and those whose value is a share; None if neither."""
        size, used = self.size - SHARES, self.used
        if word.isalpha():  # ASCII letters alone
            low, upper, marks = word.lower(), len(word) > 1 and word.isupper(), b""
            stems = [low[:n] for n in STEMS if len(low) > n]
        else:
            core = word.translate(None, _PUNCTUATION)
            low, upper = core.translate(LOWER), len(core) > 1 and core.isupper()
            marks = word.translate(LOWER).translate(None, _WORDLIKE)
            letters = low.decode("utf-8", "replace")
            stems = [letters[:n].encode() for n in STEMS if len(letters) > n]
        # the word itself and, of a longer word, its beginnings: stems that bear many endings
        roots = [SHARES + _hash(low, WORD) % size] if low else []
        roots += [SHARES + _hash(x, STEM) % size for x in stems]
        shares = [SHARES + _hash(marks, MARKS) % size] if marks else []
        if upper:
            shares.append(CAPITALS)
        if used is not None:
            roots, shares = [x for x in roots if used[x]], [x for x in shares if used[x]]
        return (tuple(roots), tuple(shares)) if roots or shares else None

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass").split()
        n, known = len(raw), self.known
        if not n:
            return np.array([SHORT]), np.ones(1, np.float32)
        if len(known) > self.limit:
            known.clear()
        counts = Counter(raw)
        for w in counts:
            if w not in known:
                known[w] = self._of(w)
        roots: dict[int, int] = {}
        shares: dict[int, int] = {}
        for w, c in counts.items():
            if f := known[w]:
                for place in f[0]:
                    roots[place] = roots.get(place, 0) + c
                for place in f[1]:
                    shares[place] = shares.get(place, 0) + c
        values = {w: 3.0 * math.sqrt(c / n) for w, c in roots.items()} | {m: 4.0 * c / n for m, c in shares.items()}
        values |= {REPEATED: 4.0 * sum(map(eq, raw, raw[1:])) / n, DISTINCT: len(counts) / n, SHORT: 1.0 / n}
        return np.fromiter(values.keys(), np.int64, len(values)), np.fromiter(values.values(), np.float32, len(values))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


@dataclass(frozen=True)
class OrdinalModel:
    """``grades`` in order, thresholds between them, and the weights of the hashed features."""

    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> tuple[float, float]:
        """Expected grade, and the probability of the highest grade."""
        s = float(x @ self.weights[at])
        tails = [1.0, *(1 - _sigmoid(t - s) for t in self.thresholds)]
        expected = self.grades[0] + sum((b - a) * p for a, b, p in zip(self.grades, self.grades[1:], tails[1:], strict=False))
        return expected, tails[-1]


def _evidence(rows: list, grades: int, size: int) -> np.ndarray:
    """Likelihood ratio statistic of each feature's occurrence against the grade."""
    seen, total = np.zeros((grades, size)), np.zeros((grades, 1))
    for at, _, y in rows:
        seen[y, at] += 1
        total[y] += 1
    share = seen.sum(0) / total.sum()
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return 2 * (part(seen, total * share) + part(total - seen, total * (1 - share))).sum(0)


def losses(model: OrdinalModel, rows: list) -> np.ndarray:
    """Negative log-likelihood of each row ``(places, values, grade)``."""
    out = []
    for at, x, grade in rows:
        y, s = model.grades.index(grade), float(x @ model.weights[at])
        above = _sigmoid(model.thresholds[y] - s) if y < len(model.thresholds) else 1.0
        below = _sigmoid(model.thresholds[y - 1] - s) if y else 0.0
        out.append(-math.log(max(above - below, 1e-12)))
    return np.array(out)


def _minimum(f, x: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Minimises f, which returns value and gradient, by limited-memory BFGS with backtracking."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, used = -g, []
        for s, y, r in reversed(steps):
            used.append(a := r * (s @ d))
            d = d - a * y
        if steps:
            d = d * ((s0 := steps[-1][0]) @ (y0 := steps[-1][1]) / (y0 @ y0))
        for (s, y, r), a in zip(steps, reversed(used), strict=True):
            d = d + s * (a - r * (y @ d))
        slope, t = float(g @ d), 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        while (new := f(x + t * d))[0] > value + 1e-4 * t * slope and t > 1e-12:
            t /= 2
        s, y = t * d, new[1] - g
        settled = value - new[0] <= tolerance * max(1.0, abs(value))
        x, value, g = x + s, *new
        if settled:
            break
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
    return x


def objective(rows: list, grades: int, size: int, ridge: float):
    """The penalised negative log-likelihood and its gradient, as a function of ``size`` weights, the
    first threshold and the logarithms of the thresholds' distances; rows are ``(places, values, y)``."""
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    sigmoid = lambda v: 0.5 * (1 + np.tanh(0.5 * v))

    def f(params):
        w, gaps = params[:size], np.exp(np.minimum(params[size + 1 :], 30))
        cut = np.concatenate(([-np.inf], params[size] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        s = np.bincount(row, x * w[at], len(rows))
        above, below = sigmoid(cut[y + 1] - s), sigmoid(cut[y] - s)
        p = np.maximum(above - below, 1e-12)
        by_score = (1 - above - below) / len(rows)
        up, down = -above * (1 - above) / p / len(rows), below * (1 - below) / p / len(rows)
        by_cut = np.bincount(y, up, grades)[:-1] + np.bincount(y, down, grades)[1:]
        later = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves all that come after it
        g = np.concatenate((np.bincount(at, x * by_score[row], size) + ridge * w, later[:1], later[1:] * gaps))
        return float(-np.log(p).mean() + 0.5 * ridge * (w @ w)), g

    return f


def fit(rows: list, ridge: float = 1e-5, rounds: int = 300, evidence: float = 12.0, bits: int = BITS) -> OrdinalModel:
    """Fits on rows ``(places, values, grade)``: the minimum of the mean negative log-likelihood plus
    half of ``ridge`` times the squared weights, in at most ``rounds`` steps.

    Features whose likelihood ratio statistic (of occurrence against grade) is under ``evidence`` get
    no weight. Without rows the model has no grade."""
    grades = sorted({g for _, _, g in rows})
    weights = np.zeros(1 << bits)
    if len(grades) < 2:
        return OrdinalModel(tuple(map(int, grades)), (), weights.astype(np.float32))
    rows = [(at, x, grades.index(g)) for at, x, g in rows]
    use = _evidence(rows, len(grades), 1 << bits) >= evidence
    use[:SHARES] = True
    used = np.flatnonzero(use)
    number = np.cumsum(use) - 1
    rows = [(number[at[m := use[at]]], x[m], y) for at, x, y in rows]
    share = np.cumsum(np.bincount([y for _, _, y in rows], minlength=len(grades)))[:-1] / len(rows)
    cut = np.log(share / (1 - share))
    start = np.concatenate((np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))))
    found = _minimum(objective(rows, len(grades), len(used), ridge), start, rounds)
    weights[used] = found[: len(used)]
    cut = found[len(used)] + np.concatenate(([0], np.cumsum(np.exp(found[len(used) + 1 :]))))
    return OrdinalModel(tuple(map(int, grades)), tuple(map(float, cut)), weights.astype(np.float32))


def train(docs: DataFrame, ratings: DataFrame, sample: int = 8000, bits: int = BITS, seed: int = 3, **options) -> OrdinalModel:
    """Fits on ``docs(doc_id, text)`` with ``ratings(doc_id, grade)``; ``options`` as in ``fit``.

    Ratings with a null id or grade are ignored; a document rated more than once has its lowest
    grade; of rows that repeat a rated id one counts, that with the smallest hash of its text; ratings
    of unknown documents play no part. Without ratings the model has no grade."""
    per = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = per.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)  # at most `sample` rows
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])

    def run(batches):
        features = Features(bits)
        for batch in slices(batches):
            f = [features(t) for t in batch.column(2).to_pylist()]
            yield record_batch(schema, doc_id=batch.column(0), grade=batch.column(1), at=[a.astype(np.int32).tobytes() for a, _ in f], x=[v.tobytes() for _, v in f])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    rated = rated.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rated.mapInArrow(run, "doc_id long, grade int, at binary, x binary").toPandas().sort_values(["doc_id", "at"])
    # nothing but the fit holds the features, so that it can let go of those that it leaves out
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), g) for g, a, x in zip(got["grade"].tolist(), got["at"], got["x"], strict=True)]
    del got
    return fit([rows.pop() for _ in range(len(rows))][::-1], bits=bits, **options)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """All rows and columns of ``docs`` with ``expected_grade`` and ``p_top`` (probability of the
    highest grade), from the whole text; null and empty texts have the feature of a short text alone.
    Columns of ``docs`` with these names are replaced. Both are null if the model knows no grade; with one grade p_top is 1."""
    return _scored(docs.drop("expected_grade", "p_top"), model, "expected_grade", "p_top")


def _scored(docs: DataFrame, model: OrdinalModel, *names: str) -> DataFrame:
    """``docs`` with the expected grade and the top grade's probability under two new names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields])
    for name in names:
        schema = schema.add(name, DoubleType())

    def run(batches):
        model = shared.value
        features = Features(int(model.weights.size).bit_length() - 1, weights=model.weights)
        for batch in slices(batches):
            got = [model.score(*features(t)) if model.grades else (None, None) for t in batch.column(place).to_pylist()]
            more = [pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


#: Least probability of the top grade at which a document is kept: on held-out labels a toxic document is
#: as likely to lie between a half and this as a clean one is to lie below it.
LEAST = 0.7


def select(docs: DataFrame, model: OrdinalModel, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose top grade has a probability of ``least`` or more (all rows, if the
    model knows no grade), with the columns of ``docs``, whatever their names."""
    names = [fresh(docs, "expected_grade"), fresh(docs, "p_top")]
    return _scored(docs, model, *names).where(F.coalesce(F.col(names[1]), F.lit(1.0)) >= least).select(*docs.columns)


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` as ratings: 0 low quality, 1 good but toxic, 2 good and
    clean. A null quality gives no rating, a null toxic counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
