"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning.

The index is built without a shuffle: each task turns its rows into shards of up to ``SHARD`` documents,
a row each, with postings sorted by term and document. Within a shard documents are ordered by their
commonest term, so that the ``BLOCK`` neighbours that share block maxima are alike. Global
statistics (document count, mean length, frequencies of the queries' terms) come from the shards.

Queries go over all shards in blocks of bounded size: a block's distinct terms are broadcast, a task
searches its shards one after the other and keeps each query's k best so far, whose last is the
threshold. A few shards are searched first; a query's k-th best score in them is where its threshold
begins in every task. Every list has its maximum per block of documents. A block whose maxima, added up over the
query's lists, stay below the threshold is passed over; in the others the postings of rare terms are
added up, and with the frequent terms' maxima that gives a closer bound; only a block that reaches the
threshold still is scored in full. The tests run for all queries and
blocks of a shard at once. Each shard's k best are merged by (score descending, id ascending).

A term adds its BM25 weight rounded to a multiple of 2^-20, so sums are exact in any order, ties are
true ties, and pruning never changes a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, discard, record_batch, slices, store
from .license import tokens

SHARD, BLOCK = 4096, 64
#: Queries whose postings are added up at once: what that takes stays in the processor's cache.
GROUP = 8
K1, B = 1.2, 0.75
UNIT = float(1 << 20)

_SHARD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64())), ("words", pa.int64()), ("lengths", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])
_SHARD_DDL = "doc_ids array<long>, terms array<long>, dfs array<long>, words long, lengths binary, docs binary, tfs binary"


def _bag(hasher: WordHasher, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms (as int64) of a text and how often each occurs."""
    terms, counts = np.unique(hasher(tokens(text)).view(np.int64), return_counts=True)
    return terms, counts


def build_index(docs: DataFrame, shard: int = SHARD, shard_bytes: int = 24 << 20) -> DataFrame:
    """One row per shard of ``docs(doc_id, text)``; rows without a word are not in any list."""

    def row(bags, ids):
        common = [int(t[c.argmax()]) if len(t) else 0 for t, c in bags]
        order = sorted(range(len(bags)), key=lambda i: (common[i], len(bags[i][0])))
        bags, ids = [bags[i] for i in order], [ids[i] for i in order]
        sizes = [len(t) for t, _ in bags]
        terms = np.concatenate([t for t, _ in bags])
        tfs = np.concatenate([c for _, c in bags]).astype(np.uint32)
        place = np.repeat(np.arange(len(bags), dtype=np.uint32), sizes)
        by_term = np.argsort(terms, kind="stable")
        distinct, dfs = np.unique(terms, return_counts=True)
        lengths = np.array([int(c.sum()) for _, c in bags], np.uint32)
        one = lambda a: pa.array([a], pa.list_(pa.int64()))
        return record_batch(_SHARD, doc_ids=[ids], terms=one(distinct), dfs=one(dfs), words=[int(lengths.sum())], lengths=[lengths.tobytes()], docs=[place[by_term].tobytes()], tfs=[tfs[by_term].tobytes()])

    def run(batches):
        hasher, bags, ids, size = WordHasher(), [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bags.append(_bag(hasher, text)), ids.append(doc_id)
                size += 16 * len(bags[-1][0])
                if len(bags) >= shard or size >= shard_bytes:
                    yield row(bags, ids)
                    bags, ids, size = [], [], 0
        if bags:
            yield row(bags, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARD_DDL)


@dataclass(frozen=True)
class QueryBlock:
    """Queries by number: ``terms`` of all, sorted; ``owner[i]`` lists term numbers of query i. ``least``: scores
    below it are not among a query's best."""

    ids: list
    terms: np.ndarray
    idf: np.ndarray
    frequent: np.ndarray
    queries: np.ndarray
    query_terms: np.ndarray
    least: np.ndarray


class Shard:
    """A shard's postings with their weights, for one block of queries."""

    def __init__(self, row: dict, q: QueryBlock, mean: float):
        self.ids = row["doc_ids"]
        n = self.n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.float64)
        terms, dfs = row["terms"], row["dfs"]
        ends = np.cumsum(dfs)
        at = np.searchsorted(terms, q.terms)
        at[at == len(terms)] = 0
        known = np.flatnonzero(terms[at] == q.terms) if len(terms) else np.zeros(0, np.int64)
        counts = dfs[at[known]]
        take = np.repeat(ends[at[known]] - np.cumsum(counts), counts) + np.arange(counts.sum()) if len(known) else np.zeros(0, np.int64)
        docs = np.frombuffer(row["docs"], np.uint32)[take].astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.uint32)[take].astype(np.float64)
        term = np.repeat(known, counts)
        weight = np.rint(q.idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / mean))) * UNIT)
        # frequent terms: a dense column each; its maxima per block of documents bound it
        column = q.frequent[term]
        dense = column >= 0
        width = int(q.frequent.max(initial=-1)) + 1
        self.dense = np.zeros((self.blocks * BLOCK, width))
        self.dense[docs[dense], column[dense]] = weight[dense]
        self.maxima = self.dense.reshape(self.blocks, BLOCK, width).max(1)
        rare = ~dense
        self.docs, self.weight = docs[rare], weight[rare]
        # rare terms: a list of entries, one for each block of documents, with the block's maximum
        place = term[rare] * self.blocks + self.docs // BLOCK
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        self.first, self.count = first, np.diff(np.append(first, len(place)))
        self.block, self.most = place[first] % self.blocks, np.maximum.reduceat(self.weight, first) if len(first) else self.weight[:0]
        self.size = np.bincount(place[first] // self.blocks, minlength=len(q.terms))
        self.start = np.cumsum(self.size) - self.size
        self.q = q

    def _limits(self, first: int, last: int, best: list, k: int) -> np.ndarray:
        """What a document must score at least to be among the best of queries ``first`` to ``last``."""
        return np.maximum(self.q.least[first:last], [-b[-1][0] if len(b) >= k else 1.0 for b in best[first:last]])

    def search(self, first: int, last: int, best: list, k: int) -> None:
        """Brings ``best[first:last]`` (lists of (-score, id key)) up to date with this shard."""
        q, n, width = self.q, last - first, self.dense.shape[1]
        mine = slice(np.searchsorted(q.queries, first), np.searchsorted(q.queries, last))
        owner, term = q.queries[mine] - first, q.query_terms[mine]
        wanted = np.zeros((n, width))
        column = q.frequent[term]
        wanted[owner[column >= 0], column[column >= 0]] = 1
        owner, term = owner[column < 0], term[column < 0]
        # a block is looked into only if the maxima of all its lists reach the threshold
        size = self.size[term]
        entry = np.repeat(self.start[term] + size - np.cumsum(size), size) + np.arange(size.sum())
        owner = np.repeat(owner, size)
        often = wanted @ self.maxima.T
        limit = self._limits(first, last, best, k)
        alive = np.bincount(owner * self.blocks + self.block[entry], self.most[entry], n * self.blocks).reshape(n, self.blocks) + often >= limit[:, None]
        # of those, rare terms' postings are added up; frequent ones are still bounded by their maxima
        keep = alive[owner, self.block[entry]]
        entry, owner = entry[keep], owner[keep]
        cells = self.blocks * BLOCK
        score = np.empty((n, cells))
        edges = np.searchsorted(owner, np.arange(0, n + GROUP, GROUP))
        for low, i, j in zip(range(0, n, GROUP), edges, edges[1:], strict=False):
            some = score[low : low + GROUP]
            size = self.count[entry[i:j]]
            take = np.repeat(self.first[entry[i:j]] + size - np.cumsum(size), size) + np.arange(size.sum())
            some[:] = np.bincount(np.repeat((owner[i:j] - low) * cells, size) + self.docs[take], self.weight[take], some.size).reshape(some.shape)
        score = score.reshape(n, self.blocks, BLOCK)
        bound = np.where(alive, score.max(2) + often, 0.0)
        # the block with the best bound raises each query's threshold, then all that reach it follow
        done = np.zeros(bound.shape, bool)
        done[np.arange(n), bound.argmax(1)] = True
        for todo in (done & (bound >= limit[:, None]), None):
            if todo is None:
                limit = self._limits(first, last, best, k)
                todo = ~done & (bound >= limit[:, None])
            hits: dict[int, list] = {}
            for block in np.flatnonzero(todo.any(0)).tolist():
                rows = np.flatnonzero(todo[:, block])
                total = score[rows, block] + wanted[rows] @ self.dense[block * BLOCK : (block + 1) * BLOCK].T
                r, d = np.nonzero(total >= limit[rows, None])
                for i, doc, s in zip(rows[r].tolist(), (d + block * BLOCK).tolist(), total[r, d].tolist(), strict=True):
                    if doc < self.n:
                        hits.setdefault(i, []).append((-s, self._key(doc)))
            for i, found in hits.items():
                best[first + i] = sorted(best[first + i] + found)[:k]

    def _key(self, doc: int) -> tuple[bool, int]:
        return (self.ids[doc] is None, self.ids[doc] or 0)


_HIT = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = 16 << 20, frequent: int = 384) -> DataFrame:
    """The k best documents of ``docs(doc_id, text)`` for each row of ``queries(query_id, text)``.

    Returns ``query_id, rank, doc_id, score``: BM25 (k1 1.2, b 0.75, idf ln(1 + (N - df + .5) /
    (df + .5))) over a query's distinct terms; terms are runs of letters, digits and non-ASCII
    characters, A-Z lower-cased. Only documents that share a term are found, so a null or empty query
    has no row; ties go to the smaller id, null ids last. Rows that repeat an id are documents, and
    queries, of their own. ``block_bytes`` bounds what the driver collects and broadcasts at a time,
    but for a single larger query; ``frequent`` is how many terms have their lists held densely and
    changes no result."""
    spark = docs.sparkSession
    index = store(build_index(docs), "index")
    n, words = index.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    schema = pa.schema([("query_id", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def bags(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            yield record_batch(schema, query_id=batch.column(0).cast(pa.int64()), terms=[_bag(hasher, t)[0] for t in batch.column(1).to_pylist()])

    asked = queries.select("query_id", "text").mapInArrow(bags, "query_id long, terms array<long>").where(F.size("terms") > 0)
    asked = store(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-16 * total // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    wanted = asked.select("block", F.explode("terms").alias("term")).distinct()
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    wanted = store(wanted.join(counted, "term"), "frequencies")
    # a few shards, the same in each run, each in a task
    shards = sorted(r[0] for r in index.select(F.xxhash64("lengths", "docs")).collect())
    first = shards[: math.isqrt(len(shards)) // 2]
    seeds = store(index.where(F.xxhash64("lengths", "docs").isin(first)).repartition(len(first)), "seeds") if first else None
    found = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("number", "terms").orderBy("number").toArrow()
        stats = wanted.where(F.col("block") == block).select("term", "df").orderBy("term").toArrow()
        ask = lambda part, least: _search_block(spark, part, rows, stats, n, words / max(n, 1), k, frequent, least)
        least = None
        if seeds is not None:
            place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))
            least = ask(seeds.repartition(len(first)), None).withColumn("place", place).where(F.col("place") == k).select("number", "score").toArrow()
        hits = store(ask(index, least), "hits")
        found = hits if found is None else found.union(hits)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    out = store(ranked.join(asked.select("number", "query_id"), "number").select("query_id", "rank", "doc_id", "score"), "ranked")
    discard(index, wanted, *([] if seeds is None else [seeds]))
    return out


def _search_block(spark, index: DataFrame, rows: pa.Table, stats: pa.Table, n: int, mean: float, k: int, frequent: int, least: pa.Table | None = None) -> DataFrame:
    terms, df = stats["term"].to_numpy(), stats["df"].to_numpy().astype(np.float64)
    lists = rows["terms"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    asked = lists.flatten().to_numpy()
    flat = np.searchsorted(terms, asked)
    # a term that no document has is in no list
    known = np.zeros(len(asked), bool)
    inside = flat < len(terms)
    known[inside] = terms[flat[inside]] == asked[inside]
    owner, flat = np.repeat(np.arange(len(lists)), sizes)[known], flat[known]
    often = np.argsort(-df, kind="stable")[:frequent]
    often = often[df[often] > 0.02 * n]
    column = np.full(len(terms), -1)
    column[often] = np.arange(len(often))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    floor = np.ones(len(lists))
    if least is not None and least.num_rows:
        floor[np.searchsorted(rows["number"].to_numpy(), least["number"].to_numpy())] = least["score"].to_numpy() * UNIT
    shared = spark.sparkContext.broadcast(QueryBlock(rows["number"].to_pylist(), terms, idf, column, owner, flat, floor))

    def run(batches):
        q = shared.value
        best = [[] for _ in q.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("doc_ids", "terms", "dfs", "lengths", "docs", "tfs")}
                row = {c: v.values.to_numpy() if c in ("terms", "dfs") else v.as_py() for c, v in row.items()}
                shard = Shard(row, q, mean)
                step = max(1, (2 << 20) // max(1, shard.blocks * BLOCK))
                for first in range(0, len(q.ids), step):
                    shard.search(first, min(first + step, len(q.ids)), best, k)
        hits = [(number, None if none else doc, -s / UNIT) for number, b in zip(q.ids, best, strict=True) for s, (none, doc) in b]
        for i in range(0, len(hits), 50_000):
            yield record_batch(_HIT, **dict(zip(_HIT.names, map(list, zip(*hits[i : i + 50_000], strict=True)), strict=True)))

    return index.mapInArrow(run, "number long, doc_id long, score double")


#: The same search in SQL, for queries that are the documents whose id is divisible by 100.
SEARCH_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL),
size AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, size GROUP BY term, n),
weight AS (
  SELECT doc_id, term, CAST(round(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) * 1048576) AS BIGINT) AS w
  FROM tf JOIN len USING (doc_id) JOIN idf USING (term), size),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(d.w) / 1048576::DOUBLE AS score
  FROM tf q JOIN weight d USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
