"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. One Arrow pass makes, per document, its set of k-word shingles (64-bit hashes), a fingerprint
   of the set, and the sketch. The sketch follows fast similarity sketching: in round i every
   element is thrown into one of t bins; a bin keeps the smallest value of the first round that
   reaches it; from round t on, round t+j throws all elements into bin j, so that after 2t rounds
   every coordinate is filled. The coordinates then agree with probability J with concentration
   as strong as for independent ones.
2. Documents with one and the same set are one class, a node of the graph of links.
3. Bands of ``rows`` coordinates are bucket keys. The number of bands follows from the threshold:
   a pair at the threshold shares no band with a probability of at most ``miss``.
4. No bucket is expanded into all its pairs. Each member is first compared with the bucket's
   smallest and largest node, which settles groups of copies in linear work. A pair within one
   component can't change the result; what is left are members of different components in one
   bucket. Such buckets with the same smallest component make a group. In a group of few members (up
   to ``PLAIN``) those that share a bucket are compared, if their sizes admit the threshold.
5. In a larger group members are held against its consensus c, the elements that more than half of the
   members have (a set of at most twice their mean size). Let i = |m & c|, D = m \\ c, R = c \\ m. A
   linked pair has q = s (|a| + |b|) / (1 + s) common elements or more, s being the threshold. Of these
   at most min(i_a, i_b) lie in c, so D_a and D_b share at least q - min(i_a, i_b): if that is 1 or
   more, an equi-join on the elements of D finds the pair. Elements that are in c, which nearly all
   share, take no part in it. Otherwise both are nearly parts of c (cut copies, say), and as
   |a & b| = |c| - |R_a| - |R_b| + |R_a & R_b| + |D_a & D_b|, R and D together share at least
   q - |c| + |R_a| + |R_b|. Where that is 0 or less for the member closest to c, the pair is linked
   for certain, and any pair for which it is 0 or less is then linked through that member; for all others
   an equi-join on elements of R and D finds the pair. In both joins elements are put in one order, the
   rarest first, and sharing x elements means that the first shared one is not among the last x - 1 of
   either member; what only one member has goes first and is not joined. The larger member of a pair is
   joined with classes of the smaller one's size, which tightens x. Nothing is lost by any of this.
6. Links are confirmed on the full sets; components by large-star and small-star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, discard, lower_words, mix64, record_batch, shingle_set, slices, store
from .components import connected_components

_LONG = pa.int64()
#: Members of a group of open buckets that are still compared bucket by bucket.
PLAIN = 24
#: Rows (of three numbers) of a table of wanted documents that is still broadcast.
BROADCAST_ROWS = 300_000
#: Classes of set sizes are powers of this.
STEP = 1.05


def n_bands(num: int, den: int, rows: int, miss: float) -> int:
    """Bands needed so that a pair at similarity num/den meets in none with probability <= miss."""
    return math.ceil(math.log(miss) / math.log1p(-((num / den) ** rows)))


class FastSimilaritySketch:
    """t coordinates of a set of 64-bit hashes; see the module's text."""

    def __init__(self, t: int, seed: int = 7):
        self.t = t
        self.seeds = mix64(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        t, n = self.t, len(elements)
        out, empty = np.zeros(t, np.uint64), np.ones(t, bool)
        at, want = 0, max(1, math.ceil(t * (math.log(t) + 3) / n))
        while at < t:
            rounds = min(want, t - at, 4096)
            u = mix64(elements[None, :] ^ self.seeds[at : at + rounds, None])
            bins = (u >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
            # bin | round | value: the smallest key of a bin is its earliest round's smallest value
            key = ((bins << np.uint64(52)) | (np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(40)) | (u & np.uint64(0xFFFFFFFFFF))).ravel()
            key.sort()
            b = (key >> np.uint64(52)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            b, key = b[first], key[first] & np.uint64((1 << 52) - 1)
            new = empty[b]
            out[b[new]] = key[new] + (np.uint64(at) << np.uint64(40))
            empty[b] = False
            if not empty.any():
                return out
            at, want = at + rounds, want * 2
        for j in np.flatnonzero(empty):  # round t + j: all elements go to bin j
            out[j] = (np.uint64(t + j) << np.uint64(40)) | (mix64(elements ^ self.seeds[t + j]) & np.uint64(0xFFFFFFFFFF)).min()
        return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    acc = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for col in sketch.reshape(bands, rows).T:
        acc = mix64(acc ^ col) * np.uint64(0x9E3779B97F4A7C15)
    return acc


_SIG = pa.schema([("doc_id", _LONG), ("text_key", _LONG), ("n", _LONG), ("fp1", _LONG), ("fp2", _LONG), ("bands", pa.list_(_LONG))])


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix64(s + np.uint64(len(s)))
        pair = np.array([a.sum(dtype=np.uint64), mix64(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n, fp1, fp2, bands`` of every row; text_key is a hash of the text, fp and
    bands are null for an empty set."""

    def run(batches):
        hasher, sketch = WordHasher(), FastSimilaritySketch(bands * rows)
        for batch in slices(batches):
            n, fp1, fp2, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(hasher(lower_words(text)), k)
                n.append(len(s))
                if not len(s):
                    fp1.append(None), fp2.append(None), keys.append(None)
                    continue
                with np.errstate(over="ignore"):
                    keys.append(band_keys(sketch(s), bands, rows).view(np.int64))
                one, two = _fingerprint(s)
                fp1.append(one), fp2.append(two)
            yield record_batch(_SIG, doc_id=batch.column(0).cast(_LONG), text_key=batch.column(1), n=n, fp1=fp1, fp2=fp2, bands=keys)

    return docs.select("doc_id", _text_key(), "text").mapInArrow(run, "doc_id long, text_key long, n long, fp1 long, fp2 long, bands array<long>")


def _text_key():
    return F.xxhash64("text").alias("text_key")


_SET = pa.schema([("node", _LONG), ("s", pa.binary())])


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, s`` (sorted hashes, 8 bytes each), a row for each of ``nodes(node, rep, fp1)``."""

    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            node, sets = [], []
            for x, fp1, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = shingle_set(hasher(lower_words(text)), k)
                if len(s) and _fingerprint(s)[0] == fp1:  # another text may bear the same id
                    node.append(x), sets.append(s.tobytes())
            yield record_batch(_SET, node=node, s=sets)

    # up to BROADCAST_ROWS wanted rows go to the texts; beyond, texts are shuffled to them
    nodes = store(nodes.withColumnRenamed("rep", "doc_id"), "wanted")
    texts = docs.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "doc_id").select("node", "fp1", "text")
    return texts.mapInArrow(run, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))


_PAIR = pa.schema([("a", _LONG), ("b", _LONG)])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` with den * |A & B| >= num * |A | B|, on full sets."""

    def run(batches):
        for batch in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = den * inter >= num * (len(x) + len(y) - inter)
            yield record_batch(_PAIR, a=batch.column(0).filter(pa.array(keep)), b=batch.column(1).filter(pa.array(keep)))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = store(_sets(docs, nodes.join(asked, "node", "left_semi"), k), "sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    out = store(joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return out


_HELD = pa.schema([("g", _LONG), ("e", _LONG)])
_DIFF = pa.schema([("g", _LONG), ("m", _LONG), ("label", _LONG), ("size", _LONG), ("n", _LONG), ("i", _LONG), ("nc", _LONG), ("only_m", pa.list_(_LONG)), ("only_c", pa.list_(_LONG))])


def _differences(sets: DataFrame, members: DataFrame, groups: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of members ``(g, m, label, size)`` of ``groups(g, size)``: how often each element occurs in a group, ``(g, e, c)`` where
    that is more than once, and the differences of each member from the group's consensus."""

    def flatten(batches):
        for batch in slices(batches):
            sets_ = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            yield record_batch(_HELD, g=np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets_]), e=np.concatenate(sets_))

    def differ(batches):
        for batch in slices(batches):
            n, i, nc, only_m, only_c = [], [], [], [], []
            for s, c in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                s, c = np.frombuffer(s, np.int64), np.array(c or [], np.int64)
                both = np.intersect1d(s, c, assume_unique=True)
                n.append(len(s)), i.append(len(both)), nc.append(len(c))
                only_m.append(np.setdiff1d(s, both, assume_unique=True))
                # the other side is needed only where most of m is in c
                only_c.append(np.setdiff1d(c, both, assume_unique=True) if den * len(both) >= num * len(s) else None)
            yield record_batch(_DIFF, g=batch.column(0), m=batch.column(1), label=batch.column(2), size=batch.column(3), n=n, i=i, nc=nc, only_m=only_m, only_c=only_c)

    held = members.join(sets.withColumnRenamed("node", "m"), "m")
    counts = held.select("g", "s").mapInArrow(flatten, "g long, e long").groupBy("g", "e").agg(F.count("*").alias("c")).where("c > 1")
    counts = store(counts, "counts")
    # more than half of the members have each: at most twice their mean size
    most = counts.join(groups, "g").where("2 * c > size").groupBy("g").agg(F.collect_list("e").alias("cs"))
    most = store(most, "consensus")
    both = held.join(most, "g", "left").select("g", "m", "label", "size", "s", "cs")
    schema = "g long, m long, label long, size long, n long, i long, nc long, only_m array<long>, only_c array<long>"
    return counts, store(both.mapInArrow(differ, schema), "differences")


def _around_consensus(docs: DataFrame, nodes: DataFrame, members: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``a, b``: members ``(g, m, label)`` of one of ``groups(g, size)`` that may be linked though their
    labels differ; see 5. in the module's text."""
    members = members.join(groups, "g")
    both, log = num + den, math.log(STEP)
    sets = store(_sets(docs, nodes.join(members.select(F.col("m").alias("node")).distinct(), "node", "left_semi"), k), "sets")
    counts, diff = _differences(sets, members, groups, num, den)
    discard(sets)
    # 2 (num + den) times the part of one member in what R and D of a pair must share
    diff = diff.withColumns({"r": F.expr("nc - i"), "d": F.expr("n - i")}).withColumn("h", F.expr(f"2 * {num} * n + {both} * (2 * r - nc)"))
    best = diff.groupBy("g").agg(F.min(F.struct("h", "m", "label")).alias("best")).select("g", "best.*").toDF("g", "h0", "m0", "label0")
    best = store(best, "closest")
    certain = diff.join(best, "g").where("h + h0 <= 0 and label <> label0").select(F.col("m").alias("a"), F.col("m0").alias("b"))
    # labels that hold a member linked with the closest one for certain count as its label
    joined = diff.groupBy("g", "label").agg(F.min("h").alias("h1")).join(best, "g").select("g", "label", F.expr("if(h1 + h0 <= 0, label0, label)").alias("l"), "label0")
    known = diff.join(store(joined, "labels"), ["g", "label"]).withColumn("main", F.expr("l = label0"))
    common = ["g", "m", "n", "i", "d", "r", "nc", "l", "main"]
    outer = known.select(F.lit(0).alias("kind"), *common, F.col("d").alias("w"), "size", F.lit(False).alias("lacks"), F.explode("only_m").alias("e"))
    inner = known.where("only_c is not null").select(F.lit(1).alias("kind"), *common, F.expr("d + r").alias("w"), "size", "only_m", "only_c")
    inner_d = inner.select(*outer.columns[:-2], F.lit(False).alias("lacks"), F.explode("only_m").alias("e"))
    inner_r = inner.select(*outer.columns[:-2], F.lit(True).alias("lacks"), F.explode("only_c").alias("e"))
    each = outer.union(inner_d).union(inner_r).join(counts, ["g", "e"], "left")
    each = each.withColumn("c", F.expr("if(lacks, size - coalesce(c, 0), coalesce(c, 1))"))
    at = F.row_number().over(Window.partitionBy("kind", "g", "m").orderBy("c", "e")) - 1
    each = store(each.withColumn("at", at).where("c > 1").select("kind", "e", "at", "w", *common), "elements")
    discard(counts)
    up = lambda x: f"((({x}) + {both} - 1) div {both})"  # noqa: E731  rounded up after division by num + den
    of = lambda x: f"cast(floor(ln({x}) / {log!r} + 1e-9) as int)"
    low, most = f"(({num} * n + {den} - 1) div {den})", f"({both} * i div {num} - n)"  # sizes of partners: by the threshold, by i
    # the smaller of a pair: a partner is at least as large
    small = each.where(f"kind = 0 or 2 * {num} * n <= {both} * i")
    small = small.withColumn("need", F.expr(f"if(kind = 0, {up(f'2 * {num} * n')} - i, {up(f'{num} * n + {both} * r - {den} * least({den} * n div {num}, {most})')})"))
    small = small.withColumns({"class": F.expr(of("n")), "part": F.explode(F.expr("if(main, array(0), array(0, 1))"))}).where("at <= w - greatest(need, 1)")
    # the larger: one row for each class of sizes that its partners may have
    large = each.withColumn("hi", F.expr(f"if(kind = 0, n, least(n, {most}))")).where(f"hi >= {low}")
    large = large.withColumns({"class": F.explode(F.expr(f"sequence({of(low)}, {of('hi')})")), "part": F.expr("if(main, 1, 0)")})
    least = f"greatest({low}, cast(floor(pow({STEP}, class) - 1e-6) as long))"
    large = large.withColumn("need", F.expr(f"if(kind = 0, {up(f'{num} * (n + {least})')} - i, {up(f'{num} * n + {both} * r - {den} * hi')})")).where("at <= w - greatest(need, 1)")
    keys, rest = ["kind", "g", "e", "class", "part"], ["m", "at", "w", "n", "i", "r", "nc", "l"]
    a, b = large.select(*keys, *[F.col(c).alias(f"{c}_a") for c in rest]), small.select(*keys, *[F.col(c).alias(f"{c}_b") for c in rest])
    inside = f"({up(f'{num} * (n_a + n_b)')} - least(i_a, i_b))"
    share = f"if(kind = 0, {inside}, greatest(1, {up(f'{num} * (n_a + n_b)')} - nc_a + r_a + r_b))"
    may = f"l_a <> l_b and (n_b < n_a or n_b = n_a and m_b < m_a) and {den} * n_b >= {num} * n_a and (kind = 0) = ({inside} >= 1)"
    found = a.join(b, keys).where(f"{may} and at_a + {share} <= w_a and at_b + {share} <= w_b").select(F.col("m_a").alias("a"), F.col("m_b").alias("b"))
    out = store(found.union(certain).distinct(), "candidates")
    discard(each, diff)
    return out


def _classes(docs: DataFrame, num: int, den: int, k: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n, fp1, fp2`` of each row of ``docs(doc_id, text)``, and of each class of equal
    sets ``fp1, fp2, n, rep, node, component``.

    rep is a class's smallest id; so is node, unless other texts bear the same id. component is the
    smallest node of those reachable."""
    bands = n_bands(num, den, rows, miss)
    sig = store(signatures(docs, k, bands, rows), "signatures")
    first = F.row_number().over(Window.partitionBy("rep").orderBy("fp1", "fp2", "n")) == 1
    classes = sig.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"))
    classes = store(classes.withColumn("node", F.when(first, F.col("rep")).otherwise(F.xxhash64("rep", "fp1", "fp2"))), "classes")
    nodes = classes.select("node", "rep", "fp1")
    banded = sig.join(classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2", "node"), ["doc_id", "fp1", "fp2"]).dropDuplicates(["node"])
    rows_ = store(banded.select("node", "n", F.explode("bands").alias("key")), "bands")
    # buckets with a second document; a count per key and task is all that is shuffled
    sizes = classes.select("node", "n")
    buckets = rows_.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    for end in ("lo", "hi"):
        buckets = buckets.join(sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
    members = store(rows_.join(buckets, "key"), "members")
    discard(rows_)
    fits = f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"
    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("n_lo").alias("n_a")), F.struct(F.col("hi").alias("a"), F.col("n_hi").alias("n_a")))
    star = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.explode(ends).alias("x")).select("x.*", "b", "n_b").where(f"a <> b and {fits}")
    pairs = store(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = _verified(docs, nodes, pairs, k, num, den)
    found = store(connected_components(links), "labels")
    # what is left: members of different components in one bucket
    labelled = members.select("key", "node", "n", "lo", "hi").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = store(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("g"), F.max("label").alias("l1")).where("g < l1").select("key", "g")
    open_ = store(labelled.join(mixed, "key"), "open")
    grouped = store(open_.select("g", F.col("node").alias("m"), "label").distinct(), "groups")
    large = store(grouped.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > PLAIN), "large")
    small = open_.join(large, "g", "left_anti")
    x = small.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("l_a"), "lo", "hi")
    y = small.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("l_b"))
    rest = x.join(y, "key").where(f"a < b and l_a <> l_b and a <> lo and b <> hi and {fits}").select("a", "b")
    if not large.isEmpty():
        around = _around_consensus(docs, nodes, grouped, large, k, num, den)
        rest = rest.union(around.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rest = store(rest.distinct(), "pairs")
    more = rest if rest.isEmpty() else _verified(docs, nodes, rest, k, num, den)
    label = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"l_{end}"))
    component = F.coalesce("component", "node")
    if not more.isEmpty():  # links between components: as a graph of components
        edges = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
        joined = connected_components(edges).toDF("_node", "whole")
        of_node = classes.join(found, "node", "left").withColumn("component", component)
        of_node = store(of_node.join(joined, F.col("component") == F.col("_node"), "left").withColumn("component", F.coalesce("whole", "component")).drop("_node", "whole"), "components")
    else:
        of_node = store(classes.join(found, "node", "left").withColumn("component", component), "components")
    discard(members, labelled, open_, grouped, large, pairs, rest, links, more, found, classes)
    return sig.drop("bands"), of_node


def _near_duplicates(docs: DataFrame, num: int, den: int, k: int, rows: int, miss: float) -> DataFrame:
    """``doc_id, text_key, fp1, fp2, n_shingles, component_id, kept`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig, classes = _classes(docs, num, den, k, rows, miss)
    # a component's smallest id is its smallest node's, but for nodes that aren't ids
    least = classes.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.join(least, "component").select("fp1", "fp2", "least")
    out = sig.join(of_class, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "text_key", "fp1", "fp2", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5, rows: int = 6, miss: float = 1e-8) -> DataFrame:
    """Components of documents linked at shingle similarity num/den or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``. Further columns of
    ``docs`` (whatever their names) play no part. Null or empty texts have no shingle and are
    components of their own; fewer than ``k`` words make one shingle. Rows that repeat a ``doc_id``
    with one text share its component; with other texts each has the component of its own text. A
    null ``doc_id`` is linked with nothing and has a null component, and ``kept`` null; an empty table
    gives an empty table.
    """
    return _near_duplicates(docs, num, den, k, rows, miss).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component (the smallest id).

    Of rows that repeat a ``doc_id`` with the same shingles one stays; rows with a null ``doc_id`` all
    stay. The columns are those of ``docs``."""
    kept = _near_duplicates(docs, num, den, k, 6, 1e-8).where("kept").groupBy("doc_id", "fp1", "fp2").agg(F.min("text_key").alias("text_key"))
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _text_key())
    out = rows.join(kept, (rows.doc_id == kept._kept_id) & (rows.text_key == kept._kept_key), "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return out.union(docs.where("doc_id is null"))
