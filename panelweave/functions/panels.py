"""Panel steps: slicing, validation, zero-variance repair, and panels made from event-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_slice(panel: DataFrame, feature: int = 0) -> DataFrame:
    """One feature of ``panel(t, node, feature, value)``; a feature that doesn't occur raises."""
    out = panel.where(F.col("feature") == feature).select("t", "node", "value")
    if out.isEmpty():
        raise ValueError(f"feature {feature} is out of bounds")
    return out


def time_slice(panel: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Steps in [start, stop); a predicate that reaches the scan."""
    out = panel.where(F.col("t") >= start)
    return out if stop is None else out.where(F.col("t") < stop)


def train_slice(panel: DataFrame, ratio: float = 0.7) -> DataFrame:
    """The first int(L * ratio) steps."""
    steps = panel.agg(F.max("t")).first()[0]
    return time_slice(panel, 0, int(((steps if steps is not None else -1) + 1) * ratio))


def zero_variance_nodes(panel: DataFrame, threshold: float = 1e-5) -> DataFrame:
    """``node, std`` of nodes whose population deviation is at most ``threshold``."""
    return panel.groupBy("node").agg(F.stddev_pop("value").alias("std")).where(F.col("std") <= threshold)


def noise_scale(panel: DataFrame) -> DataFrame:
    """One row ``scale``: the deviation of a repair's noise, 1e-4 times the panel's mean (1e-6, if that is 0)."""
    return panel.where(~F.isnan("value")).agg((F.abs(F.avg("value")) * 1e-4).alias("s")).select(F.when(F.coalesce("s", F.lit(0.0)) == 0, 1e-6).otherwise(F.col("s")).alias("scale"))


def repair_zero_variance(panel: DataFrame, threshold: float = 1e-5, seed: int = 0) -> DataFrame:
    """Adds seeded noise of ``noise_scale`` to constant nodes; it is less than 9 times that (``gaussian``).

    The noise is a function of (seed, t, node), so reruns and lost tasks change nothing."""
    flat = zero_variance_nodes(panel, threshold).select("node", F.lit(True).alias("flat"))
    noisy = F.col("value") + F.col("scale") * gaussian(F.lit(seed), F.col("t"), F.col("node"))
    return panel.join(flat, "node", "left").crossJoin(F.broadcast(noise_scale(panel))).select("t", "node", F.when(F.col("flat"), noisy).otherwise(F.col("value")).alias("value"))


def gaussian(*key: Column) -> Column:
    """A standard normal number that depends on the key alone (Box-Muller over two hashes of 53 bits, so within 8.66)."""
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(F.lit(-2.0) * F.ln(u(1))) * F.cos(F.lit(2 * 3.141592653589793) * u(2))


def uniform(*key: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(3), *key), 11).cast("double") + 0.5) / float(1 << 53)


def is_dense(panel: DataFrame) -> DataFrame:
    """One row ``dense``: every node has a value at every step."""
    return panel.agg((F.count("*") == F.count_distinct("t") * F.count_distinct("node")).alias("dense"))


def densify(sums: DataFrame, t: Column, value: Column, node: Column) -> DataFrame:
    """``t`` from 0, every node at every step between the first and the last, 0 where nothing was.

    Sums are made first, so what is filled up is the grid itself."""
    cells = sums.groupBy(node.alias("node"), t.alias("t0")).agg(F.sum(value).alias("value"))
    span = cells.agg(F.min("t0").alias("a"), F.max("t0").alias("b")).where("a is not null")
    steps = span.select("a", F.explode(F.sequence("a", "b")).alias("t0"))
    grid = cells.select("node").distinct().crossJoin(steps)
    return grid.join(cells, ["node", "t0"], "left").select((F.col("t0") - F.col("a")).cast("int").alias("t"), F.col("node").cast("int").alias("node"), F.coalesce("value", F.lit(0.0)).alias("value"))


def nation_month(spark, sf_dir: str) -> DataFrame:
    """Order value by customer nation and month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    # per customer and month first: the join then sees sums, not orders
    sums = orders.groupBy("o_custkey", month.alias("m")).agg(F.sum("o_totalprice").alias("v"))
    return densify(sums.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("m"), F.col("v"), F.col("c_nationkey"))


def event_hour(spark, sf_dir: str) -> DataFrame:
    """Event value by type (numbered in alphabetical order) and hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("long") if dict(events.dtypes)["ts"] == "timestamp" else F.floor(F.unix_seconds(F.to_timestamp_ltz("ts")) / 3600).cast("long")
    sums = events.groupBy("event_type", hour.alias("h")).agg(F.sum("value").alias("v"))
    types = sums.select("event_type").distinct()
    number = types.agg(F.sort_array(F.collect_set("event_type")).alias("all"))
    return densify(sums.crossJoin(F.broadcast(number)), F.col("h"), F.col("v"), F.array_position("all", F.col("event_type")) - 1)


def user_day(spark, sf_dir: str) -> DataFrame:
    """Event value by user and day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return densify(events, day, F.col("value"), F.col("user_id"))


def embedding_vectors(spark, sf_dir: str) -> DataFrame:
    """``node, xs``: each vector is a series."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("xs"))
