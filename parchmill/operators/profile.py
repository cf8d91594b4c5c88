"""Token profiles, index-rank percentiles, running totals and reports over chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Number of each row in the order, from 1, without one task for all rows.

    Rows are cut into ranges of the order; a row's number is its number within the range and the rows of the ranges before. order must tell any two rows apart.
    """
    from ..session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    return ranged.withColumn("_k", F.row_number().over(W.partitionBy("_range").orderBy(*order))).join(before, "_range").withColumn(name, F.col("_k") + F.col("_before")).drop("_range", "_k", "_before")


def index_percentiles(df: DataFrame, value: str, tie: str, percents: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """value at 0-based rank floor(n p / 100), which isn't percentile_disc."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(F.explode(F.array(*[F.lit(p) for p in percents])).alias("p"), "n").select("p", (F.floor(F.col("n") * F.col("p") / 100) + 1).alias("rank"))
    return global_rank(df.select(value, tie), value, tie).join(F.broadcast(wanted), "rank").select("p", F.col(value).alias("value"))  # wanted: a row for each percent


def token_statistics(df: DataFrame, tokens: Column, keys: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Number, sum, mean, least and most tokens, by keys; with rollup also the totals above them."""
    t = df.withColumn("_t", tokens)
    grouped = t.rollup(*keys) if rollup else t.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.sum("_t").alias("total_tokens"), F.round(F.avg("_t"), 4).alias("mean_tokens"), F.min("_t").alias("min_tokens"), F.max("_t").alias("max_tokens")
    )


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "running_total") -> DataFrame:
    """Sum of value from the group's first row to this one.

    A group may hold a third of all rows: the order is cut into ranges as in global_rank, and the sums of a group's ranges before are added.
    """
    from ..session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    inside = F.sum(value).over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, "_range")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = ranged.withColumn(name, inside).alias("r").join(before.select(*by, "_range", "_before").alias("b"), cond)
    return joined.select("r.*", "b._before").withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("_before")).drop("_range", "_before")


ACCEPTED = ("accepted", "accepted_max_depth")


def score_summary(chunks: DataFrame, keys: Sequence[str], score: str = "validation_score.final_score", tokens: str = "token_count") -> DataFrame:
    """Chunks, tokens, mean, least and best score by keys."""
    s = F.col(score)
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(tokens).alias("total_tokens"), F.round(F.avg(s), 6).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score")
    )


def acceptance_by(chunks: DataFrame, key: str, status: str = "validation_status") -> DataFrame:
    ok = F.col(status).isin(*ACCEPTED)
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted")).withColumn("acceptance_rate", tx.share(F.col("accepted"), F.col("total")))


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def fraction(df: DataFrame, flag: Column, name: str) -> DataFrame:
    return df.agg(F.round(F.avg(flag.cast("int")), 4).alias(name), F.count(F.lit(1)).alias("n"))


def global_report(chunks: DataFrame, file: str, score: str = "validation_score.final_score") -> DataFrame:
    s = F.col(score)
    return chunks.agg(
        F.countDistinct(file).alias("files"), F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("validation_status").isin(*ACCEPTED)).alias("accepted"),
        F.count_if(F.col("chunking_status") == "original_untouched").alias("passthrough"), F.count_if("low_content").alias("low_content"),
        F.round(F.avg(s), 6).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
    )


def counts_by_each(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key by itself and in all, in one pass (grouping sets)."""
    view = df.select(*keys)
    sets = ", ".join(f"({k})" for k in keys)
    return df.sparkSession.sql(f"select {', '.join(keys)}, count(*) as n from {{df}} group by grouping sets ({sets}, ())", df=view)


def listing(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, the greatest first, ties by key."""
    return histogram(df, key).orderBy(F.desc("n"), key)


def status_by_file(chunks: DataFrame, file: str, status: str = "validation_status") -> DataFrame:
    """Chunks of each file, and how many of each status."""
    s = F.col(status)
    return chunks.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(s == "accepted").alias("accepted"), F.count_if(s == "accepted_max_depth").alias("accepted_max_depth"),
        F.count_if(~F.coalesce(s.isin(*ACCEPTED), F.lit(False))).alias("other"),
    )
