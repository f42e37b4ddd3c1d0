"""Top N items within every group, exactly, with score histograms as a safe filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarv.runtime import cut

#: Thresholds that are sent to every task, at 40 bytes each; more of them are joined by shuffle instead, with the same result.
BROADCAST_GROUPS = 1_000_000
#: Parts of every group in that join, so that no group is one task's.
SALTS = 16


def score_bin(score: Column) -> Column:
    """A bin that never falls as the score rises: sixteen per doubling, the same on both sides of 0. Null and NaN: the lowest."""
    s = score.cast("double")
    up = F.floor(F.log2(F.abs(s) + 1) * 16)
    return F.when(s.isNull() | F.isnan(s), -20_000).when(s >= 0, up).otherwise(-up - 1).cast("int")


def thresholds(scored: DataFrame, group: list[str], n: int) -> DataFrame:
    """group as __skarv_g0.. and __skarv_least: the bin that a group's n-th row lies in, for every group with rows below it.

    One aggregate over (group, bin) – combined in each task first – and a running sum over a group's bins, of which there are as
    many as the scores have sixteenths of a doubling, never as many as rows.
    """
    hist = scored.groupBy(*group, "__skarv_bin").agg(F.count("*").alias("__skarv_n"))
    above = Window.partitionBy(*group).orderBy(F.col("__skarv_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    edges = hist.withColumn("__skarv_upto", F.sum("__skarv_n").over(above))
    per_group = edges.groupBy(*group).agg(F.min("__skarv_bin").alias("__skarv_low"), F.max(F.when(F.col("__skarv_upto") >= n, F.col("__skarv_bin"))).alias("__skarv_least"))
    keys = [F.col(g).alias(f"__skarv_g{i}") for i, g in enumerate(group)]
    return per_group.filter(F.col("__skarv_least") > F.col("__skarv_low")).select(*keys, "__skarv_least")


def top_n(df: DataFrame, group: list[str], score: str, tie: list[str], n: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows of df with rank_no 1..n in their group: score descending (null last), then `tie` ascending by code point.

    A histogram of each group's scores, whatever its size, gives the highest bin from which on at least n rows lie; rows in lower
    bins can't be among the first n and are dropped before the ranking shuffle. The thresholds are written as a table and counted: up
    to `broadcast_groups` they go to every task, else both sides are shuffled by group and salt; the rows that pass are the same.
    Rows equal in score and all of `tie` come out in any order among themselves. Null group keys form
    a group. NaN scores rank as null. The result has the columns of df (a column rank_no of df is replaced); an empty table gives no rows.
    df is read twice.
    """
    scored = df.withColumn("__skarv_s", F.when(F.isnan(F.col(score).cast("double")), None).otherwise(F.col(score))).withColumn("__skarv_bin", score_bin(F.col(score)))
    least = cut(thresholds(scored, group, n), "top-n-thresholds")
    same = [scored[g].eqNullSafe(least[f"__skarv_g{i}"]) for i, g in enumerate(group)]
    if least.count() <= broadcast_groups:
        both = scored.join(F.broadcast(least), same, "left")
    else:
        parts = least.withColumn("__skarv_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = scored.withColumn("__skarv_salt", F.pmod(F.xxhash64("__skarv_s", *tie), F.lit(SALTS)).cast("int"))
        same = [salted[g].eqNullSafe(parts[f"__skarv_g{i}"]) for i, g in enumerate(group)]
        both = salted.join(parts.hint("merge"), [*same, salted["__skarv_salt"] == parts["__skarv_part"]], "left")
    kept = both.filter(F.col("__skarv_least").isNull() | (F.col("__skarv_bin") >= F.col("__skarv_least")))
    order = Window.partitionBy(*group).orderBy(F.col("__skarv_s").desc_nulls_last(), *[F.col(t).asc() for t in tie])
    ranked = kept.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= n)
    return ranked.select(*[c for c in df.columns if c != "rank_no"], "rank_no")
