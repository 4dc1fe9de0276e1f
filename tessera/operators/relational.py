"""Joins, windows, facets and paging that the workspace's reads are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenancy(owner: Column, user: str | None, variant: str) -> Column:
    """Rows that a user may see. strict: own rows, none without a user; shared: own and ownerless rows, all without a
    user; legacy: ownerless rows without a user, else own rows."""
    if variant == "strict":
        return owner == user if user else F.lit(False)
    if variant == "shared":
        return (owner == user) | owner.isNull() if user else F.lit(True)
    return owner == user if user else owner.isNull()


def around(df: DataFrame, group: str, order: str, value: Column, n: int) -> DataFrame:
    """df with _before and _after: up to n values on either side within the group, in order."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({"_before": F.collect_list(value).over(w.rowsBetween(-n, -1)), "_after": F.collect_list(value).over(w.rowsBetween(1, n))})


def keep_one(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def first_rows(df: DataFrame, by: list, order: list, n: int, least: int = 1) -> DataFrame:
    """The first n rows of each group that has at least so many."""
    w = Window.partitionBy(*by)
    df = df.withColumns({"_rank": F.row_number().over(w.orderBy(*order)), "_all": F.count(F.lit(1)).over(w)})
    return df.filter((F.col("_rank") <= n) & (F.col("_all") >= least)).drop("_rank", "_all")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def overlapping(df: DataFrame, start: str, end: str, a: Column, b: Column) -> DataFrame:
    """Half-open intervals [start, end) that meet [a, b)."""
    return df.filter((F.col(start) < b) & (F.col(end) > a))


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of half-open intervals of epoch seconds that meet, by an equi-join on buckets of so many seconds.

    A pair is kept only in the bucket where the later of the two begins, so it comes once.
    """
    cut = lambda df, s, e, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bucket))))
    both = cut(left, *a, "_bucket").join(cut(right, *b, "_other"), F.col("_bucket") == F.col("_other"))
    meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    return both.filter(meets & (F.floor(F.greatest(a[0], b[0]) / bucket) == F.col("_bucket"))).drop("_bucket", "_other")


def facet(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def union_by_priority(parts: list[DataFrame], key: str, order: list, limit: int) -> DataFrame:
    """The parts one after another, each key once at its first part, cut at the limit."""
    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return keep_one(whole, [key], ["_part", *order]).orderBy("_part", *order).limit(limit).drop("_part")


def newest_suffix(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Of each group the newest rows whose sizes together stay within the budget."""
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_total", F.sum(size).over(w)).filter(F.col("_total") <= budget).drop("_total")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Column) -> DataFrame:
    """New rows replace old ones of the same key; old rows without a new one stay only where keep holds."""
    kept = old.join(new.select(key), key, "left_anti").filter(keep)
    return kept.unionByName(new)
