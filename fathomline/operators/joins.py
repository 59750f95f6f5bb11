"""As-of joins, last-wins merges, episodes and visibility at a date, as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, lag_rows: int = 0) -> DataFrame:
    """Each left row with the value of the last right row at or before its time.

    Right rows are made unique per key and time (the greatest value stays) and shifted by `lag_rows` rows first. One
    shuffle by key: the sides are stacked and the last value is carried forward.
    """
    order = Window.partitionBy(*by).orderBy(ts)
    r = right.groupBy(*by, ts).agg(F.max(value).alias(value))
    if lag_rows:
        r = r.withColumn(value, F.lag(value, lag_rows).over(order))
    names = [c for c in left.columns if c not in (*by, ts)]
    l = left.select(*by, ts, F.struct(*names).alias("row") if names else F.lit(1).alias("row"), F.lit(None).cast(r.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    both = l.unionByName(r.select(*by, ts, value, F.lit(0).alias("side")), allowMissingColumns=True)
    carried = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn(value, carried).where("side = 1")
    return out.select(*by, ts, *[F.col(f"row.{c}").alias(c) for c in names], value)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of `new` replace rows of `old` with equal keys; a key keeps one row."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return both.withColumn("_first", first).where("_first = 1").drop("_first", "_batch")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: all old rows under any key of `new` go."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def islands(df: DataFrame, by: list[str], day: str, gap: int) -> DataFrame:
    """Episodes: runs of days of a key with no more than `gap` days between them."""
    w = Window.partitionBy(*by).orderBy(day)
    new = F.coalesce(F.datediff(day, F.lag(day).over(w)) > gap, F.lit(True)).cast("int")
    numbered = df.select(*by, day, new.alias("_new")).withColumn("_island", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("_island")


def visible_top(docs: DataFrame, dates: DataFrame, known: str, date: str, lag_days: int, score: str, tie: str, k: int) -> DataFrame:
    """The k best documents known `lag_days` before each decision date. The dates are a calendar, one row a day.

    Documents are first cut to the k best of each day on which they became known, so that the join by dates stays small.
    """
    day = Window.partitionBy(known).orderBy(F.desc(score), tie)
    few = docs.where(F.col(known).isNotNull()).withColumn("_r", F.row_number().over(day)).where(F.col("_r") <= k).drop("_r")
    seen = dates.select(date).distinct().join(few, F.col(known) <= F.date_sub(date, lag_days))
    best = Window.partitionBy(date).orderBy(F.desc(score), tie)
    return seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
