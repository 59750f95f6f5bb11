"""Market panels: guarded readers, cached results, inventories and synthetic bars."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def null_rates(df: DataFrame, column: str, day: str) -> DataFrame:
    """year (null: all years), null_rate to four places."""
    each = F.round(F.avg(F.col(column).isNull().cast("double")), 4).alias("null_rate")
    return df.groupBy(F.year(day).alias("year")).agg(each).unionByName(df.agg(F.lit(None).cast("int").alias("year"), each))


def stock_bars(df: DataFrame, adjusted: bool = True, most: float = 0.02, otherwise: str = "raise", columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Bars with adjusted prices (adj_<column>) under the plain names and the plain ones as raw_<column>.

    If more than `most` of the adjusted closes are null: an error ("raise"), the plain prices ("raw") or as they are
    ("keep").
    """
    if otherwise not in ("raise", "raw", "keep"):
        raise ValueError(f"unknown choice {otherwise}")
    if not adjusted:
        return df
    rate = df.agg(F.avg(F.col("adj_close").isNull().cast("double"))).first()[0] or 0.0
    if rate > most and otherwise != "keep":
        if otherwise == "raise":
            raise ValueError(f"{rate:.1%} of the adjusted closes are null, over {most:.1%}")
        return df
    return df.withColumns({f"raw_{c}": F.col(c) for c in columns} | {c: F.col(f"adj_{c}") for c in columns}).drop(*[f"adj_{c}" for c in columns])


def by_year(read, first: str, last: str) -> DataFrame | None:
    """The union of read(start, end) over calendar years; years without rows add nothing, any error ends it."""
    out = None
    for y in range(int(first[:4]), int(last[:4]) + 1):
        part = read(max(first, f"{y}-01-01"), min(last, f"{y}-12-31"))
        if not part.isEmpty():
            out = part if out is None else out.unionByName(part)
    return out


def cached(spark: SparkSession, folder: str, query: str, start: str = "", end: str = "", refresh: bool = False) -> DataFrame:
    """The rows of a query, from a table named by the hash of its text and bounds, written if it is not there."""
    path = f"{folder}/{hashlib.sha1('|'.join((query, start, end)).encode()).hexdigest()[:16]}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        spark.sql(query).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def coverage(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def catalog(spark: SparkSession) -> DataFrame:
    """name, column, type of all tables and views of the session."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "name string, column string, type string")


def synthetic_bars(spark: SparkSession, symbols: list[str], days: int, seed: int = 0, start: str = "2020-01-01") -> DataFrame:
    """Bars of geometric motions that switch between a calm and a wild regime; a symbol's seed follows from its place."""
    ids = spark.createDataFrame(list(enumerate(symbols)), "i long, symbol string")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(p["i"].iloc[0])])
        wild = np.cumsum(rng.random(days) < 0.02) % 2
        r = rng.normal(0.0003, np.where(wild, 0.02, 0.008))
        close = 100 * np.exp(np.cumsum(r))
        spread = close * np.abs(rng.normal(0, 0.004, days))
        first = np.concatenate([[100.0], close[:-1]])
        return pd.DataFrame({"symbol": p["symbol"].iloc[0], "ts": pd.bdate_range(start, periods=days).date, "open": first, "high": np.maximum(first, close) + spread, "low": np.minimum(first, close) - spread, "close": close, "volume": rng.lognormal(10, 0.5, days)})

    return ids.groupBy("i").applyInPandas(run, "symbol string, ts date, open double, high double, low double, close double, volume double")


def synthetic_futures(spark: SparkSession, contracts: int, days: int, start: str = "2020-01-01") -> DataFrame:
    """sid, t, ts, close of a closed form: 1e4 * exp(0.0003 t + 0.1 sin(t / 74) + 0.012 sin(t / 3)) + 2 sid."""
    t = F.col("t")
    grid = spark.range(contracts).withColumnRenamed("id", "sid").crossJoin(F.broadcast(spark.range(days).withColumnRenamed("id", "t")))
    return grid.select("sid", "t", F.date_add(F.to_date(F.lit(start)), t.cast("int")).alias("ts"), (1e4 * F.exp(0.0003 * t + 0.1 * F.sin(t / 74) + 0.012 * F.sin(t / 3)) + 2 * F.col("sid")).alias("close"))


def overlay(spark: SparkSession, path: str, day: str = "date", weight: str = "weight") -> DataFrame:
    """A CSV of weights by day, kept within 0 and 1."""
    df = spark.read.schema(f"{day} date, {weight} double").option("header", True).csv(path)
    return df.withColumn(weight, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight))))
