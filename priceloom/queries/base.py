"""The tables that the queries share, in Spark and in SQL, and the registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its feed (region), product columns, week and unit price."""
    t = lambda name: table(spark, sf_dir, name)
    feeds = (
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("feed"))
    )
    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(feeds, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "feed",
            F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )
    )


SALES = """sales AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_returnflag, l_shipdate, p_name, p_brand, p_type, p_size, p_retailprice, r_name AS feed,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_extendedprice / l_quantity AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def series(spark: SparkSession, sf_dir: str, family: str = "p_brand") -> DataFrame:
    """(feed, family, week, price, baseline, confidence, n): the week's lowest unit price."""
    return sales(spark, sf_dir).groupBy("feed", F.col(family).alias("family"), "week").agg(
        F.min("price").alias("price"),
        F.max("p_retailprice").alias("baseline"),
        F.when(F.count(F.lit(1)) >= 3, "high").when(F.count(F.lit(1)) == 2, "medium").otherwise("low").alias("confidence"),
        F.count(F.lit(1)).alias("n"),
    )


SERIES = SALES + """, series AS (
  SELECT feed, p_brand AS family, week, min(price) AS price, max(p_retailprice) AS baseline,
         CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n
  FROM sales GROUP BY feed, p_brand, week
)"""


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse series with a row for every week of the feed, so that gaps show as null prices."""
    from priceloom.operators.series import price_spine

    s = sparse(spark, sf_dir)
    return price_spine(s, s, s)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per (feed, product name): too few sales for every week to have one."""
    return series(spark, sf_dir, "p_name")


SPARSE = SALES + """, sparse AS (
  SELECT feed, p_name AS family, week, min(price) AS price, max(p_retailprice) AS baseline,
         CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n
  FROM sales GROUP BY feed, p_name, week
)"""

SPINE = SPARSE + """, spine AS (
  SELECT f.feed, f.family, w.week, s.price, s.baseline, s.confidence, s.n
  FROM (SELECT DISTINCT feed, family FROM sparse) f JOIN (SELECT DISTINCT feed, week FROM sparse) w ON f.feed = w.feed
       LEFT JOIN sparse s ON s.feed = f.feed AND s.family = f.family AND s.week = w.week
)"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, family, week, current_price): each series' newest week."""
    return series(spark, sf_dir).groupBy("feed", "family").agg(F.max("week").alias("week"), F.max_by("price", "week").alias("current_price"))


LATEST = SERIES + """, latest AS (
  SELECT feed, family, max(week) AS week, arg_max(price, week) AS current_price FROM series GROUP BY feed, family
)"""
