"""Statements, segments and rates read from the star schema's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_of(ts: str):
    """Quarters counted from year 0, so neighbours differ by one."""
    return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")


def _money(c: str):
    """Cents as decimals, whose sums don't depend on the order of partitions."""
    return F.col(c).cast("decimal(15,2)")


def _net():
    return _money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))


def _rounded(c):
    return F.round(F.sum(c), 3).cast("double")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company (the supplier's nation), q_ord, revenue, cost, tax: one row a quarter."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", quarter_of("l_shipdate").alias("q_ord"), "l_extendedprice", "l_discount", "l_tax")
    # sums by supplier first: lineitem is shuffled once, by small rows, and then joined
    money = lambda x, n: F.sum(x).alias(n)
    by_supplier = lines.groupBy("l_suppkey", "q_ord").agg(money(_net(), "revenue"), money(_money("l_extendedprice") * F.lit(0.6).cast("decimal(2,1)"), "cost"), money(_net() * F.col("l_tax").cast("decimal(4,2)"), "tax"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("company"))
    return by_supplier.join(suppliers, "l_suppkey").groupBy("company", "q_ord").agg(*(_rounded(c).alias(c) for c in ("revenue", "cost", "tax")))


def sparse_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company (a part), q_ord, revenue: most quarters of a part are missing."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("company"), quarter_of("l_shipdate").alias("q_ord")).agg(_rounded(_net()).alias("revenue"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, q_ord, member (flag and status), value."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", quarter_of("l_shipdate").alias("q_ord"), F.concat("l_returnflag", "l_linestatus").alias("member")).agg(F.sum(_net()).alias("value"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("company"))
    return lines.join(suppliers, "l_suppkey").groupBy("company", "q_ord", "member").agg(_rounded("value").alias("value"))


def order_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source of revenue: orders by the customer's nation."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), quarter_of("o_orderdate").alias("q_ord")).agg(F.sum(_money("o_totalprice")).alias("value"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("company"))
    return orders.join(customers, "c_custkey").groupBy("company", "q_ord").agg(_rounded("value").alias("revenue"))
