"""Tables that the registered queries read, with dates as dates and money as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The day on which the queries look at the tables.
AS_OF = "2001-08-02"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with odate (date) and price (decimal)."""
    return read(spark, sf_dir, "orders").withColumns({"odate": F.to_date("o_orderdate"), "price": money("o_totalprice")})


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumns({"sdate": F.to_date("l_shipdate"), "price": money("l_extendedprice")})


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def text(column: str) -> Column:
    """A date as text, the same in both engines."""
    return F.col(column).cast("string")
