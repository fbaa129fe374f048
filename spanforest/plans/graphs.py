"""Graphs over the tables of a data folder, each with the SQL of the same graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import nearest_edges

PRICE = "cast(l_extendedprice as decimal(18,2))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w, ord of every line item: nations of customer and supplier, price, place. With loops and repeated pairs."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.expr(PRICE).alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("u"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("v"))
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("u", "v", "w", F.struct("l_orderkey", "l_linenumber", "w").alias("ord"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nation_sales(spark, sf_dir).filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.agg(F.sum("w").alias("w"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_acctbal").cast("decimal(18,2)").alias("b"))


def supplier_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete over the suppliers by definition: as many edges as pairs."""
    own = supplier_points(spark, sf_dir)
    other = own.select(F.col("k").alias("l"), F.col("b").alias("c"))
    return own.join(other, F.col("k") < F.col("l")).select(F.col("k").alias("u"), F.col("l").alias("v"), F.abs(F.col("b") - F.col("c")).alias("w"))


def supplier_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of `supplier_balance` that its minimum spanning forest can have, without making the others."""
    return nearest_edges(supplier_points(spark, sf_dir))


def part_supplier(spark: SparkSession, sf_dir: str, below: float | None = None) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    if below is not None:
        line = line.filter(F.col("l_extendedprice") < below)
    pairs = line.groupBy(F.col("l_partkey").cast("bigint").alias("u"), (F.col("l_suppkey") + 1_000_000).cast("bigint").alias("v"))
    return pairs.agg(F.min(F.expr(PRICE)).alias("w"))


def part_supplier_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_supplier(spark, sf_dir, 2000.0)


GRAPHS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (nation_trade, supplier_balance, part_supplier, part_supplier_sparse)}

SALES_SQL = f"""select c_nationkey::bigint as u, s_nationkey::bigint as v, {PRICE} as w, l_orderkey, l_linenumber
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"""

GRAPH_SQL = {
    "nation_trade": f"select least(u, v) as u, greatest(u, v) as v, sum(w) as w from ({SALES_SQL}) where u <> v group by 1, 2",
    "supplier_balance": "select a.s_suppkey::bigint as u, b.s_suppkey::bigint as v, abs(cast(a.s_acctbal as decimal(18,2)) - cast(b.s_acctbal as decimal(18,2))) as w from supplier a join supplier b on a.s_suppkey < b.s_suppkey",
    "part_supplier": f"select l_partkey::bigint as u, (1000000 + l_suppkey)::bigint as v, min({PRICE}) as w from lineitem group by 1, 2",
    "part_supplier_sparse": f"select l_partkey::bigint as u, (1000000 + l_suppkey)::bigint as v, min({PRICE}) as w from lineitem where l_extendedprice < 2000 group by 1, 2",
}
