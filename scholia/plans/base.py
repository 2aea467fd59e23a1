"""The driver tables seen as papers, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = 2000


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.replace("{papers}", PAPERS_SQL).replace("{AS_OF}", str(AS_OF))
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a paper: its customer's nation the venue, its customer the
    author, its segment the domain, thousands of its price the citations."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has 25 rows at any scale
    tier = F.concat(F.lit("tier"), (F.col("n_regionkey") + 1).cast("string"))
    return rows.select(F.col("o_orderkey").alias("paper_id"), F.col("n_name").alias("venue"), tier.alias("tier"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("citations"),
                       F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"), F.col("c_mktsegment").alias("domain"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"),
                       F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.col("o_orderdate").alias("ts"))


PAPERS_SQL = """papers as (select o_orderkey as paper_id, n_name as venue, 'tier' || (n_regionkey + 1)::varchar as tier, year(o_orderdate)::int as year, floor(o_totalprice / 1000)::bigint as citations,
 c_custkey as author_id, c_name as author, c_mktsegment as domain, o_orderpriority as source, o_orderstatus as status, o_totalprice as price, c_acctbal as balance, o_orderdate as ts
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_as_sql(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as DuckDB does it, by their product with 10^digits, halves
    away from zero. ``rounded`` goes by the shortest decimals; halves may differ."""
    by = float(10 ** digits)
    return df.select(*[(F.round(F.col(c) * by) / by).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
