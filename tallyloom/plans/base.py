"""The count model over the test tables, and registration of queries with their SQL.

unit = order, place = customer, municipality = nation, department = region; a category is return flag and line status, its
votes the summed quantity; the year is the order's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import Hierarchy, Metric

H = Hierarchy(("department", "municipality", "place", "unit"))
VOTES = Metric("votes")
CATEGORIES = ["AF", "NF", "NO", "RF"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; integers come back as bigint."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = _with(sql)
        return f

    return add


def _with(sql: str) -> str:
    s = sql.strip()
    if s.startswith("WITH RECURSIVE "):
        return CTE.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + s[15:]
    return CTE + (",\n" + s[5:] if s[:5].upper() == "WITH " else "\n" + s)


CTE = """WITH facts AS (
  SELECT n_regionkey AS department, n_nationkey AS municipality, c_custkey AS place, o_orderkey AS unit, year(o_orderdate)::BIGINT AS year,
         l_returnflag || l_linestatus AS category, CAST(sum(l_quantity) AS BIGINT) AS votes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL
), units AS (
  SELECT n_regionkey AS department, n_nationkey AS municipality, c_custkey AS place, o_orderkey AS unit, year(o_orderdate)::BIGINT AS year, o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), geo AS (
  SELECT DISTINCT level, id, parent_id FROM (
    SELECT 'department' AS level, department::VARCHAR AS id, NULL::VARCHAR AS parent_id FROM units
    UNION ALL SELECT 'municipality', concat_ws('/', department, municipality), department::VARCHAR FROM units
    UNION ALL SELECT 'place', concat_ws('/', department, municipality, place), concat_ws('/', department, municipality) FROM units
    UNION ALL SELECT 'unit', concat_ws('/', department, municipality, place, unit), concat_ws('/', department, municipality, place) FROM units)
), sources AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END AS source, l_orderkey AS unit, l_returnflag || l_linestatus AS category, CAST(sum(l_quantity) AS BIGINT) AS votes
  FROM lineitem GROUP BY ALL
), rates AS (
  SELECT department, municipality, place, unit, sum(votes)::BIGINT AS n, coalesce(sum(votes) FILTER (WHERE category IN ('RF', 'AF')), 0)::BIGINT AS y,
         sum(votes) >= 80 AS eligible FROM facts GROUP BY ALL
)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINES = 1_000_000  # lines, or orders, of one task


def tasks(spark: SparkSession, d: str, name: str) -> int | None:
    """Tasks of LINES rows of a table where the session's would hold more."""
    n = -(-table(spark, d, name).count() // LINES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def units(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    if dealt_to := tasks(spark, d, "orders"):
        c = c.repartition(dealt_to, "c_custkey")  # orders follow where they are shuffled for the join
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_regionkey").cast("long").alias("department"), F.col("n_nationkey").cast("long").alias("municipality"), F.col("c_custkey").alias("place"), F.col("o_orderkey").alias("unit"), F.year("o_orderdate").cast("long").alias("year"), "o_orderdate", "o_totalprice")


def dealt(spark: SparkSession, d: str, df: DataFrame, *by: str) -> DataFrame:
    """df, which grows with the lines, dealt by columns: into more tasks than the session's where those would hold over LINES."""
    n = tasks(spark, d, "lineitem")
    return df.repartition(n, *by) if n else df.repartition(*by)


def by_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines dealt by order, once for all that groups or joins by it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("category"), "l_quantity")
    return dealt(spark, d, lines, "l_orderkey")


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of each unit's categories, dealt by unit."""
    return by_order(spark, d).groupBy(F.col("l_orderkey").alias("unit"), "category").agg(F.sum("l_quantity").cast("long").alias("votes"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).join(units(spark, d).select("department", "municipality", "place", "unit", "year"), "unit").select("department", "municipality", "place", "unit", "year", "category", "votes")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Two layers: odd and even lines."""
    s = F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("source")
    return by_order(spark, d).groupBy(s, F.col("l_orderkey").alias("unit"), "category").agg(F.sum("l_quantity").cast("long").alias("votes"))


def stateful(spark: SparkSession, d: str) -> DataFrame:
    """One row for each unit with a stateful metric: every seventh is unavailable."""
    u = facts(spark, d).groupBy("department", "municipality", "place", "unit").agg(F.sum("votes").alias("v"))
    ok = F.col("unit") % 7 != 0
    return u.select("department", "municipality", "place", "unit", F.when(ok, F.col("v")).alias("votes"), F.when(ok, "observed").otherwise("unavailable").alias("votes_status"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    hit = F.when(F.col("category").isin("RF", "AF"), F.col("votes")).otherwise(0)
    g = facts(spark, d).groupBy("department", "municipality", "place", "unit").agg(F.sum("votes").alias("n"), F.sum(hit).alias("y"))
    return g.withColumn("eligible", F.col("n") >= 80)


def geo(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.operators import rollup

    return rollup.geography(units(spark, d), H).select("level", "id", "parent_id")


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]
