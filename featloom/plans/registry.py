"""Query registry and the test tables with gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featloom.sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TESTED_BY: dict[str, str] = {}


def query(name: str, sql: str | None = None, tested_by: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin, if it has one.

    A query without a twin names the test that holds it against brute force or known facts.
    """

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        elif tested_by is not None:
            TESTED_BY[name] = tested_by
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


# The given tables hold no NULL, so both engines blank the same cells of lineitem.
GAPPY_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS qty",
    "l_extendedprice AS price",
    "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_discount END AS disc",
    "l_tax AS tax",
    "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END AS flag",
    "l_linestatus AS status",
]
GAPPY_SQL = f"g AS (SELECT {', '.join(GAPPY_COLUMNS)} FROM lineitem)"
GAPPY_NUMERIC = ["qty", "price", "disc", "tax"]

# Columns of known signal: the band follows the price, gross follows price and quantity.
SIGNAL_COLUMNS = [
    "l_quantity AS qty",
    "l_extendedprice AS price",
    "l_discount AS disc",
    "l_tax AS tax",
    "l_quantity * l_extendedprice AS gross",
    "l_extendedprice * (1 - l_discount) AS net",
    "CAST(l_suppkey AS INTEGER) AS supp",
    "l_returnflag AS flag",
    "l_linestatus AS status",
    "CASE WHEN l_quantity * l_extendedprice < 500000 THEN 'small' "
    "WHEN l_quantity * l_extendedprice < 1500000 THEN 'medium' ELSE 'large' END AS size_class",
    "CASE WHEN l_extendedprice < 30000 THEN 'low' WHEN l_extendedprice < 60000 THEN 'mid' ELSE 'high' END AS band",
]
SIGNAL_SQL = f"s AS (SELECT {', '.join(SIGNAL_COLUMNS)} FROM lineitem)"
SIGNAL_NUMERIC = ["qty", "price", "disc", "tax", "gross", "net", "supp"]


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*GAPPY_COLUMNS)


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*SIGNAL_COLUMNS)


# --- SQL fragments --------------------------------------------------------------


def sql_hash(key: str, seed: str = "42") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT)"


def sql_uniform(key: str, seed: str = "42") -> str:
    return f"(CAST({sql_hash(key, seed)} AS DOUBLE) / 4503599627370496.0)"


def sql_pearson(rel: str, x: str, y: str) -> str:
    return (
        f"(SELECT covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) FROM {rel} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    )


def sql_eta(rel: str, x: str, g: str) -> str:
    return f"""(SELECT coalesce(sum(n * (m - gm) * (m - gm))
                       / nullif(sum(n * (m - gm) * (m - gm)) + sum(n * v), 0), 0)
               FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm
                     FROM (SELECT count(*) AS n, avg({x}) AS m, var_pop({x}) AS v FROM {rel}
                           WHERE {x} IS NOT NULL AND {g} IS NOT NULL GROUP BY {g})))"""


def sql_cramer(rel: str, a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN least(count(DISTINCT a), count(DISTINCT b)) > 1
                 THEN sqrt(greatest(sum(CAST(o AS DOUBLE) * o / (CAST(ra AS DOUBLE) * cb)) - 1, 0)
                           / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) END
               FROM (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb
                     FROM (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {rel}
                           WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)))"""


def sql_signal(strength: str) -> str:
    return f"CASE WHEN {strength} >= 0.5 THEN 'High' WHEN {strength} >= 0.2 THEN 'Medium' ELSE 'Low' END"


def sql_rows(items: list[str]) -> str:
    return "\nUNION ALL\n".join(items)
