"""Tables and the series that queries are made of, on both sides: DataFrame and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_series(spark: SparkSession, sf_dir: str, points: int = POINTS) -> DataFrame:
    """(id, s): each user's values in time, in blocks of ``points`` that follow each other; what is left over joins the last one.

    So every event is in one series, and a series has fewer than twice ``points`` values whatever a user's number of events.
    Rows are numbered before they are gathered.  The id is the user's, and block times 2**40.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    w = Window.partitionBy("user_id")
    numbered = events.withColumns({"rn": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count("event_id").over(w)})
    block = F.least(F.floor((F.col("rn") - 1) / points), F.greatest(F.floor(F.col("n") / points), F.lit(1)) - 1)
    return numbered.groupBy((F.col("user_id") + block * F.lit(1 << 40)).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("s"))


#: DuckDB twin of ``user_series``.
SERIES = f"""series AS (SELECT user_id + least((rn - 1) // {POINTS}, greatest(n // {POINTS}, 1) - 1) * {1 << 40} AS id, list(value ORDER BY rn) AS s FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1)"""

#: One row per point: id, pos from 0, x, and the series' length n.
POINTS_SQL = """points AS (SELECT id, unnest(range(0, len(s))) AS pos, unnest(s) AS x, len(s) AS n FROM series)"""


def case_rows(spark: SparkSession, sf_dir: str, source: str, id_col: str, cases: list[tuple], columns: str) -> DataFrame:
    """(id, the case's columns): each row of ``source`` takes one of some literal cases in turn; the last values are what is to come out."""
    own = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"case_no long, {columns}")
    ids = table(spark, sf_dir, source).select(F.col(id_col).alias("id"))
    return ids.withColumn("case_no", F.pmod("id", F.lit(len(cases)))).join(F.broadcast(own), "case_no").drop("case_no")  # a few literal rows


def case_sql(source: str, id_col: str, cases: list[tuple], columns: str) -> str:
    """``cases(id, ...)`` with the same rows for DuckDB."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    names = [c.split()[0] for c in columns.split(", ")]
    rows = ", ".join("(" + ", ".join(map(literal, (i, *c))) + ")" for i, c in enumerate(cases))
    return f"""cases AS (SELECT {id_col} AS id, {", ".join(names)} FROM {source} JOIN (VALUES {rows}) v(case_no, {", ".join(names)}) ON {id_col} % {len(cases)} = case_no)"""


def sql_normal_p(z: str) -> str:
    """Two-sided normal p value in DuckDB, which has no error function: its series with positive terms, 0 from 7 deviations on."""
    x = f"(abs({z}) / sqrt(2))"
    terms = f"list_sum(list_transform(range(0, 84), lambda k: pow(2 * {x} * {x}, k) * {x} * pow(2, k) * gamma(k + 1) / gamma(2 * k + 2)))"
    return f"CASE WHEN {x} < 5 THEN 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms} WHEN {x} >= 5 THEN 0.0 END"


def sql_t_p(t: str, df: str) -> str:
    """Two-sided p value of Student's t for whole degrees of freedom in DuckDB: the finite series for even and odd ones."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * j)))"
    odd = f"2 / pi() * ({angle} + coalesce(sin({angle}) * list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({angle}), 2 * j + 1))), 0))"
    return f"CASE WHEN {df} < 1 OR {t} IS NULL THEN NULL WHEN {df} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


class Registry:
    """Queries and their DuckDB twins, in order of definition."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep
