"""Bounded read-only statements, and the audit of logged ones."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from runlens.functions import check_statement, statement_error
from runlens.plans import Limits, clamp_limit
from runlens.plans.arguments import DEFAULT_LIMITS

DEFAULT_ROWS = 200
OTHER_TABLES = "only the given tables can be read"
CALLS_OUT = "scripts and calls into the JVM are not allowed"
_CALLING = tuple(
    f"org.apache.spark.sql.catalyst.expressions.{c}" for c in ("CallMethodViaReflection", "TryReflect")
)
#: Leaves of a statement that read nothing.
_ROWS_OF_ITS_OWN = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


@contextmanager
def _views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """The tables as views while a statement is analysed; the caller's own views come back."""
    earlier = {}
    for name in tables:
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            earlier[name] = spark.table(name)
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in earlier.items():
            df.createOrReplaceTempView(name)


def _each(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _reaches_out(plan, tables: Collection[str]) -> str | None:
    """Why an analysed statement is refused.

    Walks what Spark resolved, and stops at the views of ``tables``: what lies
    below was given. Class names in plans cannot be forged by a statement's texts.
    """
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        return None if plan.isTempView() and plan.desc().identifier().table().lower() in tables else OTHER_TABLES
    if kind == "ScriptTransformation":
        return CALLS_OUT
    if any(f'"class":"{c}"' in e.toJSON() for e in _each(plan.expressions()) for c in _CALLING):
        return CALLS_OUT
    below = [*_each(plan.children()), *_each(plan.subqueries())]
    if not below and kind not in _ROWS_OF_ITS_OWN:
        return OTHER_TABLES
    return next((reason for p in below if (reason := _reaches_out(p, tables))), None)


def run_readonly_query(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame],
    *,
    max_rows: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """At most ``max_rows`` rows of one SELECT or WITH statement over ``tables``.

    Beyond the rule on its words, what Spark makes of the statement may read
    nothing but ``tables``: no other table or view, no path, no function that
    calls into the JVM and no script. Views of the caller that have the name of
    one of ``tables`` are as they were afterwards. A column ``truncated`` tells
    on every row whether the statement had more. The window that finds out sees
    ``max_rows + 1`` rows at most.
    """
    body, error = check_statement(sql)
    if error:
        raise ValueError(f"sql: {error}")
    cap = clamp_limit(max_rows, DEFAULT_ROWS, limits.max_log_rows)
    with _views(spark, tables):
        fetched = spark.sql(f"SELECT * FROM (\n{body}\n) AS _adhoc LIMIT {cap + 1}")
    if reason := _reaches_out(fetched._jdf.queryExecution().analyzed(), {name.lower() for name in tables}):
        raise ValueError(f"sql: {reason}")
    columns = fetched.columns
    whole = Window.partitionBy()
    return (
        fetched.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_number", F.row_number().over(Window.orderBy("_row")))
        .withColumn("truncated", F.count(F.lit(1)).over(whole) > cap)
        .where(F.col("_number") <= cap)
        .select(*[F.col(f"`{c}`") for c in columns], "truncated")
    )


def statement_audit(statements: DataFrame, column: str = "sql") -> DataFrame:
    """Add ``accepted`` and ``reason`` for every statement in a column."""
    reason = statement_error(F.col(column))
    return statements.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
