"""The three tables derived from the TPC-H-like test tables.

The recipe is written down in FIXTURES.md; the oracle SQL repeats it for
DuckDB. Every row of ``orders`` is a run and every row of ``lineitem`` a log
line. Times and ids follow from the order key alone, so no join or window is
needed to link a line or an edge to its run; only the long texts come from a
join with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.schema import conform
from runlens.sources.registry import Tables


def _micros(k: str) -> str:
    """Microseconds from 1995-01-01 to the creation of run ``k``."""
    return f"({k} * 15485863 % 207705600 * 1000000 + {k} * 131 % 1000000)"


def _created_on(k: str) -> str:
    return f"timestampadd(MICROSECOND, {_micros(k)}, TIMESTAMP_NTZ '1995-01-01 00:00:00')"


def _run_id(k: str) -> str:
    ms = f"lower(lpad(hex(788918400000 + {_micros(k)} div 1000), 12, '0'))"
    version = f"if({k} % 97 = 0, '4', '7')"
    return (
        f"concat(left({ms}, 8), '-', right({ms}, 4), '-', {version}, '000-8000-', lower(lpad(hex({k}), 12, '0')))"
    )


def _application(k: str) -> str:
    return (
        f"CASE WHEN {k} % 101 = 0 THEN NULL WHEN {k} % 103 = 0 THEN '' WHEN {k} % 3 = 0 THEN 'app0' "
        f"ELSE concat('app', {k} % 12) END"
    )


_STATUS = """
CASE WHEN o_orderkey % 20 < 12 OR o_orderkey % 20 = 19 THEN 'succeeded'
     WHEN o_orderkey % 20 <= 13 THEN 'failed' WHEN o_orderkey % 20 = 14 THEN 'canceled'
     WHEN o_orderkey % 20 <= 16 THEN 'skipped' WHEN o_orderkey % 20 = 17 THEN 'running' ELSE 'pending' END"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _stored(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a column that later filters read instead of repeating its expression.

    Stored tables hold ids as values. Here they are computed, and without this
    the optimizer would copy the expression into every predicate on them.
    """
    return df.selectExpr("*", f"explode(array({value})) AS {name}")


def _with_document(df: DataFrame, spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """Attach a document's text, null where none matches."""
    documents = _read(spark, sf_dir, "documents").selectExpr("doc_id", "text AS _text")
    return df.join(documents, F.expr(match), "left")


def activity(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """Runs. ``text=False`` leaves the error text out and with it the join."""
    orders = _read(spark, sf_dir, "orders").selectExpr("*", f"{_STATUS} AS status")
    if text:
        # The status is part of the join condition, not of the key: a null key
        # for all other runs would send them to one task.
        failed = "status IN ('failed', 'canceled')"
        orders = _with_document(orders, spark, sf_dir, f"doc_id = o_custkey AND {failed}")
    else:
        orders = orders.selectExpr("*", "CAST(NULL AS STRING) AS _text")
    k, c = "o_orderkey", "o_custkey"
    derived = (
        _stored(orders, _run_id(k), "id")
        .selectExpr("*", f"{_created_on(k)} AS created_on")
        .selectExpr(
            "*", f"if(status <> 'pending', timestampadd(MILLISECOND, {k} % 5000, created_on), NULL) AS started_on"
        )
        .selectExpr(
            "id",
            "created_on",
            f"{_application(k)} AS application",
            "CASE o_orderstatus WHEN 'F' THEN 'prod' WHEN 'O' THEN 'test' ELSE 'dev' END AS environment",
            "o_orderpriority AS activity_type",
            f"if({k} % 50 <> 0, concat('job', {c} % 150), NULL) AS activity_key",
            f"concat('dw.customer_', {c}, "
            f"CASE {k} % 7 WHEN 0 THEN '%' WHEN 1 THEN '!' WHEN 2 THEN '_' ELSE '' END) AS target",
            "status",
            "started_on",
            "if(status NOT IN ('pending', 'running'), "
            "timestampadd(MICROSECOND, CAST(rint(o_totalprice * 100) AS BIGINT) * 37, started_on), NULL) AS completed_on",
            f"if({k} % 13 <> 0, CAST(floor(o_totalprice) AS BIGINT), NULL) AS records_impacted",
            f"if(status IN ('failed', 'canceled'), concat('E', {k} % 5), NULL) AS error_type",
            f"concat('host', {c} % 40) AS host",
            f"CASE WHEN {k} % 43 = 0 THEN ' ' WHEN {k} % 41 = 0 THEN 'oops' "
            f"ELSE concat('{{\"k\": ', {k}, '}}') END AS parameters",
            f"if({k} % 2 = 0, concat('[', {k} % 9, ', null]'), NULL) AS metrics",
            "_text AS error",
            f"{c} AS created_by",
            f"CAST({k} % 65536 AS INT) AS process_id",
            f"CASE WHEN {k} % 5 = 0 THEN '' ELSE {_run_id(f'({k} - 1)')} END AS parent_activity_id",
            f"{_run_id(f'({k} - {k} % 100)')} AS root_activity_id",
            f"lower(lpad(hex({k}), 12, '0')) AS trace_id",
        )
        .selectExpr("*", "completed_on AS last_heartbeat_on")
    )
    return conform(derived, "activity")


def activity_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage edges: up to four inputs per run, among them a shared hub and a lost id."""
    k = "o_orderkey"
    edges = ", ".join(
        f"named_struct('input_role', '{role}', 'input_activity_id', if({when}, {target}, NULL))"
        for role, when, target in (
            ("previous", f"{k} >= 1", _run_id(f"({k} - 1)")),
            ("baseline", f"{k} % 3 = 0 AND {k} >= 2", _run_id(f"({k} - 2)")),
            ("hub", f"{k} % 100 <> 0", _run_id(f"({k} - {k} % 100)")),
            ("lost", f"{k} % 31 = 0", f"concat('gone-', {k})"),
        )
    )
    derived = (
        _read(spark, sf_dir, "orders")
        .selectExpr(f"{_run_id(k)} AS activity_id", f"{_created_on(k)} AS created_on", f"inline(array({edges}))")
        .where("input_activity_id IS NOT NULL")
    )
    return conform(derived, "activity_input")


def log_entries(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """Log lines. ``text=False`` leaves message and exception out and with them the join."""
    lines = _read(spark, sf_dir, "lineitem")
    if text:
        lines = _with_document(lines, spark, sf_dir, "doc_id = l_partkey")
    else:
        lines = lines.selectExpr("*", "CAST(NULL AS STRING) AS _text")
    k, part, supp, line = "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    minutes = f"({line} + CASE {line} WHEN 6 THEN 1800 WHEN 7 THEN 4320 ELSE 0 END)"
    micros = f"CAST({minutes} AS BIGINT) * 60000000 + {part} % 60000 * 1000 + {supp} % 1000"
    is_exception = f"log_level >= 4 AND {part} % 2 = 0"
    derived = (
        _stored(lines, _run_id(k), "activity_id")
        .selectExpr("*", "CAST(CAST(l_quantity AS BIGINT) % 7 AS INT) AS log_level")
        .selectExpr(
            f"({k} * 8 + {line}) * 1048576 "
            f"+ ({part} * 31 + {supp} * 17 + CAST(rint(l_extendedprice * 100) AS BIGINT)) % 1048576 AS id",
            f"timestampadd(MICROSECOND, {_micros(k)} + {micros}, TIMESTAMP_NTZ '1995-01-01 00:00:00') AS event_time_utc",
            "log_level",
            f"if({part} % 17 <> 0, concat('Svc.', l_returnflag, '.', {part} % 15), NULL) AS category",
            f"CAST({supp} % 100 AS INT) AS event_id",
            f"concat('Event', {supp} % 100) AS event_name",
            "_text AS message",
            "'{text}' AS message_template",
            f"CASE WHEN {part} % 31 = 0 THEN '' WHEN {part} % 29 = 0 THEN 'not json {{' "
            f"ELSE concat('{{\"part\": ', {part}, '}}') END AS properties",
            f"if({is_exception}, _text, NULL) AS exception",
            f"if({is_exception}, CASE {part} % 3 WHEN 0 THEN 'IOException' WHEN 1 THEN 'TimeoutException' "
            "ELSE 'KeyError' END, NULL) AS exception_type",
            "activity_id",
            f"lower(lpad(hex({k}), 12, '0')) AS trace_id",
            f"{_application(k)} AS application",
            f"concat('host', {supp} % 40) AS host",
        )
    )
    return conform(derived, "log_entries")


def tables(spark: SparkSession, sf_dir: str, *, text: bool = True) -> Tables:
    """The derived tables as one source."""

    def load(name: str) -> DataFrame:
        if name == "activity_input":
            return activity_input(spark, sf_dir)
        return {"activity": activity, "log_entries": log_entries}[name](spark, sf_dir, text=text)

    return Tables(load)
