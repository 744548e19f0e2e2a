"""The three tables every operator reads.

Times carry no zone and are UTC. Ids are text; JSON stays text until an
operator parses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TS = T.TimestampNTZType()
_S = T.StringType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


ACTIVITY = _struct(
    ("id", _S, False),
    ("created_on", _TS, False),
    ("application", _S, True),
    ("environment", _S, True),
    ("activity_type", _S, True),
    ("activity_key", _S, True),
    ("target", _S, True),
    ("status", _S, True),
    ("started_on", _TS, True),
    ("completed_on", _TS, True),
    ("records_impacted", T.LongType(), True),
    ("error_type", _S, True),
    ("host", _S, True),
    ("last_heartbeat_on", _TS, True),
    ("parameters", _S, True),
    ("metrics", _S, True),
    ("error", _S, True),
    ("created_by", T.LongType(), True),
    ("process_id", T.IntegerType(), True),
    ("parent_activity_id", _S, True),
    ("root_activity_id", _S, True),
    ("trace_id", _S, True),
    ("span_id", _S, True),
    ("scheduler_instance_id", _S, True),
    ("fire_instance_id", _S, True),
    ("quartz_job_name", _S, True),
    ("quartz_job_group", _S, True),
    ("quartz_trigger_name", _S, True),
    ("quartz_trigger_group", _S, True),
)

ACTIVITY_INPUT = _struct(
    ("activity_id", _S, False),
    ("input_activity_id", _S, False),
    ("input_role", _S, True),
    ("created_on", _TS, False),
)

LOG_ENTRIES = _struct(
    ("id", T.LongType(), False),
    ("event_time_utc", _TS, False),
    ("log_level", T.IntegerType(), False),
    ("category", _S, True),
    ("event_id", T.IntegerType(), True),
    ("event_name", _S, True),
    ("message", _S, True),
    ("message_template", _S, True),
    ("properties", _S, True),
    ("exception", _S, True),
    ("exception_type", _S, True),
    ("activity_id", _S, True),
    ("trace_id", _S, True),
    ("span_id", _S, True),
    ("application", _S, True),
    ("host", _S, True),
)

TABLES = {
    "activity": ACTIVITY,
    "activity_input": ACTIVITY_INPUT,
    "log_entries": LOG_ENTRIES,
}

#: The time column each table is windowed on, and the month column a
#: partitioned copy of the table carries (an int such as 202403).
TIME_COLUMN = {
    "activity": "created_on",
    "activity_input": "created_on",
    "log_entries": "event_time_utc",
}
MONTH_COLUMN = {
    "activity": "created_month",
    "activity_input": "created_month",
    "log_entries": "event_month",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's columns in order with their declared types.

    Columns that a source lacks become null, so a partial copy of a table is
    still readable. The month column is kept when present because scans prune
    on it.
    """
    present = set(df.columns)
    columns = [
        (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in TABLES[table].fields
    ]
    month = MONTH_COLUMN[table]
    if month in present:
        columns.append(F.col(month))
    return df.select(*columns)
