"""Chat records of many layouts as one template, chosen by fingerprints of their fields.

A layout is data: the nested field paths it consists of and how they become
turns. The paths a record has are hashed, and the hash selects the layout, so a
new source needs a new entry in :data:`LAYOUTS` and no code. Everything is
built from column functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The template. Texts and roles have every backslash and "<" escaped by a
# backslash (roles also ">"), so no marker can stand inside them.
OPEN, CLOSE, END = "<turn ", ">\n", "\n</turn>\n"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """``lists``: an array and its role and text fields; ``fields``: roles with the text fields they join.

    ``extra`` are further fields that tell the layout and say nothing that the turns lack.
    """

    name: str
    lists: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    extra: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.lists:
            array, role, text = self.lists
            return f"{array}[].{role}", f"{array}[].{text}", *self.extra
        return *(name for _, names in self.fields for name in names), *self.extra


LAYOUTS = (
    Layout("messages", lists=("messages", "role", "content")),
    Layout("messages_prompt", lists=("messages", "role", "content"), extra=("prompt",)),
    Layout("conversations", lists=("conversations", "from", "value")),
    Layout("instruction", fields=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    Layout("instruction_input", fields=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
    Layout("prompt_completion", fields=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Layout("system_prompt_completion", fields=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Layout("prompt_response", fields=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Layout("system_prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Layout("question_answer", fields=(("user", ("question",)), (ASSISTANT, ("answer",)))),
)
#: The layout of a table with a row for each turn.
TURN_ROWS = ("conv_id", "role", "text", "turn")
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves; ``[]`` steps into an array."""
    if isinstance(schema, T.StructType):
        dot = f"{at}." if at else ""
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{dot}{f.name}")]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


_KNOWN = sorted({p for layout in LAYOUTS for p in layout.paths})


def record_schema() -> T.StructType:
    """What is read from a JSON record: the union of all layouts, as texts."""
    fields = {}
    for layout in LAYOUTS:
        if layout.lists:
            array, role, text = layout.lists
            element = T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])
            fields[array] = T.StructField(array, T.ArrayType(element))
        names = [*layout.extra, *(name for _, several in layout.fields for name in several)]
        fields |= {name: T.StructField(name, T.StringType()) for name in names}
    return T.StructType([fields[name] for name in sorted(fields)])


def _parts_schema() -> T.StructType:
    """The lists of all layouts where a text is itself a list of typed parts."""
    part = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
    lists = {layout.lists for layout in LAYOUTS if layout.lists}
    return T.StructType(
        [T.StructField(array, T.ArrayType(T.StructType([T.StructField(text, T.ArrayType(part))]))) for array, _, text in sorted(lists)]
    )


def _present(record: Column, path: str) -> Column:
    array, step, name = path.partition("[].")
    if not step:
        return record[path].isNotNull()
    return F.coalesce(F.exists(record[array], lambda x: x[name].isNotNull()), F.lit(False))


def record_fingerprint(record: Column) -> Column:
    """The hash of the known paths that hold a value in this record."""
    there = F.array_compact(F.array(*(F.when(_present(record, p), F.lit(p)) for p in _KNOWN)))
    return F.sha2(F.array_join(there, "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _canonical_role(role: Column) -> Column:
    return reduce(lambda done, x: done.when(F.lower(role) == x[0], F.lit(x[1])), ROLES.items(), F.when(F.lit(False), role)).otherwise(
        F.coalesce(role, F.lit(""))
    )


def _turns(record: Column, parts: Column, layout: Layout) -> Column:
    if layout.lists:
        array, role, text = layout.lists

        def joined(i: Column) -> Column:
            texts = F.transform(F.get(parts[array], i)[text], lambda p: F.when(F.coalesce(p["type"], F.lit("text")) == "text", p["text"]))
            return F.array_join(F.array_compact(texts), "")

        return F.transform(record[array], lambda x, i: _turn(_canonical_role(x[role]), F.coalesce(joined(i), x[text], F.lit(""))))

    def several(names: tuple[str, ...]) -> Column:
        # Of fields that are joined an empty one adds nothing, not even the gap.
        return F.concat_ws("\n\n", *(F.nullif(record[n], F.lit("")) for n in names))

    return F.array(*(_turn(F.lit(role), several(names)) for role, names in layout.fields))


def turns_from_records(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``key``, ``layout`` and ``turns`` of JSON records, each of any layout.

    Unknown fields do not matter. A text that is a list of parts is its text
    parts, joined; images and the like are left out. A record that is null, no JSON or of no known
    layout has ``layout`` null and no turns.
    """
    parsed = F.col("_record")
    parts = F.from_json(F.col(record), _parts_schema())
    rows = df.select(F.col(key), F.from_json(F.col(record), record_schema()).alias("_record"), parts.alias("_parts"))
    rows = rows.withColumn("_print", record_fingerprint(parsed))
    name, turns = F.lit(None).cast("string"), F.array().cast(T.ArrayType(TURN))
    for layout in LAYOUTS:
        here = F.col("_print") == fingerprint(layout.paths)
        name = F.when(here, F.lit(layout.name)).otherwise(name)
        turns = F.when(here, _turns(parsed, F.col("_parts"), layout)).otherwise(turns)
    return rows.select(key, name.alias("layout"), turns.alias("turns"))


def turns_from_rows(df: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` of a table with a row for each turn.

    Turns go by number, ties by role, then text; null comes first. A null role
    or text is empty; roles stay as they are. The rows of one conversation meet in one cell, as its
    formatted text is one; that is what bounds its length.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: _turn(t["role"], t["text"]))
    return df.groupBy("conv_id").agg(turns.alias("turns"))


def canonical_turns(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """Turns of a table of either kind, told by the fingerprint of its schema's known paths."""
    paths = [p for p in schema_paths(df.schema) if p in TURN_ROWS]
    if fingerprint(paths) == fingerprint(TURN_ROWS):
        return turns_from_rows(df)
    return turns_from_records(df, key, record)


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(_escape(turn["role"]), F.lit(">"), F.lit("\\>")), F.lit(CLOSE))


def format_chats(df: DataFrame) -> DataFrame:
    """The rows with ``formatted`` and ``loss_spans`` in place of ``turns`` and of columns of these names.

    ``loss_spans`` are the texts of the assistant: the turn's number, and start
    and length in code points inside the turn's stretch of ``formatted``, so
    reading one span never walks the whole conversation. No turns give an empty
    text and no spans.
    """
    stretch = F.transform("turns", lambda t: F.concat(_head(t), _escape(t["text"]), F.lit(END)))
    span = F.transform(
        "turns",
        lambda t, i: F.when(
            t["role"] == ASSISTANT,
            F.struct(i.alias("turn"), F.length(_head(t)).alias("start"), F.length(_escape(t["text"])).alias("length")),
        ),
    )
    columns = [c for c in df.columns if c.lower() not in ("turns", "formatted", "loss_spans")]
    return df.select(*columns, F.array_join(stretch, "").alias("formatted"), F.array_compact(span).alias("loss_spans"))


def _stretches(formatted: Column) -> Column:
    """A formatted text by turns, without their end markers."""
    parts = F.split(formatted, F.lit(END.replace("/", "\\/")))
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns a formatted text was made of, texts and roles unescaped."""
    head = r"(?s)^<turn ((?:[^\\>]++|\\.)*+)>\n"

    def turn(s: Column) -> Column:
        role = F.regexp_extract(s, head, 1)
        text = F.substr(s, F.length(F.lit(OPEN + CLOSE)) + F.length(role) + 1)
        return _turn(_unescape(role), _unescape(text))

    return F.transform(_stretches(formatted), turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its spans."""
    stretches = _stretches(formatted)
    return F.array_join(
        F.transform(
            loss_spans,
            lambda s: _unescape(F.substr(F.element_at(stretches, s["turn"] + 1), s["start"] + 1, s["length"])),
        ),
        "",
    )
