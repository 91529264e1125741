"""Chat formatting: records of many layouts become canonical turns, then templated text with a loss mask.

Schema fingerprinting: the nested field paths of a table's schema, or of a JSON record, are hashed; the
hash selects a declarative mapping from LAYOUTS (prompt/response, instruction/input/output, message
lists, turn rows). A mapping lists the turns' (role, path) or the list that holds them. Columns that no
layout names are left out before. Unknown layouts are reported, not guessed.

The template is `### Role: text</turn>` and a line feed. Inside roles and texts, backslashes and the
control strings get a backslash before them, which read_back removes, so any text survives.

Defined results: a null text is empty; a null role is `unknown`; turns are ordered by turn, role and
text, nulls first, so ties and repeated rows are all kept in one order; rows with a null conversation
form one conversation; extra columns are not read; an empty table gives an empty result. A
conversation is streamed in order through one task turn by turn and never held as a whole: its digests
are sequential, so a conversation with very many turns keeps its task busy for long, at a turn's memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task, tune

HEAD, END = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\])*?): ((?:\\.|[^\\])*?)</turn>\n", re.DOTALL)
LOSS_ROLE = "assistant"

#: Declarative mappings. one: a record is one turn (role path, text path); turns: fixed turns in
#: order; each: a list of turns (list path, role field, text field). Roles start with = if constant.
LAYOUTS: list[dict] = [
    {"paths": ["conv_id", "role", "text", "turn"], "one": ("role", "text")},
    {"paths": ["prompt", "response"], "turns": [("=user", "prompt"), ("=assistant", "response")]},
    {"paths": ["prompt", "completion"], "turns": [("=user", "prompt"), ("=assistant", "completion")]},
    {"paths": ["instruction", "output"], "turns": [("=user", "instruction"), ("=assistant", "output")]},
    {"paths": ["input", "instruction", "output"], "turns": [("=user", "instruction"), ("=user", "input"), ("=assistant", "output")]},
    {"paths": ["question", "answer"], "turns": [("=user", "question"), ("=assistant", "answer")]},
    {"paths": ["messages[].content", "messages[].role"], "each": ("messages", "role", "content")},
    {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
]
#: Names by which layouts call the roles (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a record; list items share the path of their list, with []."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}


def canonical_turns(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) turns of a record by its layout's mapping; None: no mapping has this fingerprint."""
    layout = MAPPINGS.get(fingerprint(paths(record)))
    if layout is None:
        return None

    def turn(role: object, text: object) -> tuple[str, str]:
        role = "unknown" if role is None else str(role)
        return ROLES.get(role, role), "" if text is None else str(text)

    if "one" in layout:
        role, text = layout["one"]
        return [turn(record[role], record[text])]
    if "each" in layout:
        items, role, text = layout["each"]
        return [turn(x.get(role), x.get(text)) for x in record[items]]
    return [turn(r[1:] if r[0] == "=" else record[r], record[t]) for r, t in layout["turns"] if not (r == "=user" and t == "input" and not record[t])]


#: First names of all paths that layouts use.
KNOWN_COLUMNS = frozenset(re.split(r"[.\[]", p)[0] for x in LAYOUTS for p in x["paths"])


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema, as `paths` gives them for a record."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def layout_of(schema: T.StructType) -> dict:
    """The mapping that the schema's fingerprint selects; columns that no layout names are extra."""
    used = T.StructType([f for f in schema.fields if f.name in KNOWN_COLUMNS])
    found = MAPPINGS.get(fingerprint(schema_paths(used))) if used.fields else None
    if found is None:
        raise ValueError(f"no layout for {', '.join(sorted(schema_paths(used)) if used.fields else [])} ({fingerprint(schema_paths(used)) if used.fields else 'no known column'})")
    return found


def canonical_rows(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout, by its schema's mapping; turn counts from 0 in a record."""
    # rows of turns name their conversation in the layout itself; any other record's id stands beside its layout
    turns = {"role", "turn"} <= set(table.columns)
    layout = layout_of(T.StructType([f for f in table.schema.fields if turns or f.name != conv_id]))
    key = F.col(conv_id).cast("long").alias("conv_id")
    if "one" in layout:
        role, text = layout["one"]
        rows = table.select(key, F.col("turn").cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    elif "each" in layout:
        items, role, text = layout["each"]
        rows = table.select(key, F.posexplode(items).alias("turn", "_item")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"_item.{role}").cast("string").alias("role"), F.col(f"_item.{text}").cast("string").alias("text"))
    else:
        named = [F.struct(F.lit(r[1:]) if r[0] == "=" else F.col(r).cast("string"), F.col(t).cast("string"), F.lit(t == "input")) for r, t in layout["turns"]]
        kept = F.filter(F.array(*[x.cast("struct<role:string,text:string,optional:boolean>") for x in named]), lambda x: ~x["optional"] | (F.coalesce(x["text"], F.lit("")) != ""))
        rows = table.select(key, F.posexplode(kept).alias("turn", "_item")).select("conv_id", F.col("turn").cast("long").alias("turn"), "_item.role", "_item.text")
    named_role = F.col("role")
    for said, meant in ROLES.items():
        named_role = F.when(F.col("role") == said, meant).otherwise(named_role)
    return rows.withColumn("role", F.coalesce(named_role, F.lit("unknown")))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The templated turn and the span under the loss mask (start = end: none)."""
    head = f"{HEAD}{escape(role)}: "
    body = escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{END}\n", len(head) if role == LOSS_ROLE else end, end


def read_back(text: str) -> list[tuple[str, str]]:
    """Turns of formatted text; raises ValueError if any of it isn't a turn."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_json(data: str | None) -> dict:
    """formatted, loss spans and layout of one JSON record; formatted is null if no mapping fits."""
    try:
        record = json.loads(data or "null")
    except ValueError:
        record = None
    turns = canonical_turns(record) if isinstance(record, dict) else None
    if turns is None:
        return {"layout": fingerprint(paths(record)), "formatted": None, "loss_spans": []}
    out, spans, at = [], [], 0
    for role, text in turns:
        piece, a, b = format_turn(role, text)
        if role == LOSS_ROLE:
            spans.append([at + a, at + b])
        out.append(piece)
        at += len(piece)
    return {"layout": fingerprint(paths(record)), "formatted": "".join(out), "loss_spans": spans}


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON strings of any known layout: adds layout, formatted and loss_spans to the record column."""
    tune(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [format_json(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g["layout"] for g in got], pa.string()), pa.array([g["formatted"] for g in got], pa.string()), pa.array([g["loss_spans"] for g in got], pa.list_(pa.list_(pa.int64())))], [column, "layout", "formatted", "loss_spans"])

    return records.select(column).mapInArrow(run, f"`{column}` string, layout string, formatted string, loss_spans array<array<bigint>>")


def format_table(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """A table of any known layout as canonical turns (conv_id, turn, role, text) with formatted, loss_start and loss_end.

    A conversation's formatted text is its pieces by turn; pieces are made row by row, so no group is gathered.
    """
    rows = canonical_rows(table, conv_id)
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [format_turn(r["role"], r["text"] or "") for r in b.to_pylist()]
            arrays = [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "formatted", "loss_start", "loss_end"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


class _Digest:
    """Running digests of one conversation, read back from its pieces."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        for role, text in read_back(piece):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        masked = unescape(piece[start:end])
        self.loss += len(masked)
        self.loss_sha.update(masked.encode("utf-8", "replace"))
        self.chars += len(piece)

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted pieces in order."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for conv, piece, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    if state:
                        done.append(state.row(now))
                    now, state = conv, _Digest()
                state.add(piece, start, end)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(state.row(now), fields)], [n for n, _ in fields])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)
