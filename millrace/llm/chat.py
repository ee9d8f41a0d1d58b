"""Chat formatting by schema fingerprints.

A record's nested field paths (array places written as [], with the kind of each leaf) are hashed. The fingerprint selects a
declarative mapping, which says where the turns are and which fields hold role and text, so that prompt and completion,
instruction and output, message lists of several makes, and tables with a row for each turn all become turns (role, text). A schema with more fields than a layout has
is read by the layout of which it has all fields (the one with most fields, ties by the order of LAYOUTS); that choice is made once for each fingerprint. A template then marks
the turns. Control strings inside texts and roles are escaped with a backslash, which read_back() undoes.

Output is one row for each turn, a segment of the conversation's formatted text with the place of the text to be trained on, so a
conversation of any length streams through a task. Null texts and roles are empty. Turns are taken in order of their number (null first), ties
by role and text; repeated rows are turns of their own. An empty table gives no segments. Records that no mapping fits give one segment without
text whose `layout` is null; a table that no mapping fits is refused. Other columns of a table are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, tidy

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
CONTROL = re.compile(r"\\|###|</turn>")
HEADER = re.compile(r'### (?:(User|Assistant|System|Tool)|"((?:[^"\\]|\\.)*)"): ', re.S)
NAMED = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
SEGMENT = "conv_id long, turn long, layout string, segment string, loss_from long, loss_to long"

#: Declarative mappings: `each` (a list of turns with the fields of role and text), `fixed` (role, field) pairs in order, or `row` (a turn for each row, with the fields of conversation and order). `roles` are names to be changed.
MAPPINGS = {
    "turns": {"row": "conv_id", "order": "turn", "role": "role", "text": "text"},
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "parts": {"each": "messages", "role": "role", "text": "content", "parts": "text"},
    "sharegpt": {"each": "conversations", "role": "from", "text": "value", "roles": ROLES},
    "prompt": {"fixed": [("user", "prompt"), ("assistant", "completion")]},
    "response": {"fixed": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"fixed": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")], "join": "\n\n"},
}
LAYOUTS = {
    "turns": ["conv_id:n turn:n role:s text:s"],
    "messages": ["messages[].role:s messages[].content:s"],
    "parts": ["messages[].role:s messages[].content[].type:s messages[].content[].text:s"],
    "sharegpt": ["conversations[].from:s conversations[].value:s"],
    "prompt": ["prompt:s completion:s"],
    "response": ["prompt:s response:s"],
    "instruction": ["instruction:s output:s", "instruction:s input:s output:s", "instruction:s input:s output:s system:s", "instruction:s output:s system:s"],
}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record with the kind of their leaves; nulls count as texts."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return {f"{at}:{'s' if value is None or isinstance(value, str) else 'b' if isinstance(value, bool) else 'n'}"}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same of a table's schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {f"{at}:{'n' if isinstance(kind, T.NumericType) else 'b' if isinstance(kind, T.BooleanType) else 's'}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(set(x.split())): name for name, all_of in LAYOUTS.items() for x in all_of}


def _wider(found: set[str]) -> str | None:
    """The layout with most fields of those whose fields are all there."""
    fitting = [(len(own), -k, name) for k, (name, x) in enumerate((name, x) for name, all_of in LAYOUTS.items() for x in all_of) if (own := set(x.split())) <= found]
    return max(fitting)[2] if fitting else None


_SEEN: dict[str, str | None] = {}


def layout_of(found: set[str]) -> str | None:
    """The layout that a schema's fingerprint selects."""
    key = fingerprint(found)
    if key in REGISTRY:
        return REGISTRY[key]
    if key not in _SEEN:
        if len(_SEEN) >= 10_000:  # schemas of a data set are few; a worker's memory stays bounded where they aren't
            _SEEN.clear()
        _SEEN[key] = _wider(found)
    return _SEEN[key]


def turns_of(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name and the canonical turns; (None, []) where no mapping fits."""
    layout = layout_of(paths(record))
    m = MAPPINGS.get(layout)
    if m is None or "row" in m:
        return (None, []) if m is None else (layout, [(record[m["role"]] or "", record[m["text"]] or "")])
    out = []
    if "each" in m:
        for x in record[m["each"]]:
            text, role = x.get(m["text"]), x.get(m["role"]) or ""
            if "parts" in m:
                text = "".join(y.get(m["parts"]) or "" for y in text or [])
            out.append((m.get("roles", {}).get(role, role), text or ""))
        return layout, out
    for role, field in m["fixed"]:
        text = record.get(field)
        if field in record and not (role in ("system", "user") and not text and len(m["fixed"]) > 2):
            if out and out[-1][0] == role:
                out[-1] = (role, out[-1][1] + m["join"] + (text or ""))
            else:
                out.append((role, text or ""))
    return layout, out


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text that is trained on (empty unless the assistant's)."""
    header = f"### {NAMED.get(role) or json.dumps(role, ensure_ascii=False)}: "
    body = escaped(text)
    return f"{header}{body}</turn>\n", len(header), len(header) + (len(body) if role == "assistant" else 0)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, or of one segment."""
    out, at = [], 0
    token = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        end = next(m for m in token.finditer(formatted, head.end()) if m[0] == "</turn>\n")
        role = head[1].lower() if head[1] else json.loads(f'"{head[2]}"')
        out.append((role, unescaped(formatted[head.end() : end.start()])))
        at = end.end()
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of a table with a row for each turn, in the order of their conversations. The fingerprint of its schema selects the mapping, which names the columns; roles stay as they are.

    The rows of a conversation are sorted in a task and streamed, so its length isn't bound by memory. Rows without a conversation's id are one conversation.
    """
    layout = layout_of(schema_paths(turns.schema))
    m = MAPPINGS.get(layout, {})
    if "row" not in m:
        raise ValueError("no mapping fits this table's columns")
    conv, order, role, text = (F.col(m[k]) for k in ("row", "order", "role", "text"))
    by = turns.select(conv.cast("long").alias("conv_id"), order.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    by = by.repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in by.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _batch([(conv, turn, layout, *segment(role or "", text or "")) for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns])])

    return by.mapInArrow(tidy(run), SEGMENT)


def format_records(records: DataFrame, id_column: str = "conv_id", record_column: str = "record") -> DataFrame:
    """Segments of records given as JSON text, in any of the layouts. Text that isn't a JSON object fits no mapping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = []
            for conv, text in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                layout, got = turns_of(record) if isinstance(record, dict) else (None, [])
                rows += [(conv, k, layout, *segment(r, t)) for k, (r, t) in enumerate(got)] or [(conv, 0, layout, "", 0, 0)]
            yield _batch(rows)

    return records.select(F.col(id_column).cast("long"), record_column).mapInArrow(tidy(run), SEGMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from the segments, a row for each conversation. Segments must lie together and in order, as format_turns gives them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches):
                yield from zip(*[batch.column(k).to_pylist() for k in (0, 3, 4, 5)])

        out: list[tuple] = []
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, start, end in own:
                size += len(text)
                for role, said in read_back(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                trained = unescaped(text[start:end])
                chars += len(trained)
                loss.update(trained.encode())
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) == 1000:
                yield _rows(out, schema)
                out = []
        yield _rows(out, schema)

    return segments.mapInArrow(tidy(run), schema)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if t == "long" else pa.string()) for k, t in enumerate(kinds)], names=list(names))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations")
    return digests(format_turns(turns.unionByName(extra, allowMissingColumns=True)))
