"""Typed table schemas: nine field types, their rules, coercion of records, and inference from samples."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

NAME = re.compile(r"^[a-z][a-z0-9_]{0,63}$")
SEGMENT = re.compile(r"^[a-z0-9][a-z0-9_-]{0,63}$")
TYPES = ("string", "text", "number", "boolean", "timestamp", "json", "vector", "secret", "file")
SHAPES = ("object", "array", "array<string>", "array<number>", "array<boolean>", "array<object>")
RESERVED = {"id", "created_at", "owner", "rowid", "_score", "_embedding"}
MOST_FIELDS, MOST_CONSTRAINTS, MOST_KEYS, MOST_DIM = 100, 32, 8, 4096
TIMESTAMP = re.compile(r"^\d{4}-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:[Zz]|[+-](\d{2}):(\d{2}))?)?$")
NUMBER = T.StructType([T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType())])
FILE = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("size", T.LongType()), T.StructField("media_type", T.StringType()), T.StructField("name", T.StringType())])
STORED = {"string": T.StringType(), "text": T.StringType(), "number": NUMBER, "boolean": T.BooleanType(), "timestamp": T.StringType(), "json": T.StringType(), "vector": T.ArrayType(T.FloatType(), False), "secret": T.BinaryType(), "file": FILE}


class SchemaError(ValueError):
    pass


class CoercionError(ValueError):
    pass


@dataclass
class Field:
    name: str
    type: str
    required: bool = False
    enum: list[str] | None = None
    shape: str | None = None
    default: object = None
    dim: int | None = None
    fulltext: bool = False
    vectorize: bool = False
    max_bytes: int | None = None
    media_types: list[str] | None = None

    def check(self) -> None:
        if not NAME.match(self.name) or self.name in RESERVED:
            raise SchemaError(f"{self.name!r} can't be a field's name")
        if self.type not in TYPES:
            raise SchemaError(f"{self.name}: no type {self.type!r}; there are {', '.join(TYPES)}")
        for given, of in ((self.enum is not None, ("string",)), (self.shape is not None, ("json",)), (self.dim is not None, ("vector",)), (self.fulltext, ("string", "text")), (self.vectorize, ("string", "text")), (self.max_bytes is not None or self.media_types is not None, ("file",))):
            if given and self.type not in of:
                raise SchemaError(f"{self.name}: an annotation needs type {' or '.join(of)}")
        if self.type == "vector" and not (isinstance(self.dim, int) and 1 <= self.dim <= MOST_DIM):
            raise SchemaError(f"{self.name}: dim is 1 to {MOST_DIM}")
        if self.shape is not None and self.shape not in SHAPES:
            raise SchemaError(f"{self.name}: no shape {self.shape!r}")
        if self.enum is not None and (not self.enum or len(set(self.enum)) < len(self.enum)):
            raise SchemaError(f"{self.name}: enum values must be there and distinct")
        if self.default is not None:
            if self.required or self.vectorize or self.type == "secret":
                raise SchemaError(f"{self.name}: a default isn't possible here")
            if not (self.type == "timestamp" and self.default == "now()"):
                coerce(self, self.default)


@dataclass
class Constraint:
    name: str
    kind: str  # unique or foreign_key
    fields: list[str]
    table: str | None = None
    where: str | None = None


@dataclass
class TableSchema:
    fields: list[Field]
    version: int = 1
    row_access: str = "all"  # or own
    constraints: list[Constraint] = field(default_factory=list)
    relation: dict | None = None  # source, target, type

    def check(self) -> None:
        names = [f.name for f in self.fields]
        if not names or len(names) > MOST_FIELDS or len(set(names)) < len(names):
            raise SchemaError(f"1 to {MOST_FIELDS} fields with distinct names are needed")
        for f in self.fields:
            f.check()
        if sum(f.vectorize for f in self.fields) > 1:
            raise SchemaError("one field can be vectorized at most")
        if len(self.constraints) > MOST_CONSTRAINTS:
            raise SchemaError(f"at most {MOST_CONSTRAINTS} constraints")
        for c in self.constraints:
            if c.kind not in ("unique", "foreign_key") or not 1 <= len(c.fields) <= MOST_KEYS or not set(c.fields) <= set(names):
                raise SchemaError(f"constraint {c.name!r} is malformed")
            if c.kind == "foreign_key" and (not c.table or len(c.fields) != 1):
                raise SchemaError(f"constraint {c.name!r} needs a table and one field")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field {name!r}")

    def stored(self) -> T.StructType:
        base = [T.StructField("id", T.LongType(), False), T.StructField("created_at", T.StringType(), False)]
        return T.StructType(base + [T.StructField("owner", T.StringType())] * (self.row_access == "own") + [T.StructField(f.name, STORED[f.type]) for f in self.fields])

    def numbers(self) -> list[str]:
        return [f.name for f in self.fields if f.type == "number"]

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, x: Mapping) -> TableSchema:
        return cls([Field(**f) for f in x["fields"]], x["version"], x["row_access"], [Constraint(**c) for c in x["constraints"]], x["relation"])


def coerce(f: Field, x):
    """A record's value as it is stored. Raises CoercionError."""
    if x is None:
        return None
    kind = f.type
    if kind in ("string", "text"):
        if not isinstance(x, str) or "\0" in x:
            raise CoercionError(f"{f.name}: a text without NUL is needed")
        if f.enum is not None and x not in f.enum:
            raise CoercionError(f"{f.name}: {x!r} isn't one of {', '.join(f.enum)}")
        return x
    if kind == "number":
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise CoercionError(f"{f.name}: a number is needed")
        if isinstance(x, float):
            if not math.isfinite(x):
                raise CoercionError(f"{f.name}: a finite number is needed")
            return {"i": None, "r": x}
        if not -(2**63) <= x < 2**63:
            raise CoercionError(f"{f.name}: the integer doesn't fit 64 bits")
        return {"i": x, "r": None}
    if kind == "boolean":
        if not isinstance(x, bool):
            raise CoercionError(f"{f.name}: true or false is needed")
        return x
    if kind == "timestamp":
        m = TIMESTAMP.match(x) if isinstance(x, str) else None
        if not m or not (1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 31 and int(m[3] or 0) < 24 and int(m[4] or 0) < 60 and int(m[5] or 0) < 60 and int(m[6] or 0) < 24 and int(m[7] or 0) < 60):
            raise CoercionError(f"{f.name}: a timestamp is needed")
        return x.replace("t", "T").replace("z", "Z")
    if kind == "json":
        text = json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        if f.shape is not None and not shaped(x, f.shape):
            raise CoercionError(f"{f.name}: the value isn't of shape {f.shape}")
        return text
    if kind == "vector":
        if not isinstance(x, Sequence) or isinstance(x, str) or len(x) != f.dim:
            raise CoercionError(f"{f.name}: {f.dim} components are needed")
        try:
            return [struct.unpack("<f", struct.pack("<f", float(c)))[0] for c in x if not math.isinf(c) and c == c or _refuse(f)]
        except (OverflowError, TypeError, struct.error):
            _refuse(f)
    if kind == "secret":
        if not isinstance(x, (str, bytes)):
            raise CoercionError(f"{f.name}: a text is needed")
        return x.encode() if isinstance(x, str) else x
    if not isinstance(x, Mapping) or not re.fullmatch(r"[0-9a-f]{64}", str(x.get("sha256"))):
        raise CoercionError(f"{f.name}: a file reference is needed")
    if f.max_bytes is not None and x.get("size", 0) > f.max_bytes or f.media_types is not None and x.get("media_type") not in f.media_types:
        raise CoercionError(f"{f.name}: the file breaks the field's limits")
    return {k: x.get(k) for k in ("sha256", "size", "media_type", "name")}


def _refuse(f: Field):
    raise CoercionError(f"{f.name}: components must be finite in 32 bits")


def shaped(x, shape: str) -> bool:
    if shape == "object":
        return isinstance(x, dict)
    if not isinstance(x, list):
        return False
    of = {"array<string>": lambda v: isinstance(v, str), "array<number>": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "array<boolean>": lambda v: isinstance(v, bool), "array<object>": lambda v: isinstance(v, dict)}
    return shape == "array" or all(map(of[shape], x))


def decoded(kind: str, x, reveal: bool = False):
    """A stored value as records give it back; secrets are masked unless revealed."""
    if x is None:
        return None
    if kind == "number":
        return x["i"] if x["i"] is not None else x["r"]
    if kind == "json":
        return json.loads(x)
    if kind == "secret":
        return bytes(x).decode() if reveal else "********"
    if kind == "file":
        return {k: x[k] for k in ("sha256", "size", "media_type", "name")}
    return list(x) if kind == "vector" else x


def infer_schema(samples: Sequence[Mapping]) -> tuple[TableSchema, list[str]]:
    """A schema for 1 to 50 sample records, and what was unclear."""
    if not 1 <= len(samples) <= 50:
        raise SchemaError("1 to 50 samples are needed")
    values: dict[str, list] = {}
    said: list[str] = []
    for record in samples:
        for raw, v in record.items():
            name = re.sub(r"[^a-z0-9_]+", "_", raw.lower()).strip("_")[:64] or "field"
            name = f"f_{name}" if not NAME.match(name) or name in RESERVED else name
            if name != raw:
                said.append(f"{raw!r} is called {name!r}")
            values.setdefault(name, []).append(v)
    fields = []
    for name, all_of in values.items():
        there = [v for v in all_of if v is not None]
        kinds = {"boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "json" for v in there}
        if len(kinds) != 1:
            kind = "json" if kinds else "string"
            said.append(f"{name!r} has {'several kinds of values' if kinds else 'only nulls'}")
        else:
            kind = kinds.pop()
        if kind == "string" and there and all(TIMESTAMP.match(v) for v in there):
            kind = "timestamp"
        long = kind == "string" and bool(there) and all(len(v) > 200 or "\n" in v for v in there)
        fields.append(Field(name, "text" if long else kind, fulltext=long))
    schema = TableSchema(fields)
    schema.check()
    return schema, list(dict.fromkeys(said))
