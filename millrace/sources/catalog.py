"""Namespaces of typed tables on any file system that Spark reads.

A namespace is a folder. Its state is a manifest, published as a new file manifests/N.json that may not exist yet, so that two writers can't publish the same version and readers always see one
whole commit: for each table its schema, the data folders that are live, the next id. A commit writes its Parquet folders first, then the manifest, so that a crash leaves
nothing but unreferenced folders (vacuum removes them). Inserts add a folder; updates and deletes rewrite the table (copy on write).
Every commit with rows appends change records under changes/, which are read as a table or as a stream; the manifest carries their sequence.

Records of one call are at most 1000, so they pass through the driver; tables never do. append() takes a DataFrame of any size; ids and change records of sets of rows are made by the
executors. A change folder is announced to streams by a marker file once the manifest that names it is published, so subscribers see committed changes only.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fulltext, graph, vectors
from ..plans import sql
from ..plans.filters import columns_of, compiled
from .schema import MOST_KEYS, SEGMENT, STORED, Constraint, Field, SchemaError, TableSchema, coerce, decoded, shaped

MOST_RECORDS, MOST_WRITES, MOST_DELETED = 1000, 100, 1000
CHANGE = "seq long, table string, row_id long, kind string, owner string, commit_id string, ns_gen string, drop_gen long, at string"


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


@dataclass(frozen=True)
class Scope:
    """Whose rows are seen; None sees all."""

    owner: str | None = None


class Files:
    """The few file operations of manifests, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        draft = self.path(f"drafts/{uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            if self.fs.getScheme() == "file":  # a link fails where the name is taken, in one step; a local rename would replace it
                there, here = (self.jvm.java.io.File(self.path(p).toUri().getPath()).toPath() for p in (f"drafts/{draft.getName()}", name))
                try:
                    self.jvm.java.nio.file.Files.createLink(here, there)
                except Py4JJavaError as e:
                    if "FileAlreadyExistsException" in str(e.java_exception):
                        return False
                    raise
                return True
            # HDFS and its like refuse a rename to a name that is taken, in one step
            return not self.fs.exists(self.path(name)) and self.fs.rename(draft, self.path(name))
        finally:
            self.fs.delete(draft, False)

    def age(self, name: str) -> float:
        """Seconds since a file or folder changed."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{datetime.now(UTC).microsecond // 1000:03d}Z"


class Catalog:
    """All namespaces under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root.rstrip("/"))

    def create_namespace(self, path: str) -> Namespace:
        parts = path.split("/")
        if not 1 <= len(parts) <= 3 or not all(SEGMENT.match(p) for p in parts):
            raise SchemaError(f"{path!r} isn't a namespace: one to three names with / between")
        ns = Namespace(self.spark, f"{self.root}/{self._folder(path)}", path)
        if not ns.files.publish("manifests/0000000001.json", json.dumps({"version": 1, "ns_gen": uuid4().hex, "tables": {}, "next_seq": 1, "drops": 0, "keys": {}, "migrations": []})):
            raise Conflict(f"namespace {path!r} exists")
        return ns

    def _folder(self, path: str) -> str:
        return path.replace("/", "/.sub/")

    def namespace(self, path: str) -> Namespace:
        ns = Namespace(self.spark, f"{self.root}/{self._folder(path)}", path)
        if not ns.files.names("manifests"):
            raise NotFound(f"no namespace {path!r}")
        return ns

    def list_namespaces(self, prefix: str = "") -> list[str]:
        out: list[str] = []

        def look(folder: str, path: str) -> None:
            for name in self.files.names(folder):
                here = f"{folder}/{name}" if folder else name
                if self.files.names(f"{here}/manifests"):
                    out.append(f"{path}/{name}" if path else name)
                if SEGMENT.match(name):
                    look(f"{here}/.sub", f"{path}/{name}" if path else name)

        look("", "")
        return sorted(p for p in out if p.startswith(prefix))

    def drop_namespace(self, path: str, confirm: str) -> None:
        self.namespace(path)
        if confirm != path:
            raise Conflict("confirm must repeat the namespace's path")
        if any(p.startswith(f"{path}/") for p in self.list_namespaces()):
            raise Conflict(f"{path!r} has namespaces below it")
        self.files.delete(self._folder(path))

    @staticmethod
    def capabilities() -> dict:
        return {"query_dialect": "spark", "vector_search": "exact", "fulltext": "bm25", "change_feed": True, "graph": True, "max_records": MOST_RECORDS, "max_writes": MOST_WRITES}


class Transaction:
    """A manifest being changed; tables as they are inside it, so that later writes see earlier ones."""

    def __init__(self, ns: Namespace):
        self.ns, self.state = ns, json.loads(json.dumps(ns.manifest()))
        self.commit_id, self.at = uuid4().hex, now()
        self.changes: list[tuple] = []
        self.noted: list[DataFrame] = []  # change records that the executors make
        self.firsts: list[int] = []
        self.touched: set[str] = set()

    def table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise NotFound(f"no table {name!r} in {self.ns.path!r}")
        return self.state["tables"][name]

    def schema(self, name: str) -> TableSchema:
        return TableSchema.from_json(self.table(name)["schema"])

    def rows(self, name: str, scope: Scope = Scope()) -> DataFrame:
        df = self.ns._read(self.table(name))
        return df.where(F.col("owner") == scope.owner) if scope.owner is not None and self.schema(name).row_access == "own" else df

    def append(self, name: str, rows: list[dict], scope: Scope) -> list[int]:
        if not rows:
            return []
        t, schema = self.table(name), self.schema(name)
        ids = []
        for r in rows:
            r.setdefault("id", t["next_id"])
            t["next_id"] = max(t["next_id"], r["id"] + 1)
            r.setdefault("created_at", self.at)
            r.setdefault("owner", scope.owner)
            ids.append(r["id"])
        folder = f"data/{name}/{uuid4().hex}"
        kinds = schema.stored()
        self.ns.spark.createDataFrame([tuple(r.get(f.name) for f in kinds) for r in rows], kinds).coalesce(1).write.parquet(f"{self.ns.root}/{folder}")
        t["folders"].append(folder)
        t["rows"] += len(rows)
        self._note(name, [(i, r["owner"]) for i, r in zip(ids, rows)], "insert")
        return ids

    def replace(self, name: str, df: DataFrame, rows: int) -> None:
        t = self.table(name)
        folder = f"data/{name}/{uuid4().hex}"
        df.write.parquet(f"{self.ns.root}/{folder}")
        t["folders"], t["rows"] = [folder], rows

    def _note(self, name: str, rows: Sequence[tuple], kind: str) -> None:
        self.touched.add(name)
        for i, owner in rows:
            self.changes.append((self.state["next_seq"], name, i, kind, owner, self.commit_id, self.state["ns_gen"], self.table(name)["drop_gen"], self.at))
            self.state["next_seq"] += 1

    def numbered(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The rows, stored, with a column `__n` that counts them from 0 in their order, and how many there are. Only a number for each task comes to the driver."""
        folder = f"{self.ns.root}/drafts/{uuid4().hex}"
        df.withColumn("__n", F.monotonically_increasing_id()).write.parquet(folder)
        stored, task, place = self.ns.spark.read.parquet(folder), F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
        held = {r[0]: r[1] for r in stored.groupBy(task).agg(F.max(place) + 1).collect()}
        before, total = [], 0
        for k in range(max(held, default=-1) + 1):
            before.append(total)
            total += held.get(k, 0)
        first = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (task + 1).cast("int")) if before else F.lit(0).cast("long")
        return stored.withColumn("__n", first + place), total

    def note_set(self, name: str, rows: DataFrame, kind: str) -> int:
        """Change records of a set of rows (id, owner) in order of id; gives their number."""
        stored, n = self.numbered(rows.select("id", "owner").orderBy("id"))
        t = self.table(name)
        lits = {"table": name, "kind": kind, "commit_id": self.commit_id, "ns_gen": self.state["ns_gen"], "at": self.at}
        made = stored.select((F.col("__n") + self.state["next_seq"]).alias("seq"), F.lit(lits["table"]).alias("table"), F.col("id").alias("row_id"), F.lit(kind).alias("kind"), "owner", F.lit(self.commit_id).alias("commit_id"), F.lit(lits["ns_gen"]).alias("ns_gen"), F.lit(t["drop_gen"]).cast("long").alias("drop_gen"), F.lit(self.at).alias("at"))
        if n:
            self.touched.add(name)
            self.noted.append(made)
            self.firsts.append(self.state["next_seq"])
            self.state["next_seq"] += n
        return n

    def append_set(self, name: str, df: DataFrame, scope: Scope) -> int:
        """Rows of a DataFrame, in their order, with the ids that follow; gives their number. Columns are fields by name; those that are missing get their default or null."""
        t, schema = self.table(name), self.schema(name)
        if unknown := set(df.columns) - {f.name for f in schema.fields}:
            raise SchemaError(f"no field {sorted(unknown)[0]!r} in {name!r}")
        stored, n = self.numbered(df.select(*[taken_in(f, df.schema[f.name].dataType if f.name in df.columns else None, self.at).alias(f.name) for f in schema.fields]))
        bad = stored.where(F.lit(False) if not schema.fields else F.greatest(*[_breaks(f).cast("int") for f in schema.fields], F.lit(0)) > 0).limit(1).collect()
        if bad:
            raise ValueError(f"a row of {name!r} lacks a required field or breaks an enumeration or dimension: {bad[0].asDict(recursive=True)}")
        whole = stored.select((F.col("__n") + t["next_id"]).alias("id"), F.lit(self.at).alias("created_at"), *([F.lit(scope.owner).cast("string").alias("owner")] * (schema.row_access == "own")), *[f.name for f in schema.fields])
        folder = f"data/{name}/{uuid4().hex}"
        whole.write.parquet(f"{self.ns.root}/{folder}")
        if n:
            t["folders"].append(folder)
            t["rows"] += n
            self.note_set(name, whole.select("id", F.lit(scope.owner).cast("string").alias("owner")), "insert")
            t["next_id"] += n
        return n

    def check(self) -> None:
        """Declared constraints of all touched tables, and those that refer to them, on the final state."""
        for name, t in self.state["tables"].items():
            schema = TableSchema.from_json(t["schema"])
            for c in schema.constraints:
                if name in self.touched or c.table in self.touched:
                    self.verify(name, schema, c)

    def verify(self, name: str, schema: TableSchema, c: Constraint) -> None:
        df = self.ns._read(self.table(name))
        if c.where:
            df = df.where(compiled(c.where, columns_of(df, schema.numbers())))
        df = df.where(F.concat(*[F.col(f).isNotNull().cast("string") for f in c.fields]).contains("false") == F.lit(False))
        keys = [_key(schema, f) for f in c.fields]
        if c.kind == "unique":
            keys += [F.col("owner")] * (schema.row_access == "own")
            if df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).count().where("count > 1").limit(1).count():
                raise Conflict(f"constraint {c.name!r}: two rows of {name!r} have the same {', '.join(c.fields)}")
        else:
            parents = self.ns._read(self.table(c.table)).select(F.col("id").alias("k"))
            if df.select(F.col(c.fields[0])["i"].alias("k")).join(parents, "k", "left_anti").limit(1).count():
                raise Conflict(f"constraint {c.name!r}: {c.fields[0]} of {name!r} names no row of {c.table!r}")

    def commit(self) -> None:
        self.check()
        if self.changes or self.noted:
            first = min([c[0] for c in self.changes[:1]] + self.firsts)
            folder = f"changes/{first:012d}-{self.commit_id}"
            if self.changes:
                self.ns.spark.createDataFrame(self.changes, CHANGE).coalesce(1).write.parquet(f"{self.ns.root}/{folder}")
            for made in self.noted:
                made.write.mode("append").parquet(f"{self.ns.root}/{folder}")
            self.state.setdefault("change_folders", []).append(folder)
        self.state["version"] += 1
        if not self.ns.files.publish(f"manifests/{self.state['version']:010d}.json", json.dumps(self.state)):
            raise Conflict("another commit came first; try again")
        if self.changes or self.noted:
            self.ns.announce(self.state["change_folders"][-1:])


def taken_in(f: Field, kind: T.DataType | None, at: str) -> Column:
    """A DataFrame's column as the field stores it."""
    if kind is None:
        default = None if f.default is None else coerce(f, at if f.default == "now()" else f.default)
        return _literal_of(STORED[f.type], default)
    c = F.col(f.name)
    if f.type == "number":
        if isinstance(kind, T.IntegralType):
            return F.when(c.isNotNull(), F.struct(c.cast("long").alias("i"), F.lit(None).cast("double").alias("r")))
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return F.when(c.isNotNull(), F.struct(F.lit(None).cast("long").alias("i"), c.cast("double").alias("r")))
    elif f.type == "timestamp" and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif f.type == "vector" and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.transform(c, lambda v: F.coalesce(v.cast("float"), F.lit(float("nan")).cast("float")))  # null components are refused with those that aren't numbers
    elif f.type in ("string", "text", "boolean", "json") and kind == STORED[f.type]:
        return c
    raise SchemaError(f"a column of {kind.simpleString()} can't fill the {f.type} field {f.name!r}")


def _breaks(f: Field) -> Column:
    c, out = F.col(f.name), F.lit(False)
    if f.required:
        out = out | c.isNull()
    if f.enum is not None:
        out = out | (c.isNotNull() & ~c.isin(*f.enum))
    if f.type == "vector":
        out = out | (c.isNotNull() & ((F.size(c) != f.dim) | F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))))
    if f.type in ("string", "text"):
        out = out | F.coalesce(c.contains("\0"), F.lit(False))
    if f.type == "json":
        out = out | (c.isNotNull() & F.try_parse_json(c).isNull())
    return out


def _key(schema: TableSchema, name: str) -> Column:
    """A field's value for comparing keys: numbers as exact decimals where they are integers."""
    if schema.field(name).type == "number":
        c = F.col(name)
        whole = F.when(c["r"] == F.floor(c["r"]), F.floor(c["r"]).cast("string"))
        return F.coalesce(c["i"].cast("string"), whole, c["r"].cast("string"))
    return F.col(name).cast("string")


def _plain_key(x) -> str | None:
    if isinstance(x, dict):
        x = x["i"] if x["i"] is not None else int(x["r"]) if x["r"] == int(x["r"]) else x["r"]
    return None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


class Namespace:
    def __init__(self, spark: SparkSession, root: str, path: str):
        self.spark, self.root, self.path, self.files = spark, root, path, Files(spark, root)

    def manifest(self) -> dict:
        names = self.files.names("manifests")
        if not names:
            raise NotFound(f"no namespace {self.path!r}")
        return json.loads(self.files.read(f"manifests/{names[-1]}"))

    def _read(self, table: Mapping) -> DataFrame:
        kinds = TableSchema.from_json(table["schema"]).stored()
        if not table["folders"]:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.root}/{f}" for f in table["folders"]])

    # tables

    def create_table(self, name: str, schema: TableSchema) -> None:
        schema.check()
        if not SEGMENT.match(name) or "-" in name:
            raise SchemaError(f"{name!r} can't be a table's name")
        tx = Transaction(self)
        if name in tx.state["tables"]:
            raise Conflict(f"table {name!r} exists")
        for c in schema.constraints:
            if c.kind == "foreign_key" and c.table != name:
                tx.table(c.table)
            if c.where:
                df = self.spark.createDataFrame([], schema.stored())
                compiled(c.where, columns_of(df, schema.numbers()))
        tx.state["drops"] += 1
        tx.state["tables"][name] = {"schema": schema.to_json(), "folders": [], "next_id": 1, "rows": 0, "drop_gen": tx.state["drops"]}
        tx.commit()

    def describe_table(self, name: str) -> dict:
        t = Transaction(self).table(name)
        return {"schema": t["schema"], "rows": t["rows"]}

    def list_tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def drop_table(self, name: str, confirm: str) -> None:
        tx = Transaction(self)
        tx.table(name)
        if confirm != name:
            raise Conflict("confirm must repeat the table's name")
        for other, t in tx.state["tables"].items():
            if other != name and any(c["table"] == name for c in t["schema"]["constraints"]):
                raise Conflict(f"{other!r} refers to {name!r}")
        del tx.state["tables"][name]
        tx.commit()

    def announce(self, folders: Sequence[str] | None = None) -> None:
        """Marker files for the manifest's change folders, which streams read. A commit that died before its marker is announced by the next caller without folders."""
        there = None if folders is not None else set(self.files.names("feed"))
        for folder in folders if folders is not None else self.manifest().get("change_folders", []):
            name = folder.partition("/")[2]
            if there is None or name not in there:
                self.files.publish(f"feed/{name}", f"{folder}\n")

    def append(self, table: str, rows: DataFrame, scope: Scope = Scope()) -> int:
        """A DataFrame's rows as one commit, whatever their number; gives it. Constraints are checked on the final state."""
        tx = Transaction(self)
        n = tx.append_set(table, rows, scope)
        tx.commit()
        return n

    def vacuum(self, grace: float = 3600.0) -> int:
        """Deletes data and draft folders that no table has; compacts tables of many folders first. What is younger than `grace` seconds stays, since a writer may be about to publish it or a reader have its manifest."""
        tx = Transaction(self)
        for name, t in tx.state["tables"].items():
            if len(t["folders"]) > 16:
                tx.replace(name, tx.rows(name), t["rows"])
        tx.commit()
        live = {f for t in tx.state["tables"].values() for f in t["folders"]}
        gone = 0
        for table in self.files.names("data"):
            for folder in self.files.names(f"data/{table}"):
                if f"data/{table}/{folder}" not in live and self.files.age(f"data/{table}/{folder}") >= grace:
                    self.files.delete(f"data/{table}/{folder}")
                    gone += 1
        for draft in self.files.names("drafts"):
            if self.files.age(f"drafts/{draft}") >= grace:
                self.files.delete(f"drafts/{draft}")
        return gone

    # reads

    def table(self, name: str, scope: Scope = Scope()) -> DataFrame:
        """The stored rows as they are now; later commits don't change what this reads."""
        return Transaction(self).rows(name, scope)

    def view(self, name: str, scope: Scope = Scope()) -> DataFrame:
        """Rows for SQL: numbers as doubles, secrets masked."""
        schema = Transaction(self).schema(name)
        df, out = self.table(name, scope), [F.col("id"), F.col("created_at")]
        for f in schema.fields:
            c = F.col(f.name)
            out.append({"number": F.coalesce(c["i"].cast("double"), c["r"]), "secret": F.when(c.isNotNull(), F.lit("********"))}.get(f.type, c).alias(f.name))
        return df.select(out)

    def query(self, text: str, args: Sequence = (), scope: Scope = Scope()) -> DataFrame:
        return sql.statement(self.spark, text, {t: self.view(t, scope) for t in self.list_tables()}, args)

    def records(self, name: str, df: DataFrame, reveal: bool = False) -> list[dict]:
        schema = Transaction(self).schema(name)
        kinds = {f.name: f.type for f in schema.fields}
        return [{k: decoded(kinds[k], v, reveal) if k in kinds else v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]

    def read_rows(self, name: str, ids: Sequence[int] | None = None, after_id: int | None = None, limit: int = 100, scope: Scope = Scope(), reveal: bool = False) -> tuple[list[dict], bool]:
        """Rows by id (missing ones are left out), or the page after an id; in order of id. The flag says whether more follow."""
        df = self.table(name, scope)
        if ids is not None:
            if len(ids) > MOST_RECORDS:
                raise ValueError(f"at most {MOST_RECORDS} ids")
            return self.records(name, df.where(F.col("id").isin(*set(ids))).orderBy("id"), reveal), False
        if not 1 <= limit <= MOST_RECORDS:
            raise ValueError(f"limit is 1 to {MOST_RECORDS}")
        got = self.records(name, df.where(F.col("id") > (after_id or 0)).orderBy("id").limit(limit + 1), reveal)
        return got[:limit], len(got) > limit

    def predicate(self, name: str, text: str | None, args: Sequence = ()) -> Column | None:
        tx = Transaction(self)
        return None if text is None else compiled(text, columns_of(tx.rows(name), tx.schema(name).numbers()), args)

    def search_fulltext(self, name: str, text: str, filter: str | None = None, args: Sequence = (), limit: int = 10, offset: int = 0, scope: Scope = Scope()) -> DataFrame:
        fields = [f.name for f in Transaction(self).schema(name).fields if f.fulltext]
        if not fields:
            raise SchemaError(f"no field of {name!r} has full-text search")
        allowed = self.predicate(name, filter, args)
        if scope.owner is not None and Transaction(self).schema(name).row_access == "own":
            own = F.col("owner") == scope.owner
            allowed = own if allowed is None else own & allowed
        return fulltext.best(fulltext.search(self.table(name), text, fields, allowed=allowed), limit, offset)

    def search_vector(self, name: str, vector: Sequence[float], column: str | None = None, filter: str | None = None, args: Sequence = (), min_score: float | None = None, limit: int = 10, offset: int = 0, scope: Scope = Scope()) -> DataFrame:
        schema = Transaction(self).schema(name)
        column = column or next((f.name for f in schema.fields if f.type == "vector"), None)
        if column is None or schema.field(column).type != "vector":
            raise SchemaError(f"{name!r} has no such vector field")
        if len(vector) != schema.field(column).dim:
            raise vectors.VectorError(f"{schema.field(column).dim} components are needed")
        return vectors.search(self.table(name, scope), column, vector, self.predicate(name, filter, args), min_score, limit, offset)

    def edges(self, scope: Scope = Scope()) -> DataFrame:
        """Edges of all relation tables."""
        out = None
        tx = Transaction(self)
        for name, t in tx.state["tables"].items():
            schema = TableSchema.from_json(t["schema"])
            if schema.relation:
                r = schema.relation
                ends = {c.fields[0]: c.table for c in schema.constraints if c.kind == "foreign_key"}
                rows = tx.rows(name, scope).select("id", F.col(r["source"])["i"].alias("s"), F.col(r["target"])["i"].alias("t"), F.col(r["type"]).alias("k"))
                part = graph.edges_of(rows, name, "id", (ends[r["source"]], "s"), (ends[r["target"]], "t"), "k")
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], graph.EDGE)

    def relate(self, name: str, source: int, target: int, type: str, props: Mapping | None = None, scope: Scope = Scope()) -> int:
        r = Transaction(self).schema(name).relation
        if not r:
            raise SchemaError(f"{name!r} isn't a relation table")
        if set(props or {}) & set(r.values()):
            raise SchemaError("properties can't set the ends or the type")
        return self.insert(name, [{**(props or {}), r["source"]: source, r["target"]: target, r["type"]: type}], scope=scope)[0]

    # writes

    def batch(self, writes: Sequence[Mapping], idempotency_key: str | None = None, scope: Scope = Scope()) -> list:
        """Several writes as one commit; each sees the ones before. A write is {"op", "table", ...} with that method's arguments, and expected_rows where the count must be so."""
        if not 1 <= len(writes) <= MOST_WRITES:
            raise ValueError(f"1 to {MOST_WRITES} writes")
        if sum(len(w.get("records", ())) for w in writes) > MOST_RECORDS:
            raise ValueError(f"at most {MOST_RECORDS} records")
        tx = Transaction(self)
        mark = hashlib.sha256(json.dumps([dict(w) for w in writes], sort_keys=True, default=str).encode()).hexdigest()
        key = None if idempotency_key is None else f"{scope.owner or ''}\0{idempotency_key}"
        if key is not None and key in tx.state["keys"]:
            if tx.state["keys"][key]["mark"] != mark:
                raise Conflict("this idempotency key was used for something else")
            return tx.state["keys"][key]["result"]
        out = []
        for k, w in enumerate(writes):
            w = dict(w)
            op, table, expected = w.pop("op"), w.pop("table"), w.pop("expected_rows", None)
            try:
                done = OPERATIONS[op](tx, table, scope, **w)
            except (ValueError, LookupError) as e:
                raise type(e)(f"writes[{k}]: {e}" if len(writes) > 1 else str(e)) from None
            if expected is not None and (len(done) if isinstance(done, list) else done) != expected:
                raise Conflict(f"writes[{k}]: {len(done) if isinstance(done, list) else done} rows, {expected} were expected")
            out.append(done)
        if key is not None:
            tx.state["keys"][key] = {"mark": mark, "result": out}
        tx.commit()
        return out

    def insert(self, table: str, records: Sequence[Mapping], idempotency_key: str | None = None, scope: Scope = Scope()) -> list[int]:
        return self.batch([{"op": "insert", "table": table, "records": list(records)}], idempotency_key, scope)[0]

    def upsert_by_key(self, table: str, on: Sequence[str], records: Sequence[Mapping], scope: Scope = Scope()) -> list[int]:
        return self.batch([{"op": "upsert_by_key", "table": table, "on": list(on), "records": list(records)}], None, scope)[0]

    def update(self, table: str, filter: str, set: Mapping, args: Sequence = (), scope: Scope = Scope()) -> int:
        return self.batch([{"op": "update", "table": table, "filter": filter, "set": dict(set), "args": list(args)}], None, scope)[0]

    def upsert(self, table: str, filter: str, set: Mapping, args: Sequence = (), scope: Scope = Scope()) -> int:
        return self.batch([{"op": "upsert", "table": table, "filter": filter, "set": dict(set), "args": list(args)}], None, scope)[0]

    def delete(self, table: str, filter: str, args: Sequence = (), dry_run: bool = False, confirm: bool = False, scope: Scope = Scope()) -> int:
        if dry_run:
            return Transaction(self).rows(table, scope).where(self.predicate(table, filter, args)).count()
        return self.batch([{"op": "delete", "table": table, "filter": filter, "args": list(args), "confirm": confirm}], None, scope)[0]

    def import_records(self, table: str, records: Sequence[Mapping], scope: Scope = Scope()) -> dict:
        """Records that bring id and created_at: identical ones are skipped, others with a known id conflict."""
        tx = Transaction(self)
        schema = tx.schema(table)
        rows = []
        for r in records:
            if not isinstance(r.get("id"), int) or r["id"] < 1 or not isinstance(r.get("created_at"), str):
                raise ValueError("imported records need id and created_at")
            rows.append(_record(schema, {k: v for k, v in r.items() if k not in ("id", "created_at")}, tx.at) | {"id": r["id"], "created_at": r["created_at"]})
        if len({r["id"] for r in rows}) < len(rows):
            raise Conflict("an id comes twice")
        known = {r["id"]: r for r in (x.asDict(recursive=True) for x in tx.rows(table).where(F.col("id").isin(*[r["id"] for r in rows])).collect())}
        fresh = []
        for r in rows:
            if r["id"] not in known:
                fresh.append(r)
            elif any(known[r["id"]][f.name] != r.get(f.name) for f in schema.fields) or known[r["id"]]["created_at"] != r["created_at"]:
                raise Conflict(f"row {r['id']} is there with other values")
        tx.append(table, fresh, scope)
        tx.commit()
        return {"inserted": len(fresh), "skipped": len(rows) - len(fresh)}

    # migrations

    def migrate(self, table: str, changes: Sequence[Mapping], expected_version: int | None = None, dry_run: bool = False) -> dict:
        """Schema changes in order, as one commit. Dropping and renaming need the version that they were planned for."""
        tx = Transaction(self)
        schema = tx.schema(table)
        if expected_version is not None and expected_version != schema.version:
            raise Conflict(f"the schema's version is {schema.version}")
        if expected_version is None and any(c["op"] in ("rename_field", "drop_field") for c in changes):
            raise Conflict("expected_version is needed for this change")
        df, rewrite, plan = tx.rows(table), False, []
        for c in changes:
            schema, df, again = _migrated(schema, df, c)
            rewrite |= again
            plan.append(c["op"])
            tx.table(table)["schema"] = schema.to_json()
            if c["op"] == "add_constraint":
                tx.verify(table, schema, schema.constraints[-1])
        schema = replace(schema, version=schema.version + 1)
        schema.check()
        if not dry_run:
            tx.table(table)["schema"] = schema.to_json()
            if rewrite:
                tx.replace(table, df.select([f.name for f in schema.stored()]), tx.table(table)["rows"])
            tx.state["migrations"].append({"table": table, "version": schema.version, "changes": [dict(c) for c in changes], "at": tx.at})
            tx.commit()
        return {"version": schema.version, "plan": plan, "rewrite": rewrite}

    def list_migrations(self, table: str) -> list[dict]:
        return [m for m in self.manifest()["migrations"] if m["table"] == table]


def _record(schema: TableSchema, record: Mapping, at: str, partial: bool = False) -> dict:
    given = {str(k).lower(): v for k, v in record.items()}
    names = {f.name for f in schema.fields}
    if unknown := sorted(set(given) - names):
        raise ValueError(f"no field {unknown[0]!r}")
    out = {}
    for f in schema.fields:
        if f.name in given:
            out[f.name] = coerce(f, given[f.name])
        elif not partial and f.default is not None:
            out[f.name] = coerce(f, at if f.default == "now()" else f.default)
        if f.required and out.get(f.name) is None and (not partial or f.name in given):
            raise ValueError(f"{f.name} is required")
    return out


def _insert(tx: Transaction, table: str, scope: Scope, records: Sequence[Mapping]) -> list[int]:
    if len(records) > MOST_RECORDS:
        raise ValueError(f"at most {MOST_RECORDS} records")
    return tx.append(table, [_record(tx.schema(table), r, tx.at) for r in records], scope)


def _literal(schema: TableSchema, name: str, value) -> Column:
    return _literal_of(schema.stored()[name].dataType, value)


def _literal_of(kind: T.DataType, value) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, dict):
        return F.struct(*[F.lit(v).cast(kind[k].dataType).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[F.lit(x) for x in value]).cast(kind)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind)


def _rewrite(tx: Transaction, table: str, scope: Scope, where: Column, values: Mapping) -> int:
    """Sets fields where the condition holds (and the scope allows); gives the number of rows."""
    schema, whole = tx.schema(table), tx.rows(table)
    if scope.owner is not None and schema.row_access == "own":
        where = where & (F.col("owner") == scope.owner)
    hit = F.coalesce(where, F.lit(False))
    owner = F.col("owner") if schema.row_access == "own" else F.lit(None).cast("string")
    n = tx.note_set(table, whole.where(hit).select("id", owner.alias("owner")), "update")
    if n:
        changed = whole.withColumn("__hit", hit)
        changed = changed.select(*[F.when(F.col("__hit"), _literal(schema, c, values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in whole.columns])
        tx.replace(table, changed, tx.table(table)["rows"])
    return n


def _update(tx: Transaction, table: str, scope: Scope, filter: str, set: Mapping, args: Sequence = ()) -> int:
    schema = tx.schema(table)
    values = _record(schema, set, tx.at, partial=True)
    if not values:
        raise ValueError("nothing is set")
    return _rewrite(tx, table, scope, compiled(filter, columns_of(tx.rows(table), schema.numbers()), args), values)


def _upsert(tx: Transaction, table: str, scope: Scope, filter: str, set: Mapping, args: Sequence = ()) -> int:
    n = _update(tx, table, scope, filter, set, args)
    return n or len(_insert(tx, table, scope, [set]))


def _delete(tx: Transaction, table: str, scope: Scope, filter: str, args: Sequence = (), confirm: bool = False) -> int:
    schema, whole = tx.schema(table), tx.rows(table)
    where = compiled(filter, columns_of(whole, schema.numbers()), args)
    if scope.owner is not None and schema.row_access == "own":
        where = where & (F.col("owner") == scope.owner)
    hit = F.coalesce(where, F.lit(False))
    n = whole.where(hit).count()
    if n > MOST_DELETED and not confirm:
        raise Conflict(f"{n} rows would go; confirm it")
    if n:
        owner = F.col("owner") if schema.row_access == "own" else F.lit(None).cast("string")
        tx.note_set(table, whole.where(hit).select("id", owner.alias("owner")), "delete")
        tx.replace(table, whole.where(~hit), tx.table(table)["rows"] - n)
    return n


def _upsert_by_key(tx: Transaction, table: str, scope: Scope, on: Sequence[str], records: Sequence[Mapping]) -> list[int]:
    """Records in turn: each updates the row with its key, or is inserted; later ones see earlier ones."""
    schema = tx.schema(table)
    if not 1 <= len(on) <= MOST_KEYS or len(records) > MOST_RECORDS:
        raise ValueError(f"1 to {MOST_KEYS} key fields and at most {MOST_RECORDS} records")
    given = [_record(schema, r, tx.at, partial=True) for r in records]
    keys = [tuple(_plain_key(g.get(f)) for f in on) for g in given]
    if any(k is None for key in keys for k in key):
        raise ValueError("a key field is null")
    wanted = tx.ns.spark.createDataFrame(sorted(set(keys)), ", ".join(f"k{i} string" for i in range(len(on))))
    keyed = tx.rows(table, scope).select("id", *[_key(schema, f).alias(f"k{i}") for i, f in enumerate(on)])
    found: dict[tuple, int] = {}
    for r in keyed.join(F.broadcast(wanted), [f"k{i}" for i in range(len(on))]).collect():  # the broadcast side is one call's records
        key = tuple(r[f"k{i}"] for i in range(len(on)))
        if key in found:
            raise Conflict(f"two rows have the key {key}")
        found[key] = r["id"]
    fresh: dict[tuple, dict] = {}
    changed: dict[int, dict] = {}
    out: list = []
    for record, g, key in zip(records, given, keys):
        if key in found:
            changed.setdefault(found[key], {}).update(g)
            out.append(found[key])
        elif key in fresh:
            fresh[key].update(g)
            out.append(key)
        else:
            fresh[key] = _record(schema, record, tx.at)
            out.append(key)
    if changed:
        whole = tx.rows(table)
        fields = sorted({f for g in changed.values() for f in g})
        kinds = schema.stored()
        patch = tx.ns.spark.createDataFrame([(i, [f for f in fields if f in g], *[g.get(f) for f in fields]) for i, g in changed.items()], "__id long, __set array<string>, " + ", ".join(f"__v_{f} {kinds[f].dataType.simpleString()}" for f in fields))
        joined = whole.join(F.broadcast(patch), F.col("id") == F.col("__id"), "left")
        merged = joined.select(*[F.when(F.coalesce(F.array_contains("__set", c), F.lit(False)), F.col(f"__v_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in whole.columns])
        tx.replace(table, merged, tx.table(table)["rows"])
        tx._note(table, [(i, scope.owner) for i in sorted(changed)], "update")
    ids = dict(zip(fresh, tx.append(table, list(fresh.values()), scope)))
    return [ids[x] if isinstance(x, tuple) else x for x in out]


OPERATIONS: dict[str, Callable] = {"insert": _insert, "update": _update, "upsert": _upsert, "delete": _delete, "upsert_by_key": _upsert_by_key}


def _violating(df: DataFrame, where: Column) -> list[int]:
    return [r[0] for r in df.where(where).select("id").orderBy("id").limit(5).collect()]


def _migrated(schema: TableSchema, df: DataFrame, c: Mapping) -> tuple[TableSchema, DataFrame, bool]:
    op, fields = c["op"], list(schema.fields)
    if op == "add_field":
        f = Field(**c["field"])
        f.check()
        fields.append(f)
        new = replace(schema, fields=fields)
        value = coerce(f, c["backfill"] if "backfill" in c else now() if f.default == "now()" else f.default)
        if f.required and value is None:
            raise SchemaError(f"{f.name} is required and needs a backfill")
        return new, df.withColumn(f.name, _literal(new, f.name, value)), True
    if op in ("add_constraint", "drop_constraint"):
        old = [x for x in schema.constraints if x.name != (c["constraint"]["name"] if op == "add_constraint" else c["name"])]
        if op == "drop_constraint" and len(old) == len(schema.constraints):
            raise SchemaError(f"no constraint {c['name']!r}")
        return replace(schema, constraints=old + ([Constraint(**c["constraint"])] if op == "add_constraint" else [])), df, False
    if op == "set_row_access":
        new = replace(schema, row_access=c["row_access"])
        return new, (df.withColumn("owner", F.lit(c.get("owner")).cast("string")) if c["row_access"] == "own" else df), True
    f = schema.field(c["name"])
    at = fields.index(f)
    if op in ("rename_field", "drop_field") and any(f.name in x.fields for x in schema.constraints):
        raise Conflict(f"a constraint uses {f.name!r}")
    if op == "rename_field":
        fields[at] = replace(f, name=c["to"])
        new = replace(schema, fields=fields)
        new.check()
        return new, df.withColumnRenamed(f.name, c["to"]), True
    if op == "drop_field":
        del fields[at]
        return replace(schema, fields=fields), df.drop(f.name), True
    if op == "set_enum":
        if c["enum"] is not None and (bad := _violating(df, F.col(f.name).isNotNull() & ~F.col(f.name).isin(*c["enum"]))):
            raise Conflict(f"rows {bad} have other values of {f.name!r}")
        fields[at] = replace(f, enum=c["enum"])
    elif op == "set_shape":
        if c["shape"] is not None:
            check = F.udf(lambda x, s=c["shape"]: x is not None and not shaped(json.loads(x), s), "boolean")
            if bad := _violating(df, check(F.col(f.name))):
                raise Conflict(f"rows {bad} have another shape of {f.name!r}")
        fields[at] = replace(f, shape=c["shape"])
    elif op in ("set_fulltext", "set_vectorize"):
        fields[at] = replace(f, **{op[4:]: bool(c["on"])})
    elif op == "set_file_constraints":
        large = F.col(f.name)["size"] > c["max_bytes"] if c.get("max_bytes") is not None else F.lit(False)
        other = ~F.col(f.name)["media_type"].isin(*c["media_types"]) if c.get("media_types") else F.lit(False)
        if bad := _violating(df, large | other):
            raise Conflict(f"files of rows {bad} break the limits")
        fields[at] = replace(f, max_bytes=c.get("max_bytes"), media_types=c.get("media_types"))
    else:
        raise SchemaError(f"no change {op!r}")
    new = replace(schema, fields=fields)
    new.check()
    return new, df, False
