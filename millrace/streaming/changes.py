"""The change feed: pages after a cursor, waiting for more, and push by Structured Streaming; and event-time extensions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import CHANGE, Namespace, Scope

MOST_CHANGES, MOST_WAIT = 1000, 60.0


class CursorExpired(ValueError):
    pass


@dataclass
class Changes:
    rows: list[dict]
    next_cursor: str
    truncated: bool


def _cursor(ns_gen: str, seq: int) -> str:
    return f"{ns_gen}:{seq}"


def log(ns: Namespace) -> DataFrame:
    """All retained change records."""
    folders = ns.manifest().get("change_folders", [])
    return ns.spark.read.schema(CHANGE).parquet(*[f"{ns.root}/{f}" for f in folders]) if folders else ns.spark.createDataFrame([], CHANGE)


def changes_since(ns: Namespace, cursor: str | None = None, table: str | None = None, limit: int = 100, scope: Scope = Scope()) -> Changes:
    """The page after a cursor, in order. No cursor gives the head, "begin" the start of what is retained. A cursor of a namespace that was made anew, or from before what is retained, has expired."""
    if not 1 <= limit <= MOST_CHANGES:
        raise ValueError(f"limit is 1 to {MOST_CHANGES}")
    state = ns.manifest()
    head, start = state["next_seq"] - 1, state.get("pruned_to", 0)
    if cursor is None:
        return Changes([], _cursor(state["ns_gen"], head), False)
    if cursor == "begin":
        at = start
    else:
        gen, _, seq = cursor.partition(":")
        if gen != state["ns_gen"] or int(seq) < start:
            raise CursorExpired("this cursor's records are gone; begin again")
        at = int(seq)
    folders = [f for f in state.get("change_folders", [])]
    # a folder's name has its first sequence number, so pages open no older folders than they must
    firsts = [int(f.split("/")[1].split("-")[0]) for f in folders]
    after = [f for k, f in enumerate(folders) if k + 1 == len(folders) or firsts[k + 1] > at + 1]
    if not after:
        return Changes([], _cursor(state["ns_gen"], at), False)
    df = ns.spark.read.schema(CHANGE).parquet(*[f"{ns.root}/{f}" for f in after]).where(F.col("seq") > at)
    if table is not None:
        df = df.where(F.col("table") == table)
    if scope.owner is not None:
        df = df.where(F.col("owner") == scope.owner)
    got = [r.asDict() for r in df.orderBy("seq").limit(limit + 1).collect()]
    page = got[:limit]
    end = page[-1]["seq"] if len(got) > limit else head
    return Changes(page, _cursor(state["ns_gen"], end), len(got) > limit)


def wait_for(ns: Namespace, cursor: str, timeout: float = 30.0, step: float = 0.2, **options) -> Changes:
    """changes_since, waiting until there are some or the time is over; then the page is empty and the cursor the same."""
    end = time.monotonic() + min(timeout, MOST_WAIT)
    while True:
        found = changes_since(ns, cursor, **options)
        if found.rows:
            return found
        if time.monotonic() >= end:
            return Changes([], cursor, False)
        time.sleep(step)


def prune(ns: Namespace, before: str) -> int:
    """Drops whole commits whose records are older than a time; returns the last sequence number that is gone."""
    state = ns.manifest()
    folders = state.get("change_folders", [])
    gone = []
    for k, f in enumerate(folders[:-1]):
        row = ns.spark.read.schema(CHANGE).parquet(f"{ns.root}/{f}").agg(F.max("at")).first()
        if row[0] >= before:
            break
        gone.append(k)
    if gone:
        state["change_folders"] = folders[len(gone) :]
        state["pruned_to"] = int(state["change_folders"][0].split("/")[1].split("-")[0]) - 1
        state["version"] += 1
        if not ns.files.publish(f"manifests/{state['version']:010d}.json", json.dumps(state)):
            raise ValueError("another commit came first; try again")
        for k in gone:
            ns.files.delete(folders[k])
            ns.files.delete(f"feed/{folders[k].partition('/')[2]}")
    return state.get("pruned_to", 0)


def stream(ns: Namespace, most_commits: int = 100) -> DataFrame:
    """Commits as a stream: the names of their change folders, which are announced once they are published. Its checkpoint is the consumer's cursor."""
    ns.announce()
    ns.files.fs.mkdirs(ns.files.path("feed"))
    return ns.spark.readStream.option("maxFilesPerTrigger", most_commits).text(f"{ns.root}/feed")


def subscribe(ns: Namespace, consume: Callable[[DataFrame, int], None], checkpoint: str, table: str | None = None, once: bool = False, scope: Scope = Scope()):
    """Calls consume(rows, batch number) with the records of new commits: first those that there are, then live ones. A batch may come again after a failure, with the same number."""

    def told(commits: DataFrame, batch: int) -> None:
        live = set(ns.manifest().get("change_folders", []))
        folders = sorted(r[0] for r in commits.collect() if r[0] in live)  # at most `most_commits` names; pruned ones are gone
        if folders:
            df = ns.spark.read.schema(CHANGE).parquet(*[f"{ns.root}/{f}" for f in folders])
            if table is not None:
                df = df.where(F.col("table") == table)
            if scope.owner is not None:
                df = df.where(F.col("owner") == scope.owner)
            consume(df, batch)

    writer = stream(ns).writeStream.option("checkpointLocation", checkpoint).foreachBatch(told)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


# Extensions: event time over the events table; works on batches and streams alike.


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
