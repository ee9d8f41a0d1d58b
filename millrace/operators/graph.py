"""A property graph over foreign keys: neighbours, bounded expansion, shortest paths.

Edges are rows (relation, id, source_table, source_id, target_table, target_id, type). A bounded walk keeps its frontier, at most as many nodes as its limit, on the driver and asks for
the frontier's edges by a join with these few rows; expansion without limits is an iteration of DataFrame joins instead (reach).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "relation string, id long, source_table string, source_id long, target_table string, target_id long, type string"
MOST_HOPS, MOST_ITEMS = 32, 1000


class GraphError(ValueError):
    pass


Node = tuple[str, int]


@dataclass
class Walk:
    nodes: list[Node] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    hops: int = 0
    stop_reason: str | None = None
    path: list[dict] | None = None


def edges_of(rows: DataFrame, relation: str, id_column: str, source: tuple[str, str], target: tuple[str, str], kind: str | None = None) -> DataFrame:
    """A table's rows as edges; source and target are (table, column), `kind` a column with the edge's type."""
    return rows.where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull()).select(
        F.lit(relation).alias("relation"), F.col(id_column).cast("long").alias("id"), F.lit(source[0]).alias("source_table"), F.col(source[1]).cast("long").alias("source_id"),
        F.lit(target[0]).alias("target_table"), F.col(target[1]).cast("long").alias("target_id"), (F.col(kind) if kind else F.lit(relation)).cast("string").alias("type"),
    )


def touching(edges: DataFrame, nodes: Sequence[Node], direction: str, types: Sequence[str] | None) -> DataFrame:
    """Edges at the nodes (a bounded list), in the order of relation and id; a loop once."""
    if direction not in ("out", "in", "both"):
        raise GraphError("direction is out, in or both")
    some = edges if types is None else edges.where(F.col("type").isin(*types)) if types else edges.limit(0)
    by_table: dict[str, list[int]] = {}
    for t, i in nodes:
        by_table.setdefault(t, []).append(i)
    at = lambda side: _any([(F.col(f"{side}_table") == t) & F.col(f"{side}_id").isin(*ids) for t, ids in by_table.items()])
    where = at("source") if direction == "out" else at("target") if direction == "in" else at("source") | at("target")
    return some.where(where).orderBy("relation", "id")


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _checked(limit: int, most: int = MOST_ITEMS) -> int:
    if not 1 <= limit <= most:
        raise GraphError(f"a limit is 1 to {most}")
    return limit


def neighbors(edges: DataFrame, node: Node, direction: str = "both", types: Sequence[str] | None = None, node_limit: int = 100, edge_limit: int = 100, visible: DataFrame | None = None) -> Walk:
    """Edges of one node and the nodes at their other ends. visible (table, id): both ends of an edge must be in it, where given."""
    return subgraph(edges, [node], 1, direction, types, node_limit, edge_limit, visible=visible)


def subgraph(edges: DataFrame, seeds: Sequence[Node], max_hops: int, direction: str = "both", types: Sequence[str] | None = None, node_limit: int = 1000, edge_limit: int = 1000, work_limit: int = 100_000, visible: DataFrame | None = None, target: Node | None = None) -> Walk:
    """Breadth-first expansion from the seeds in edge order, stopped by hops, nodes, edges or edges looked at; nodes and edges come sorted."""
    _checked(max_hops, MOST_HOPS), _checked(node_limit), _checked(edge_limit)
    if visible is not None:
        for side in ("source", "target"):
            edges = edges.join(visible.select(F.col("table").alias(f"{side}_table"), F.col("id").alias(f"{side}_id")), [f"{side}_table", f"{side}_id"], "left_semi")
        edges = edges.select([c.split()[0] for c in EDGE.split(", ")])
    walk, seen, kept, parent = Walk(), dict.fromkeys(seeds), {}, {}
    frontier, work = list(seen), 0
    if len(seen) > node_limit:
        raise GraphError("more seeds than the node limit")
    found = target in seen
    while frontier and not found and walk.stop_reason is None:
        if walk.hops == max_hops:
            walk.stop_reason = "hops"
            break
        rows = touching(edges, frontier, direction, types).limit(work_limit - work + 1).collect()
        here, fresh = set(frontier), []
        for r in rows:
            work += 1
            if work > work_limit:
                walk.stop_reason = "work"
                break
            a, b = (r.source_table, r.source_id), (r.target_table, r.target_id)
            key = (r.relation, r.id)
            if key in kept:
                continue
            ends = [(x, y) for x, y, ok in ((a, b, direction != "in"), (b, a, direction != "out")) if ok and x in here]
            if len(kept) == edge_limit:
                walk.stop_reason = "edges"
                break
            new = [y for _, y in ends if y not in seen]
            if new and len(seen) == node_limit:
                walk.stop_reason = "nodes"
                break
            kept[key] = r.asDict()
            for x, y in ends:
                if y not in seen:
                    seen[y] = None
                    parent[y] = (x, r.asDict())
                    fresh.append(y)
                    found = found or y == target
            if found:
                break
        walk.hops += bool(rows)
        frontier = fresh
    walk.nodes, walk.edges = sorted(seen), [kept[k] for k in sorted(kept)]
    if target is not None and found:
        path, at = [], target
        while at in parent:
            at, edge = parent[at]
            path.append(edge)
        walk.path = path[::-1]
    return walk


def find_path(edges: DataFrame, source: Node, target: Node, max_hops: int = 8, direction: str = "both", types: Sequence[str] | None = None, **limits) -> Walk:
    """A shortest path, the first in edge order; path is None where the limits end first or there is none."""
    return subgraph(edges, [source], max_hops, direction, types, target=target, **limits)


#: Rows of links and seeds for each partition of reach(), and the parts into which a node's incoming rows are dealt before they become one.
SHARE, PARTS = 1 << 18, 32


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", share: int = SHARE) -> DataFrame:
    """Every (table, id) within `hops` of the seeds and its distance, over edges of any size: a semi join of the edges with the frontier for each hop, then the least number of hops of each node.

    Rows of nodes shrink so much in a shuffle that partitions by bytes would hold tens of millions; the number of partitions follows the counted rows instead, so a task's memory stays as it is.
    Rows that lead to a node are dealt by where they come from first, so a node of many edges isn't gathered from all of them in one task.
    """
    out = edges.select(F.struct(F.col("source_id").alias("id"), F.col("source_table").alias("table")).alias("x"), F.struct(F.col("target_id").alias("id"), F.col("target_table").alias("table")).alias("y"))
    back = out.select(F.col("y").alias("x"), F.col("x").alias("y"))
    links = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    frontier = seeds.select(F.struct("id", "table").alias("x"))
    n = max(1, -(-links.select("x").unionAll(frontier).count() // share))
    links, frontier = links.repartition(n, "x"), frontier.repartition(n, "x").distinct()
    found = frontier.withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        # an inner join with distinct nodes, for a semi join is pushed below repartition()
        to = links.join(frontier, "x").select(F.col("y").alias("x"), F.pmod(F.hash("x"), F.lit(PARTS)).alias("part"))
        frontier = to.repartition(n, "x", "part").distinct().select("x").repartition(n, "x").distinct()
        found = found.unionByName(frontier.withColumn("hops", F.lit(k)))
    return found.repartition(n, "x").groupBy("x").agg(F.min("hops").alias("hops")).select("x.table", "x.id", "hops")


def search_graph(found: Sequence[tuple[str, DataFrame]], edges: DataFrame, top_k: int, max_hops: int, **options) -> tuple[list[tuple[float, Node]], Walk]:
    """Seeds from vector searches, as (table, rows with id and _score), merged by score, table and id, and the graph around them."""
    best = sorted(((-r["_score"], t, r["id"]) for t, rows in found for r in rows.select("id", "_score").limit(top_k).collect()))[:top_k]
    seeds = list(dict.fromkeys((t, i) for _, t, i in best))
    return [(-s, (t, i)) for s, t, i in best], subgraph(edges, seeds, max_hops, **options)
