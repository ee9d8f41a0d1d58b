"""Queries over the test tables, and the DuckDB SQL that gives the same rows.

SQL texts run through the read-only gate. Where Spark and DuckDB spell a thing differently, the second text is DuckDB's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sql
from ..plans.filters import filtered
from ..streaming import changes
from . import fulltext, graph, native, vectors

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, tuple[str, str | None]] = {
    "sql_projection": ("SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderstatus) AS status FROM orders", None),
    "sql_filter": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'", None),
    "sql_scan_count": ("SELECT count(*) AS n FROM lineitem", None),
    "sql_scan_sum": ("SELECT round(sum(l_quantity), 2) AS total FROM lineitem", None),
    "sql_group_by": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "sql_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "sql_distinct": ("SELECT DISTINCT p_brand, p_size FROM part", None),
    "sql_count_distinct": ("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority", None),
    "sql_filtered_aggregate": ("SELECT l_shipyear, count(*) FILTER (WHERE l_quantity > 25) AS many, count(*) AS n FROM (SELECT year(l_shipdate) AS l_shipyear, l_quantity FROM lineitem) AS x GROUP BY l_shipyear", None),
    "sql_inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000", None),
    "sql_left_join": ("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey", None),
    "sql_right_join": ("SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "sql_full_join": ("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k", None),
    "sql_cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "sql_using_join": ("SELECT k, r, n FROM (SELECT r_regionkey AS k, r_name AS r FROM region) a JOIN (SELECT n_regionkey AS k, n_name AS n FROM nation) b USING (k)", None),
    "sql_natural_join": ("SELECT k, r, n FROM (SELECT r_regionkey AS k, r_name AS r FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name AS n FROM nation) b", None),
    "sql_theta_join": ("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "sql_semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", None),
    "sql_semi_in": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "sql_anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "sql_anti_not_in": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "sql_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "sql_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "sql_grouping_sets": ("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", None),
    "sql_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_window_rank": ("SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", None),
    "sql_window_lag": ("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders", None),
    "sql_window_frame": ("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS first_one FROM lineitem", None),
    "sql_window_ntile": ("SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS quarter, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_partkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_partkey), 6) AS cd FROM part", None),
    "sql_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "sql_offset": ("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25", None),
    "sql_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "sql_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", None),
    "sql_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None),
    "sql_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", None),
    "sql_cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), few AS (SELECT * FROM big WHERE total > 500000) SELECT c.c_name, round(f.total, 2) AS total FROM few f JOIN customer c ON c.c_custkey = f.o_custkey", None),
    "sql_recursive_cte": ("WITH RECURSIVE up(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM up WHERE n < 50) SELECT n, total FROM up", None),
    "sql_values": ("SELECT v.k, r.r_name FROM (VALUES (0), (2), (9)) AS v(k) LEFT JOIN region r ON r.r_regionkey = v.k", None),
    "sql_scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "sql_correlated_subquery": ("SELECT p.p_partkey, (SELECT max(l.l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS most FROM part p", None),
    "sql_lateral": ("SELECT n.n_name, x.c_name FROM nation n, LATERAL (SELECT c_name FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x", None),
    "sql_case": ("SELECT o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1, 2", None),
    "sql_string_functions": ("SELECT c_custkey, length(c_name) AS n, substr(c_name, 1, 4) AS head, replace(c_mktsegment, 'A', 'a') AS seg, trim(concat(' ', c_name, ' ')) AS tidy FROM customer", None),
    "sql_date_functions": ("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2", None),
    "sql_math_functions": ("SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS f, round(sqrt(l_quantity), 6) AS s, l_linenumber % 3 AS r, abs(l_discount - 0.05) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_quantity), 6) AS s, l_linenumber % 3 AS r, abs(l_discount - 0.05) AS d FROM lineitem"),
    "sql_pricing_summary": ("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "sql_three_way_join": ("SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name", None),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in text]
    return lambda spark, sf_dir: sql.statement(spark, text, {t: table(spark, sf_dir, t) for t in used})


def bind_arguments(spark, sf_dir):
    return sql.statement(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", {"orders": table(spark, sf_dir, "orders")}, ["F", 100000.0])


FILTERS = {
    "filter_comparison": ("orders", "o_totalprice > 150000 AND o_orderstatus <> 'F' OR o_orderkey IN (1, 2, 3)", [], "o_orderkey", None),
    "filter_like": ("customer", "c_mktsegment LIKE 'build%' AND NOT (c_name LIKE '%7')", [], "c_custkey", "c_mktsegment ILIKE 'build%' AND NOT (c_name ILIKE '%7')"),
    "filter_arithmetic": ("lineitem", "l_linenumber * 2 + 1 > 7 AND l_orderkey % 5 = 2 AND l_quantity / 2.0 < 10", [], "l_orderkey", "l_linenumber * 2 + 1 > 7 AND l_orderkey % 5 = 2 AND l_quantity / 2.0 < 10"),
    "filter_between": ("part", "p_size BETWEEN 5 AND 20 AND p_partkey NOT BETWEEN 50 AND 60", [], "p_partkey", None),
    "filter_case": ("part", "CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END <> 'middle' AND CASE p_size % 2 WHEN 0 THEN 1 END = 1", [], "p_partkey", None),
    "filter_is": ("orders", "(o_orderstatus IS NOT NULL) AND (o_custkey % 3 IS 1) AND NOT (o_totalprice IS NULL)", [], "o_orderkey", "o_orderstatus IS NOT NULL AND o_custkey % 3 = 1 AND o_totalprice IS NOT NULL"),
    "filter_like_escape": ("part", "p_brand LIKE 'brand!#1_' ESCAPE '!' OR p_type LIKE '%!%%' ESCAPE '!' OR p_name LIKE '%a%'", [], "p_partkey", "p_brand ILIKE 'brand!#1_' ESCAPE '!' OR p_type ILIKE '%!%%' ESCAPE '!' OR p_name ILIKE '%a%'"),
    "filter_concat": ("nation", "n_name || '/' || n_regionkey > 'F' AND '' || n_nationkey <> '3'", [], "n_nationkey", "n_name || '/' || CAST(n_regionkey AS VARCHAR) > 'F' AND CAST(n_nationkey AS VARCHAR) <> '3'"),
    "filter_abs_unary": ("customer", "abs(c_acctbal) > 5000 AND -c_custkey < -10 AND +c_nationkey >= 5", [], "c_custkey", "abs(c_acctbal) > 5000 AND -c_custkey < -10 AND c_nationkey >= 5"),
    "filter_lower_trim": ("customer", "lower(c_mktsegment) = 'building' AND trim('  ' || c_name || ' ') = c_name AND ltrim(c_name, 'Custmer#0') < '5' AND rtrim(c_name, '0123456789') <> c_name", [], "c_custkey", "lower(c_mktsegment) = 'building' AND trim('  ' || c_name || ' ') = c_name AND ltrim(c_name, 'Custmer#0') < '5' AND rtrim(c_name, '0123456789') <> c_name"),
    "filter_replace_instr": ("part", "instr(p_type, 'E') > 2 AND length(replace(p_name, 'a', '')) < length(p_name)", [], "p_partkey", "instr(p_type, 'E') > 2 AND length(replace(p_name, 'a', '')) < length(p_name)"),
    "filter_choice": ("lineitem", "coalesce(nullif(l_linenumber, 1), 9) > 5 AND ifnull(nullif(l_returnflag, 'N'), 'none') <> 'R' AND iif(l_quantity > 25, l_linenumber, 0) = 0", [], "l_orderkey", "coalesce(nullif(l_linenumber, 1), 9) > 5 AND coalesce(nullif(l_returnflag, 'N'), 'none') <> 'R' AND CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END = 0"),
    "filter_times": ("events", "time(ts) >= '06:00:00' AND datetime(ts, '+2 hours') < datetime(ts, '+1 day') AND strftime('%w', ts) IN ('1', '3') AND julianday(ts) > 2400000.5", [], "event_id", "CAST(ts AS TIME) >= TIME '06:00:00' AND dayofweek(ts) IN (1, 3)"),
    "filter_arguments": ("orders", "o_orderpriority = ? AND o_custkey < ?", ["1-URGENT", 500], "o_orderkey", "o_orderpriority = '1-URGENT' AND o_custkey < 500"),
    "filter_functions": ("customer", "length(c_name) > 5 AND substr(c_name, -1) IN ('1', '3') AND upper(c_mktsegment) <> 'MACHINERY' AND round(c_acctbal) > 0", [], "c_custkey", "length(c_name) > 5 AND right(c_name, 1) IN ('1', '3') AND upper(c_mktsegment) <> 'MACHINERY' AND round(c_acctbal) > 0"),
    "filter_dates": ("orders", "date(o_orderdate, '+10 days') >= '1997-01-01' AND strftime('%m', o_orderdate) = '03'", [], "o_orderkey", "CAST(o_orderdate + INTERVAL 10 DAY AS DATE) >= DATE '1997-01-01' AND month(o_orderdate) = 3"),
}


def _filter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    of, text, args, key, _ = FILTERS[name]
    return lambda spark, sf_dir: filtered(table(spark, sf_dir, of), text, args).select(F.col(key).alias("k"))


SEARCHED = "the with of"
WORDS = ["thndre", "ering", "onthe"]


def fulltext_bm25(spark, sf_dir):
    """BM25 of three words over all documents, best 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fulltext.search(docs, " OR ".join(WORDS), ["text"], "doc_id", stemming=False)
    return fulltext.best(found, 50, id_column="doc_id").select("doc_id", F.round("_score", 6).alias("score"))


def fulltext_phrase(spark, sf_dir):
    """The documents that hold a phrase, without those that hold a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fulltext.search(docs, f'"{WORDS[1]} {WORDS[2]}" OR ({WORDS[0]} NOT {WORDS[1]})', ["text"], "doc_id", stemming=False).select("doc_id")


def fulltext_prefix(spark, sf_dir):
    """How many documents have a word that begins so, and each word of a pair."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fulltext.search(docs, f"{WORDS[0][:4]}* AND {WORDS[1]}", ["text"], "doc_id", stemming=False).select("doc_id")


_WORDS = "WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+') AS w FROM documents)"
_BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
c AS (SELECT doc_id, len(w) AS size, """ + ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS c{k}" for k, w in enumerate(WORDS)) + """ FROM t),
d AS (SELECT """ + ", ".join(f"sum(CASE WHEN c{k} > 0 THEN 1 ELSE 0 END) AS d{k}" for k in range(len(WORDS))) + """ FROM c),
r AS (SELECT doc_id, """ + " + ".join(f"(CASE WHEN c{k} > 0 THEN ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * (c{k} * 2.2) / (c{k} + 1.2 * (1 - 0.75 + 0.75 * size / mean)) ELSE 0 END)" for k in range(len(WORDS))) + " AS score FROM c, d, s WHERE " + " OR ".join(f"c{k} > 0" for k in range(len(WORDS))) + """)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 50
"""

QUERY_VECTOR = [((k % 7) - 3) / 10 for k in range(64)]
_COSINE = f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST({QUERY_VECTOR} AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[]))))"


def vector_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, "embedding", QUERY_VECTOR, limit=10, id_column="vec_id").select("vec_id", F.round("_score", 9).alias("score"))


def vector_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, "embedding", QUERY_VECTOR, allowed=F.col("label").isin(1, 3), min_score=0.05, limit=100, id_column="vec_id").select("vec_id", F.round("_score", 9).alias("score"))


def _edges(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        graph.edges_of(orders, "places", "o_orderkey", ("orders", "o_orderkey"), ("customer", "o_custkey"))
        .unionByName(graph.edges_of(customer, "lives", "c_custkey", ("customer", "c_custkey"), ("nation", "c_nationkey")))
        .unionByName(graph.edges_of(nation, "lies", "n_nationkey", ("nation", "n_nationkey"), ("region", "n_regionkey")))
    )


def graph_neighbors(spark, sf_dir):
    return graph.touching(_edges(spark, sf_dir), [("nation", 3)], "in", ["lives"]).select("relation", "id", "source_id", "target_id")


def graph_reach(spark, sf_dir):
    """All that three hops from every order lead to."""
    return graph.reach(_edges(spark, sf_dir), table(spark, sf_dir, "orders").select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("id")), 3)


def graph_path(spark, sf_dir):
    """The hops from the first order to its customer's region."""
    first = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).agg(F.min_by(F.struct("o_orderkey", "n_regionkey"), "o_orderkey").alias("f")).first()["f"]
    walk = graph.find_path(_edges(spark, sf_dir), ("orders", first["o_orderkey"]), ("region", first["n_regionkey"]), max_hops=6, node_limit=1000, edge_limit=1000)
    return spark.createDataFrame([(k, e["relation"], e["id"]) for k, e in enumerate(walk.path or [])], "step int, relation string, id long")


def keyed_merge(spark, sf_dir):
    """Last write for each key: the order of each customer with the latest date, later keys winning ties."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("n"))


def foreign_key_check(spark, sf_dir):
    """The customers that have no urgent order: the anti join by which a foreign key is checked, on a pair of tables that violates it."""
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return named.join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def unique_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


def events_tumbling(spark, sf_dir):
    return changes.tumbling(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "total")


def events_sliding(spark, sf_dir):
    return changes.sliding(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def events_sessions(spark, sf_dir):
    return changes.sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _sql(v[0]) for k, v in SQL.items()},
    "sql_bind_arguments": bind_arguments,
    **{k: _filter(k) for k in FILTERS},
    "fulltext_bm25": fulltext_bm25,
    "fulltext_phrase": fulltext_phrase,
    "fulltext_prefix": fulltext_prefix,
    "vector_top_k": vector_top_k,
    "vector_filtered": vector_filtered,
    "graph_neighbors": graph_neighbors,
    "graph_reach": graph_reach,
    "graph_path": graph_path,
    "keyed_merge": keyed_merge,
    "foreign_key_check": foreign_key_check,
    "unique_check": unique_check,
    "events_tumbling": events_tumbling,
    "events_sliding": events_sliding,
    "events_sessions": events_sessions,
    **native.QUERIES,
}

ORACLE: dict[str, str] = {
    **{k: v[1] or v[0] for k, v in SQL.items()},
    "sql_bind_arguments": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    **{k: f"SELECT {key} AS k FROM {of} WHERE {other or text}" for k, (of, text, _, key, other) in FILTERS.items()},
    "fulltext_bm25": _BM25,
    "fulltext_phrase": f"{_WORDS} SELECT doc_id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' {WORDS[1]} {WORDS[2]} ') OR list_contains(w, '{WORDS[0]}') AND NOT list_contains(w, '{WORDS[1]}')",
    "fulltext_prefix": f"{_WORDS} SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, '{WORDS[0][:4]}'))) > 0 AND list_contains(w, '{WORDS[1]}')",
    "vector_top_k": f"SELECT vec_id, round({_COSINE}, 9) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 10",
    "vector_filtered": f"SELECT vec_id, round({_COSINE}, 9) AS score FROM embeddings WHERE label IN (1, 3) AND {_COSINE} >= 0.05 ORDER BY {_COSINE} DESC, vec_id LIMIT 100",
    "graph_neighbors": "SELECT 'lives' AS relation, c_custkey AS id, c_custkey AS source_id, CAST(c_nationkey AS BIGINT) AS target_id FROM customer WHERE c_nationkey = 3",
    "graph_reach": """WITH c AS (SELECT DISTINCT c.* FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey), n AS (SELECT DISTINCT n.* FROM c JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT 'orders' AS "table", o_orderkey AS id, 0 AS hops FROM orders UNION ALL SELECT 'customer', c_custkey, 1 FROM c UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), 2 FROM n UNION ALL SELECT DISTINCT 'region', CAST(n_regionkey AS BIGINT), 3 FROM n""",
    "keyed_merge": "SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "graph_path": """WITH f AS (SELECT o_orderkey, c_custkey, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY o_orderkey LIMIT 1)
SELECT 0 AS step, 'places' AS relation, o_orderkey AS id FROM f UNION ALL SELECT 1, 'lives', c_custkey FROM f UNION ALL SELECT 2, 'lies', CAST(n_nationkey AS BIGINT) FROM f""",
    "foreign_key_check": "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey",
    "unique_check": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1",
    "events_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT strftime(s, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, event_type FROM events) GROUP BY 1, 2",
    "events_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s",
    **native.ORACLE,
}
