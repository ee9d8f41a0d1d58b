"""Queries that run the namespace's own operations over whole test tables, and the DuckDB SQL that gives the same rows.

Each fills a namespace of its own in the shared folder by append(), works on it as a user would, and returns what is in it then.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Conflict, Namespace
from ..sources.schema import Constraint, Field, TableSchema
from ..streaming import changes


def fresh(spark: SparkSession) -> Namespace:
    """An empty namespace in the shared folder: spark.checkpoint.dir, or in local mode a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    root = f"{place}/millrace/namespaces-{uuid4().hex}"
    catalog = Catalog(spark, root)
    catalog.files.fs.deleteOnExit(catalog.files.path(""))
    return catalog.create_namespace("shop")


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CUSTOMER = [Field("key", "number", required=True), Field("name", "string"), Field("segment", "string"), Field("balance", "number"), Field("rank", "string", default="plain")]


def _customers(spark, sf_dir: str) -> Namespace:
    ns = fresh(spark)
    ns.create_table("customers", TableSchema(CUSTOMER, constraints=[Constraint("one_key", "unique", ["key"])]))
    ns.append("customers", _table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    return ns


def _nations(spark, sf_dir: str) -> Namespace:
    ns = fresh(spark)
    ns.create_table("nations", TableSchema([Field("key", "number"), Field("name", "string"), Field("region", "number")], constraints=[Constraint("one_key", "unique", ["key"])]))
    ns.append("nations", _table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return ns


def write_append(spark, sf_dir):
    """A table filled from a DataFrame: ids in its order, defaults for missing fields."""
    return _customers(spark, sf_dir).view("customers").select("id", F.col("key").cast("long").alias("key"), "name", "segment", "balance", "rank")


def write_update(spark, sf_dir):
    ns = _customers(spark, sf_dir)
    ns.update("customers", "balance < 0 AND segment LIKE 'b%'", {"rank": "debtor", "balance": 0})
    return ns.view("customers").select(F.col("key").cast("long").alias("key"), "balance", "rank")


def write_upsert(spark, sf_dir):
    """An update where rows match; an insert where none do."""
    ns = _customers(spark, sf_dir)
    ns.upsert("customers", "segment = 'MACHINERY'", {"rank": "works"})
    ns.upsert("customers", "segment = 'nobody'", {"key": -1, "rank": "new"})
    return ns.view("customers").select(F.col("key").cast("long").alias("key"), "segment", "rank")


def write_delete(spark, sf_dir):
    ns = _customers(spark, sf_dir)
    ns.delete("customers", "balance < ? OR key % 4 = 3", [1000], confirm=True)
    return ns.view("customers").select(F.col("key").cast("long").alias("key"))


def write_upsert_by_key(spark, sf_dir):
    """Suppliers' nations by key: those that are there are renamed, others are inserted."""
    ns = _nations(spark, sf_dir)
    regions = _table(spark, sf_dir, "region").collect()  # one call's records
    ns.upsert_by_key("nations", ["key"], [{"key": 5 * r.r_regionkey + 10, "name": r.r_name} for r in regions])
    return ns.view("nations").select(F.col("key").cast("long").alias("key"), "name", F.col("region").cast("long").alias("region"))


def write_batch(spark, sf_dir):
    """An insert, an update that sees it and a delete that sees both, as one commit."""
    ns = _nations(spark, sf_dir)
    ns.batch([
        {"op": "insert", "table": "nations", "records": [{"key": 100, "name": "sea", "region": 9}, {"key": 101, "name": "sky", "region": 9}]},
        {"op": "update", "table": "nations", "filter": "region IN (9, 1)", "set": {"region": 7}},
        {"op": "delete", "table": "nations", "filter": "region = 7 AND key % 2 = 1"},
    ])
    return ns.view("nations").select(F.col("key").cast("long").alias("key"), "name", F.col("region").cast("long").alias("region"))


def _outcome(spark, tried) -> bool:
    try:
        tried()
    except Conflict:
        return True
    return False


def constraint_unique(spark, sf_dir):
    """Whether a second load of the same keys is refused, and what is there afterwards."""
    ns = _nations(spark, sf_dir)
    again = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    refused = _outcome(spark, lambda: ns.append("nations", again))
    return ns.view("nations").agg(F.count("*").alias("n")).select(F.lit(refused).alias("refused"), "n")


def constraint_foreign_key(spark, sf_dir):
    """Customers that name rows of nations: loaded; a load that names no row and the loss of a nation are refused."""
    ns = _nations(spark, sf_dir)
    ns.create_table("customers", TableSchema([Field("key", "number"), Field("nation", "number")], constraints=[Constraint("lives", "foreign_key", ["nation"], "nations")]))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") + 1).cast("long").alias("nation"))
    ns.append("customers", rows)
    lost = _outcome(spark, lambda: ns.append("customers", rows.withColumn("nation", F.col("nation") + 1000)))
    gone = _outcome(spark, lambda: ns.delete("nations", "key = 3"))
    nations = ns.view("nations").select("id", F.col("name").alias("nation_name"))
    met = ns.view("customers").drop("id").join(nations, F.col("nation") == F.col("id"))
    return met.groupBy("nation_name").agg(F.count("*").alias("n")).select("nation_name", "n", F.lit(lost).alias("lost_refused"), F.lit(gone).alias("gone_refused"))


def migration(spark, sf_dir):
    """A field added with a value for the rows that are there, one renamed, one dropped, one enumerated."""
    ns = _customers(spark, sf_dir)
    version = ns.describe_table("customers")["schema"]["version"]
    ns.migrate("customers", [
        {"op": "add_field", "field": {"name": "visits", "type": "number"}, "backfill": 3}, {"op": "rename_field", "name": "segment", "to": "market"}, {"op": "drop_field", "name": "rank"},
        {"op": "set_enum", "name": "market", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
    ], expected_version=version)
    return ns.view("customers").select(F.col("key").cast("long").alias("key"), "market", F.col("visits").cast("long").alias("visits"))


def changes_feed(spark, sf_dir):
    """Change records of a load, an update and a delete, by kind."""
    ns = _customers(spark, sf_dir)
    ns.update("customers", "balance < 0", {"rank": "debtor"})
    ns.delete("customers", "segment = 'BUILDING'", confirm=True)
    log = changes.log(ns)
    return log.groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("row_id").alias("rows"), F.countDistinct("commit_id").alias("commits"))


def changes_page(spark, sf_dir):
    """The page of a hundred records after the start, and after its cursor."""
    ns = _customers(spark, sf_dir)
    one = changes.changes_since(ns, "begin", limit=100)
    two = changes.changes_since(ns, one.next_cursor, limit=50)
    return spark.createDataFrame([(r["seq"], r["row_id"], r["kind"]) for r in one.rows + two.rows], "seq long, row_id long, kind string")


def read_rows_page(spark, sf_dir):
    """The page of a hundred rows after an id, in order of id."""
    rows, more = _customers(spark, sf_dir).read_rows("customers", after_id=50, limit=100)
    return spark.createDataFrame([(r["id"], int(r["key"]), r["name"], more) for r in rows], "id long, key long, name string, more boolean")


def read_rows_by_id(spark, sf_dir):
    rows, _ = _customers(spark, sf_dir).read_rows("customers", ids=[3, 77, 10**9, 78])
    return spark.createDataFrame([(r["id"], int(r["key"]), r["name"]) for r in rows], "id long, key long, name string")


def namespace_sql(spark, sf_dir):
    """SQL over a namespace's own tables."""
    return _customers(spark, sf_dir).query("SELECT segment, count(*) AS n, round(sum(balance), 2) AS total FROM customers WHERE balance > ? GROUP BY segment", [100])


def json_field(spark, sf_dir):
    """JSON texts that a load has checked, and a filter over them."""
    ns = fresh(spark)
    ns.create_table("events", TableSchema([Field("key", "number"), Field("props", "json")]))
    ns.append("events", _table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "props"))
    return ns.view("events").select(F.col("key").cast("long").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def namespace_vectors(spark, sf_dir):
    """Cosine search over a namespace's vectors, filtered before it ranks."""
    ns = fresh(spark)
    ns.create_table("points", TableSchema([Field("key", "number"), Field("kind", "number"), Field("v", "vector", dim=64)]))
    ns.append("points", _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("kind"), F.col("embedding").alias("v")))
    found = ns.search_vector("points", [((k % 7) - 3) / 10 for k in range(64)], filter="kind IN (2, 4)", limit=50)
    return found.select(F.col("key")["i"].alias("key"), F.round("_score", 9).alias("score"))


def relations(spark, sf_dir):
    """Edges of a relation table: nations lie in regions; the neighbours of one region."""
    ns = fresh(spark)
    ns.create_table("regions", TableSchema([Field("name", "string")]))
    ns.create_table("nations", TableSchema([Field("name", "string")]))
    ns.create_table("lies", TableSchema(
        [Field("nation", "number", required=True), Field("region", "number", required=True), Field("how", "string", required=True)],
        constraints=[Constraint("from", "foreign_key", ["nation"], "nations"), Constraint("to", "foreign_key", ["region"], "regions")], relation={"source": "nation", "target": "region", "type": "how"},
    ))
    ns.append("regions", _table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("name")))
    nation = _table(spark, sf_dir, "nation")
    ns.append("nations", nation.orderBy("n_nationkey").select(F.col("n_name").alias("name")))
    ns.append("lies", nation.orderBy("n_nationkey").select((F.col("n_nationkey") + 1).cast("long").alias("nation"), (F.col("n_regionkey") + 1).cast("long").alias("region"), F.lit("in").alias("how")))
    return ns.edges().select("relation", "source_table", "source_id", "target_table", "target_id")


QUERIES = {
    "write_append": write_append, "write_update": write_update, "write_upsert": write_upsert, "write_delete": write_delete, "write_upsert_by_key": write_upsert_by_key, "write_batch": write_batch, "constraint_unique": constraint_unique,
    "constraint_foreign_key": constraint_foreign_key, "migration": migration, "changes_feed": changes_feed, "changes_page": changes_page, "read_rows_page": read_rows_page, "read_rows_by_id": read_rows_by_id, "namespace_sql": namespace_sql,
    "json_field": json_field, "namespace_vectors": namespace_vectors, "relations": relations,
}

_QUERY = f"CAST({[((k % 7) - 3) / 10 for k in range(64)]} AS DOUBLE[])"
_COSINE = f"list_dot_product(CAST(embedding AS DOUBLE[]), {_QUERY}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({_QUERY}, {_QUERY})))"
_IDS = "SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS key, c_name AS name FROM customer"

ORACLE = {
    "write_append": "SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, 'plain' AS rank FROM customer",
    "write_update": "SELECT c_custkey AS key, CASE WHEN c_acctbal < 0 AND c_mktsegment ILIKE 'b%' THEN 0.0 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 AND c_mktsegment ILIKE 'b%' THEN 'debtor' ELSE 'plain' END AS rank FROM customer",
    "write_upsert": "SELECT c_custkey AS key, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'works' ELSE 'plain' END AS rank FROM customer UNION ALL SELECT -1, NULL, 'new'",
    "write_delete": "SELECT c_custkey AS key FROM customer WHERE NOT (c_acctbal < 1000 OR c_custkey % 4 = 3)",
    "write_upsert_by_key": "SELECT CAST(coalesce(n_nationkey, k) AS BIGINT) AS key, coalesce(r_name, n_name) AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation FULL JOIN (SELECT 5 * r_regionkey + 10 AS k, r_name FROM region) ON n_nationkey = k",
    "write_batch": "SELECT key, name, CASE WHEN region IN (9, 1) THEN 7 ELSE region END AS region FROM (SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL SELECT 100, 'sea', 9 UNION ALL SELECT 101, 'sky', 9) WHERE NOT (region IN (9, 1, 7) AND key % 2 = 1)",
    "constraint_unique": "SELECT true AS refused, count(*) AS n FROM nation",
    "constraint_foreign_key": "SELECT n_name AS nation_name, count(*) AS n, true AS lost_refused, true AS gone_refused FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "migration": "SELECT c_custkey AS key, c_mktsegment AS market, CAST(3 AS BIGINT) AS visits FROM customer",
    "changes_feed": "WITH n AS (SELECT count(*) AS c, count(*) FILTER (WHERE c_acctbal < 0) AS u, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS d FROM customer) SELECT 'insert' AS kind, c AS n, 1 AS first, c AS last, c AS rows, 1 AS commits FROM n UNION ALL SELECT 'update', u, c + 1, c + u, u, 1 FROM n UNION ALL SELECT 'delete', d, c + u + 1, c + u + d, d, 1 FROM n",
    "changes_page": "SELECT i AS seq, i AS row_id, 'insert' AS kind FROM range(1, 151) t(i) WHERE i <= (SELECT count(*) FROM customer)",
    "read_rows_page": f"SELECT id, key, name, (SELECT count(*) FROM customer) > 150 AS more FROM ({_IDS}) WHERE id > 50 AND id <= 150",
    "read_rows_by_id": f"SELECT id, key, name FROM ({_IDS}) WHERE id IN (3, 77, 78)",
    "namespace_sql": "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment",
    "json_field": "SELECT event_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "namespace_vectors": f"SELECT vec_id AS key, round({_COSINE}, 9) AS score FROM embeddings WHERE label IN (2, 4) ORDER BY {_COSINE} DESC, vec_id LIMIT 50",
    "relations": "SELECT 'lies' AS relation, 'nations' AS source_table, CAST(n_nationkey + 1 AS BIGINT) AS source_id, 'regions' AS target_table, CAST(n_regionkey + 1 AS BIGINT) AS target_id FROM nation",
}
