"""Queries over whole tables: nothing is left out by an id, and small fixtures against brute force."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import fulltext, graph, suite
from millrace.operators.native import fresh
from millrace.sources.catalog import Conflict
from millrace.sources.schema import Constraint, Field, SchemaError, TableSchema
from millrace.streaming import changes


def tables(spark, folder, **found):
    for name, (rows, schema) in found.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_reach_of_every_order(spark, tmp_path):
    orders = [(k * 40, k % 7) for k in range(1, 31)]
    customers, nations = [(k, k % 3) for k in range(9)], [(0, 1), (1, 1), (2, 4)]
    sf = tables(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"), customer=(customers, "c_custkey long, c_nationkey int"), nation=(nations, "n_nationkey int, n_regionkey int"))
    c = {k for _, k in orders}
    n = {v for k, v in customers if k in c}
    want = {("orders", k, 0) for k, _ in orders} | {("customer", k, 1) for k in c} | {("nation", k, 2) for k in n} | {("region", r, 3) for k, r in nations if k in n}
    got = [tuple(r) for r in suite.QUERIES["graph_reach"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_reach_keeps_partitions_small(spark):
    """Rows of nodes are a few bytes each in a shuffle, so that partitions by bytes held all of them; half of the edges lead to one node."""
    rows = 1_200_000
    orders = spark.range(rows)
    edges = orders.select(
        F.lit("places").alias("relation"), "id", F.lit("orders").alias("source_table"), F.col("id").alias("source_id"), F.lit("customer").alias("target_table"),
        F.expr("if(id % 2 = 0, 0, id div 10)").alias("target_id"), F.lit("places").alias("type"),
    )
    got = graph.reach(edges, orders.select(F.lit("orders").alias("table"), "id"), 2)
    each = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == rows + rows // 10 and max(each) <= 1 << 18
    assert [tuple(r) for r in got.groupBy("table", "hops").count().orderBy("hops").collect()] == [("orders", 0, rows), ("customer", 1, rows // 10)]


def test_append_of_a_data_frame(spark):
    ns = fresh(spark)
    ns.create_table("pots", TableSchema([Field("name", "string", required=True), Field("glaze", "string", enum=["red", "blue"]), Field("v", "vector", dim=2), Field("n", "number", default=7)], constraints=[Constraint("one", "unique", ["name"])]))
    rows = spark.range(5000).repartition(7).selectExpr("concat('pot', id) AS name", "if(id % 2 = 0, 'red', null) AS glaze", "array(id, 1.5) AS v")
    assert ns.append("pots", rows) == 5000 and ns.append("pots", rows.limit(0)) == 0
    got = ns.table("pots")
    assert sorted(r.id for r in got.select("id").collect()) == list(range(1, 5001)) and got.where("n.i = 7").count() == 5000
    one = "SELECT 'x' AS name, "
    for bad in ("SELECT cast(null AS string) AS name", one + "'green' AS glaze", one + "array(1.0) AS v", one + "array(1.0, null) AS v", one + "array(1.0, double('nan')) AS v"):
        with pytest.raises(ValueError):
            ns.append("pots", spark.sql(bad))
    for bad in ("SELECT 1 AS name", one + "1 AS nothing", one + "true AS n"):
        with pytest.raises(SchemaError):
            ns.append("pots", spark.sql(bad))
    with pytest.raises(Conflict):
        ns.append("pots", rows.limit(3))
    assert ns.describe_table("pots")["rows"] == 5000
    log = changes.log(ns)
    assert sorted(r.seq for r in log.collect()) == list(range(1, 5001)) and log.where("seq <> row_id").count() == 0


def test_subscribers_see_committed_changes_only(spark, tmp_path):
    ns, seen = fresh(spark), []
    ns.create_table("notes", TableSchema([Field("a", "string")]))
    ns.insert("notes", [{"a": "x"}])
    from millrace.sources.catalog import Transaction

    late = Transaction(ns)
    late.append("notes", [{"a": "lost"}], changes.Scope())
    ns.insert("notes", [{"a": "y"}])
    with pytest.raises(Conflict):
        late.commit()

    def run():
        changes.subscribe(ns, lambda df, k: seen.extend((r.seq, r.row_id) for r in df.orderBy("seq").collect()), f"{tmp_path}/checkpoint", once=True).awaitTermination()

    run()
    assert seen == [(1, 1), (2, 2)]
    ns.files.delete(f"feed/{ns.manifest()['change_folders'][-1].partition('/')[2]}")  # as if the writer had died before its marker
    ns.update("notes", "a = 'x'", {"a": "z"})
    run()
    assert (3, 1) in seen
    assert ns.vacuum() == 0 and ns.vacuum(grace=0) > 0 and ns.describe_table("notes")["rows"] == 2
    assert sorted(r.a for r in ns.table("notes").collect()) == ["y", "z"]


def test_search_holds_few_texts_at_once(spark):
    """A batch of 20 MB is taken in slices, and Spark sends batches of 4 MB, unless the session has its own setting."""
    texts = pa.array([f"thunder {k} " + "rolling on the hills " * 100 for k in range(10_000)])
    batch = pa.StructArray.from_arrays([texts], ["0"])
    of = fulltext.profile([fulltext.Term("thunder"), fulltext.Term("hil", True)], [fulltext.Phrase(("the", "hills"))], False).func
    tracemalloc.start()
    try:
        got = list(of(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < texts.nbytes / 2
    finally:
        tracemalloc.stop()
    assert [len(x) for x in got] == [10_000] and got[0][9_999].as_py() == {"length": 402, "counts": [1, 100], "phrases": [True]}
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        rows = spark.createDataFrame([(1, "rolling thunder"), (2, None), (3, "thunder, Rolling")], "id long, text string")
        assert [r.id for r in fulltext.search(rows, '"rolling thunder"', ["text"], stemming=False).collect()] == [1]
        assert int(spark.conf.get(key)) == 4 << 20
    finally:
        spark.conf.set(key, own)
