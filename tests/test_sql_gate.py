"""The SQL gate: what it lets through and what it refuses."""

import pytest

from millrace.plans import sql

FILE = "/root/testdata/sf0.001/region.parquet"


@pytest.fixture(scope="module")
def tables(spark):
    return {"pots": spark.createDataFrame([(1, "red", [1, 2]), (2, "blue", [3])], "id long, glaze string, sizes array<int>"), "kilns": spark.range(3)}


REFUSED = [
    f"SELECT * FROM IDENTIFIER('parquet.`{FILE}`')",
    f"WITH x AS (SELECT * FROM IDENTIFIER('parquet.`{FILE}`')) SELECT * FROM x",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT IDENTIFIER('gl' || 'aze') FROM pots",
    f"SELECT * FROM parquet.`{FILE}`",
    f"SELECT (SELECT count(*) FROM parquet.`{FILE}`)",
    f"SELECT * FROM pots WHERE id IN (SELECT r_regionkey FROM parquet.`{FILE}`)",
    f"SELECT * FROM pots WHERE EXISTS (SELECT 1 FROM csv.`{FILE}`)",
    f"SELECT * FROM pots, LATERAL (SELECT * FROM text.`{FILE}`)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.Runtime', 'getRuntime')",
    "SELECT try_reflect('java.lang.System', 'getenv')",
    "SELECT max(reflect('java.lang.System', 'getenv')) OVER (PARTITION BY id) FROM pots",
    "SELECT transform(sizes, x -> java_method('java.lang.Math', 'abs', x)) FROM pots",
    "SELECT system.builtin.reflect('java.lang.System', 'getenv')",
    "SELECT input_file_name() FROM pots", "SELECT current_user()", "SELECT version()", "SELECT current_database()", "SELECT user", "SELECT uuid()", "SELECT raise_error('x')", "SELECT spark_partition_id() FROM pots",
    "SELECT a_registered_function(id) FROM pots", "SELECT nothing_like_this(id) FROM pots",
    "SELECT * FROM spark_catalog.default.pots", "SELECT * FROM global_temp.pots", "SELECT * FROM outsider", "SELECT * FROM a_view_of_the_session",
    "SELECT * FROM python_worker_logs()", "SELECT * FROM sql_keywords()", "SELECT * FROM collations()", "SELECT * FROM read_files('/root')",
    "SELECT /*+ REPARTITION(100000) */ * FROM pots", "SELECT TRANSFORM(id) USING 'cat' FROM pots",
    "FROM pots SELECT *", "TABLE pots", "SHOW TABLES", "DESCRIBE pots", "SET spark.x = 1", "SET", "EXPLAIN SELECT 1", "CREATE TABLE x AS SELECT 1", "CREATE TEMPORARY VIEW x AS SELECT 1", "INSERT INTO pots SELECT * FROM pots",
    "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1", "WITH x AS (SELECT 1) INSERT INTO pots SELECT * FROM x", "DROP TABLE pots", "CACHE TABLE pots", "ADD JAR 'x.jar'", "REFRESH TABLE pots", "USE default",
    "SELECT 1; SELECT 2", "EXECUTE IMMEDIATE 'SELECT 1'", "DECLARE x INT", "BEGIN SELECT 1; END", "SELECT * FROM pots VERSION AS OF 1", "", "SELECT", "SELECT a AS x, b AS X FROM (SELECT 1 AS a, 2 AS b)",
    "SELECT * FROM x WITH x AS (SELECT 1)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, tables, text):
    spark.udf.register("a_registered_function", lambda x: str(x))
    spark.range(1).createOrReplaceTempView("a_view_of_the_session")
    with pytest.raises(sql.QueryError):
        sql.statement(spark, text, tables)


ANSWERED = [
    ("SELECT id, upper(glaze) AS g FROM pots WHERE id BETWEEN 1 AND 2 AND glaze LIKE 'r%' ESCAPE '/'", [(1, "RED")]),
    ("WITH a AS (SELECT 1 AS n), b AS (SELECT n + 1 AS n FROM a) SELECT n FROM b UNION ALL SELECT n FROM a ORDER BY n", [(1,), (2,)]),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT sum(n) AS s FROM r", [(10,)]),
    ("SELECT p.id, s.size FROM pots p, LATERAL (SELECT explode(p.sizes) AS size) s ORDER BY 2", [(1, 1), (1, 2), (2, 3)]),
    ("SELECT id, rank() OVER (ORDER BY id DESC) AS r FROM pots WHERE id IN (SELECT id FROM kilns) ORDER BY id", [(1, 2), (2, 1)]),
    ("SELECT count(*) FILTER (WHERE id > 1) AS n, count(DISTINCT glaze) AS d, listagg(glaze, ',') WITHIN GROUP (ORDER BY glaze) AS g FROM pots", [(1, 2, "blue,red")]),
    ("SELECT CASE id WHEN 1 THEN CAST(id AS STRING) ELSE substring(glaze, 1, 2) END AS c, trim(both 'r' FROM glaze) AS t, aggregate(sizes, 0, (a, x) -> a + x) AS s FROM pots ORDER BY id", [("1", "ed", 3), ("bl", "blue", 3)]),
    ("SELECT glaze, count(*) AS n FROM pots GROUP BY ROLLUP (glaze) HAVING count(*) > 1", [(None, 2)]),
    ("SELECT -id AS a, ~1 AS b, 7 DIV 2 AS c, id <=> NULL AS d, (SELECT max(id) FROM kilns) AS e, id IS NULL AS f FROM pots WHERE NOT (id <> 1)", [(-1, -2, 3, False, 2, False)]),
    ("SELECT * FROM (VALUES (1, 'x')) AS v(a, b) JOIN range(2) r ON r.id = v.a", [(1, "x", 1)]),
    ("SELECT typeof(parse_json('[1]')) AS t, to_json(parse_json('[1]')) AS j", [("variant", "[1]")]),
]


@pytest.mark.parametrize("text, rows", ANSWERED)
def test_answered(spark, tables, text, rows):
    assert [tuple(r) for r in sql.statement(spark, text, tables).collect()] == rows


def test_nothing_is_left_behind(spark, tables):
    before = {t.name for t in spark.catalog.listTables()} | {t.name for t in spark.catalog.listTables("global_temp")}
    sql.statement(spark, "SELECT * FROM pots", tables).collect()
    assert {t.name for t in spark.catalog.listTables()} | {t.name for t in spark.catalog.listTables("global_temp")} == before


def test_second_gate_looks_at_what_is_read(spark, tables):
    with pytest.raises(sql.QueryError):
        sql._given(spark.read.parquet(FILE), tables)
    sql._given(tables["pots"].join(tables["kilns"], "id"), tables)
