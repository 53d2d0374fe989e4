"""The guarded endpoint: what it lets through and what it refuses."""

import pytest

from lodeplane.sql import describe, safe_sql


@pytest.fixture(scope="module")
def tables(spark):
    return {"apis": spark.range(5).selectExpr("id", "cast(id as string) as name"), "files": spark.range(3).selectExpr("id")}


@pytest.mark.parametrize("sql", ["", "   ", "x" * 4001, "DROP TABLE apis", "INSERT INTO apis VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM apis, secrets", "SELECT * FROM apis WHERE id IN (SELECT id FROM secrets)", "WITH t AS (SELECT * FROM secrets) SELECT * FROM t", "SELECT reflect('java.lang.System', 'getenv')", "SHOW TABLES", "SET x = 1", "SELEC 1", "SELECT * FROM range(5)"])
def test_refused(spark, tables, sql):
    r = safe_sql(spark, sql, tables)
    assert r.error and not r.rows


@pytest.mark.parametrize("sql,n", [("SELECT * FROM apis;", 5), ("select replace(name, '1', 'DROP; x') as n from apis", 5), ("WITH apis2 AS (SELECT id FROM apis) SELECT count(*) AS n FROM apis2", 1), ("SELECT a.id FROM apis a JOIN files f USING (id)", 3), ("SELECT id FROM apis WHERE EXISTS (SELECT 1 FROM files WHERE files.id = apis.id)", 3)])
def test_allowed(spark, tables, sql, n):
    r = safe_sql(spark, sql, tables)
    assert r.error is None and len(r.rows) == n


def test_cap_and_columns(spark, tables):
    r = safe_sql(spark, "SELECT id FROM (SELECT id FROM apis LIMIT 5) t", tables, limit=2)
    assert len(r.rows) == 2 and r.truncated and r.columns == ["id"]
    assert safe_sql(spark, "SELECT id FROM apis WHERE false", tables).columns == ["id"]
    assert safe_sql(spark, "SELECT nothing FROM apis", tables).error
    assert {"table": "files", "column": "id", "type": "bigint", "nullable": False} in describe(tables)
