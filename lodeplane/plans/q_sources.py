"""Queries: readers and writers of text formats (s). Reports are written out of whole tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeplane.plans.common import apis, collect, files, sql_apis, sql_files
from lodeplane.sources import formats
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}


def s9_lcov(spark, d):
    """A coverage report per order, a record per line with one function: line rate and hits come back."""
    rec = F.concat(F.lit("SF:part_"), F.col("l_partkey").cast("string"), F.lit("\nFN:1,f"), F.col("l_linenumber").cast("string"), F.lit("\nFNDA:"), F.col("l_quantity").cast("int").cast("string"), F.lit(",f"), F.col("l_linenumber").cast("string"), F.lit("\nLH:"), F.col("l_linenumber").cast("string"), F.lit("\nLF:8\nend_of_record\n"))
    texts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(rec), "").alias("text"))
    f, fn = formats.lcov(texts, "l_orderkey", "text")
    a = f.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.round(F.sum("line_rate"), 6).alias("rates"))
    return a.join(fn.groupBy("l_orderkey").agg(F.sum("hits").alias("hits")), "l_orderkey")


SQL["s9_lcov"] = "SELECT l_orderkey, count(*) AS files, round(sum(l_linenumber / 8.0), 6)::DOUBLE AS rates, sum(CAST(trunc(l_quantity) AS BIGINT)) AS hits FROM lineitem GROUP BY 1"


def s10_istanbul(spark, d):
    """A summary per customer with one file per order, the total left out."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.struct(F.struct(F.lit(10.0).alias("total"), F.pmod("o_orderkey", F.lit(11)).cast("double").alias("covered")).alias("lines"))))).alias("m"))
    texts = n.select("o_custkey", F.to_json(F.map_concat("m", F.create_map(F.lit("total"), F.struct(F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("covered")).alias("lines"))))).alias("text"))
    return formats.istanbul(texts, "o_custkey", "text").groupBy("o_custkey").agg(F.count("*").alias("files"), F.round(F.sum("line_rate"), 6).alias("rates"))


SQL["s10_istanbul"] = "SELECT o_custkey, count(*) AS files, round(CAST(sum((o_orderkey % 11) / 10.0) AS DOUBLE), 6) AS rates FROM orders GROUP BY 1"


def s11_unified_diff(spark, d):
    """A difference per order that adds one line per item after a context line: the commentable lines come back."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("+item "), n.cast("string"))), "\n")
    texts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("--- a/o\n+++ b/o\n@@ -4,1 +5,9 @@\n context\n-gone\n"), body).alias("text"))
    return formats.unified_diff(texts, "l_orderkey", "text").groupBy("l_orderkey", "path").agg(F.count("*").alias("lines"), F.max("line").alias("last"))


SQL["s11_unified_diff"] = "SELECT l_orderkey, 'o' AS path, count(*) + 1 AS lines, 5 + count(*) AS last FROM lineitem GROUP BY 1"


def s15_import_openapi(spark, d):
    """Descriptions written and read back: operations per repository and method."""
    ops = formats.openapi_operations(formats.openapi(apis(spark, d), "repo_id"), "repo_id")
    return ops.groupBy("repo_id", "method").agg(F.count("*").alias("operations"))


SQL["s15_import_openapi"] = f"WITH {sql_apis()} SELECT repo_id, upper(method) AS method, count(DISTINCT struct_pack(r := route, h := coalesce(handler_name, ''))) AS operations FROM w WHERE method IS NOT NULL AND route IS NOT NULL GROUP BY 1, 2"


def s16_markdown(spark, d):
    line = F.concat_ws(" ", F.upper("method"), "route")
    return formats.markdown(apis(spark, d).where("method is not null and route is not null"), "repo_id", F.col("repo_id"), line, line)


SQL["s16_markdown"] = f"WITH {sql_apis()}, l AS (SELECT repo_id, upper(method) || ' ' || route AS x FROM w WHERE method IS NOT NULL AND route IS NOT NULL) SELECT repo_id, '## ' || repo_id || chr(10) || chr(10) || string_agg('- ' || x, chr(10) ORDER BY x) || chr(10) AS markdown FROM l GROUP BY 1"


def s17_suffix_resolved(spark, d):
    """Bare file names resolved to the shortest path that ends with them."""
    f = files(spark, d)
    names = f.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    r = formats.suffix_resolved(names, "name", f.select("path").distinct(), "path")
    return r.groupBy(F.length("resolved").alias("length")).agg(F.count("*").alias("n"))


SQL["s17_suffix_resolved"] = f"WITH {sql_files()}, n AS (SELECT regexp_replace(path, '^.*/', '') AS name, min(length(path)) AS length FROM f GROUP BY 1) SELECT length, count(*) AS n FROM n GROUP BY 1"

QUERIES, ORACLE = collect(globals(), SQL)
