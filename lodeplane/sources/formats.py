"""Readers and writers of text formats: coverage, unified differences, API descriptions, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, *, endings: tuple[str, ...] = (), ignore: str = r"(^|/)(node_modules|\.git|dist|build|\.venv)/", max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """``path, hash, mtime, content`` of the files under a folder; larger files keep a null content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_extract("path", r"\Q" + root.rstrip("/") + r"/\E(.*)$", 1)
    out = f.select(rel.alias("path"), F.sha2("content", 256).alias("hash"), (F.col("modificationTime").cast("double") * 1000).alias("mtime"), F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")).alias("content"))
    if endings:
        out = out.where(F.col("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    return out.where(~F.col("path").rlike(ignore))


def lcov(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """LCOV reports: files with line and branch rates, and functions with hits; records end with ``end_of_record`` and
    share nothing. A record is a list element, so no ordering over the table is needed."""
    records = texts.select(key, F.explode(F.split(text, r"end_of_record\r?\n?")).alias("r")).where(F.col("r").contains("SF:"))
    num = lambda tag: F.regexp_extract("r", rf"(?m)^{tag}:(\d+)", 1).try_cast("double")
    rate = lambda h, f: F.coalesce(F.try_divide(num(h), num(f)), F.lit(0.0))
    path = F.regexp_extract("r", r"(?m)^SF:(.*?)\r?$", 1)
    files = records.select(key, path.alias("path"), rate("LH", "LF").alias("line_rate"), rate("BRH", "BRF").alias("branch_rate"))
    fn = F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^FNDA:(\d+,[^\r\n]+)"), 1))
    functions = records.select(key, path.alias("path"), fn.alias("f")).select(key, "path", F.substring_index("f", ",", 1).cast("int").alias("hits"), F.regexp_replace("f", r"^\d+,", "").alias("name"))
    return files, functions


def istanbul(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Coverage summaries in JSON: line rate per file, the total left out, 0 where nothing is to cover."""
    part = "struct<total:double,covered:double>"
    m = F.from_json(text, f"map<string,struct<lines:{part},branches:{part}>>")
    rate = lambda c: F.coalesce(F.try_divide(F.col(f"v.{c}.covered"), F.col(f"v.{c}.total")), F.lit(0.0))
    return texts.select(key, F.explode(m).alias("path", "v")).where("path <> 'total'").select(key, "path", rate("lines").alias("line_rate"), rate("branches").alias("branch_rate"))


def unified_diff(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, line``: the lines of the new side that a unified difference shows, added or context."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "l"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("l").startswith("+++ "), F.regexp_replace("l", r"^\+\+\+ (b/)?", "")), True).over(w)
    hunk = F.regexp_extract("l", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    start = F.last(F.when(F.col("l").startswith("@@ "), F.struct(hunk.cast("int").alias("at"), F.col("pos").alias("p"))), True).over(w)
    seen = lines.select(key, "pos", "l", path.alias("path"), start.alias("h")).where("h is not null and pos > h.p")
    right = seen.where(F.col("l").rlike(r"^[ +]") & ~F.col("l").startswith("+++ ") | (F.col("l") == ""))
    in_hunk = Window.partitionBy(key, "path", "h.p").orderBy("pos")
    return right.where("l <> ''").select(key, "path", (F.col("h.at") + F.row_number().over(in_hunk) - 1).alias("line"))


def openapi(apis: DataFrame, group: str) -> DataFrame:
    """One OpenAPI document in JSON per group out of ``method, route, handler_name``; a description is one document."""
    op = F.struct(F.lower("method").alias("method"), F.col("route").alias("route"), F.coalesce("handler_name", F.lit("")).alias("operationId"))
    per = apis.where("method is not null and route is not null").groupBy(group).agg(F.array_sort(F.collect_set(op)).alias("ops"))
    return per.select(group, F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.struct(F.col(group).alias("title")).alias("info"), F.col("ops").alias("x-operations"))).alias("document"))


def openapi_operations(docs: DataFrame, group: str, document: str = "document") -> DataFrame:
    """Operations of descriptions: of standard ``paths`` and of the list written by ``openapi``."""
    own = F.from_json(F.get_json_object(document, "$['x-operations']"), "array<struct<method:string,route:string,operationId:string>>")
    std = F.from_json(F.get_json_object(document, "$.paths"), "map<string,map<string,struct<operationId:string>>>")
    a = docs.select(group, F.explode(own).alias("o")).select(group, F.upper("o.method").alias("method"), "o.route", F.col("o.operationId").alias("operation"))
    b = docs.select(group, F.explode(std).alias("route", "m")).select(group, "route", F.explode("m").alias("method", "o")).select(group, F.upper("method").alias("method"), "route", F.col("o.operationId").alias("operation"))
    return a.unionByName(b)


def markdown(rows: DataFrame, group: str, title: Column, line: Column, order: Column) -> DataFrame:
    """A Markdown section per group: a heading and one bullet per row, sorted."""
    per = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("x"))
    return per.select(group, F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform("x", lambda s: F.concat(F.lit("- "), s["l"])), "\n"), F.lit("\n")).alias("markdown"))


def suffix_resolved(names: DataFrame, name: str, files: DataFrame, path: str) -> DataFrame:
    """Each name with the shortest path that ends with it at a segment border, by an equi-join on suffixes."""
    from lodeplane.functions.paths import suffixes

    s = files.select(F.col(path).alias("_path"), F.explode(suffixes(path)).alias("_s"))
    best = F.min(F.when(F.col("_path").isNotNull(), F.struct(F.length("_path").alias("n"), F.col("_path").alias("p")))).alias("b")
    return names.select(name).distinct().join(s, F.col(name) == F.col("_s"), "left").groupBy(name).agg(best).select(name, F.col("b.p").alias("resolved"))
