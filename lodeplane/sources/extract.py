"""Rows out of source text: routes, imports, symbols, calls, tables, settings, URLs, repositories.

Everything that a pattern can tell is a table of (language, pattern) applied by built-in functions in the scan's own
stage; Python symbols and calls need a parser and run in Arrow batches.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeplane.functions import paths

#: Patterns of route declarations: language, pattern with method and route as groups (fixed values).
ROUTES = (
    ("javascript", r"(?:router|app|server)\.(get|post|put|patch|delete)\(\s*[\"'`]([^\"'`\n]+)"),
    ("typescript", r"(?:router|app|server)\.(get|post|put|patch|delete)\(\s*[\"'`]([^\"'`\n]+)"),
    ("python", r"@(?:router|app|api)\.(get|post|put|patch|delete)\(\s*[\"']([^\"'\n]+)"),
    ("java", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*\"([^\"\n]+)\""),
)
#: Patterns of imports: language, pattern with the source as group.
IMPORTS = (
    ("javascript", r"(?m)^\s*(?:import|export)\b[^;\n]*?from\s+[\"']([^\"'\n]+)[\"']"),
    ("typescript", r"(?m)^\s*(?:import|export)\b[^;\n]*?from\s+[\"']([^\"'\n]+)[\"']"),
    ("python", r"(?m)^(?:from\s+(\.*[\w.]*)\s+import|import\s+[\w.]+)"),
    ("java", r"(?m)^import\s+(?:static\s+)?([\w.*]+);"),
    ("go", r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"\s*$"),
)


def _all(text: str, table: tuple, group: int) -> Column:
    lang = paths.language("path")
    out = None
    for language, pattern in table:
        hit = F.regexp_extract_all(text, F.lit(pattern), group)
        out = F.when(lang == language, hit) if out is None else out.when(lang == language, hit)
    return out.otherwise(F.array().cast("array<string>"))


def routes(files: DataFrame, text: str = "content") -> DataFrame:
    """``repo_id, path, pos, method, route``: route declarations in the order they occur."""
    pairs = F.arrays_zip(_all(text, ROUTES, 1).alias("m"), _all(text, ROUTES, 2).alias("r"))
    x = files.where(F.col(text).isNotNull()).select("repo_id", "path", F.posexplode(pairs).alias("pos", "x"))
    return x.select("repo_id", "path", "pos", F.upper("x.m").alias("method"), F.col("x.r").alias("route"))


def first_routes(found: DataFrame) -> DataFrame:
    """The first declaration of each method and route in a file."""
    return found.groupBy("repo_id", "path", "method", "route").agg(F.min("pos").alias("pos"))


def imports(files: DataFrame, text: str = "content") -> DataFrame:
    x = files.where(F.col(text).isNotNull()).select("repo_id", "path", F.explode(_all(text, IMPORTS, 1)).alias("source"))
    return x.where("source <> ''").distinct()


def resolved_imports(found: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("ts", "js", "mjs", "py")) -> DataFrame:
    """Relative imports with the file they name: each ending in order, then an index file; the first that exists."""
    rel = found.where(F.col("source").startswith("."))
    base = paths.resolved(paths.dirname("path"), F.col("source"))
    tries = F.array(*[F.concat(base, F.lit(s)) for s in ("", *(f".{e}" for e in endings), *(f"/index.{e}" for e in endings))])
    c = rel.select("repo_id", "path", "source", F.posexplode(tries).alias("rank", "target"))
    hit = c.join(files.select("repo_id", F.col("path").alias("target")).distinct(), ["repo_id", "target"], "left_semi")
    return hit.groupBy("repo_id", "path", "source").agg(F.min(F.struct("rank", "target")).alias("b")).select("repo_id", "path", "source", F.col("b.target").alias("target"))


def schema_tables(files: DataFrame, text: str = "content") -> DataFrame:
    """Tables declared in SQL files and the number of their columns."""
    p = r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(([^;]*)\)\s*;"
    x = files.where(F.col("path").endswith(".sql")).select("repo_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("n"), F.regexp_extract_all(text, F.lit(p), 2).alias("c"))).alias("t"))
    return x.select("repo_id", "path", F.lower("t.n").alias("name"), F.size(F.split("t.c", ",")).alias("columns"))


def settings(files: DataFrame, text: str = "content") -> DataFrame:
    """Top-level keys and scalar values of YAML files."""
    p = r"(?m)^([A-Za-z_][\w-]*):[ \t]+([^\s#][^\n#]*?)[ \t\r]*$"
    x = files.where(F.col("path").rlike(r"\.ya?ml$") & F.col(text).isNotNull()).select("repo_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("k"), F.regexp_extract_all(text, F.lit(p), 2).alias("v"))).alias("e"))
    return x.select("repo_id", "path", F.col("e.k").alias("key"), F.col("e.v").alias("value"))


def headings(files: DataFrame, text: str = "content") -> DataFrame:
    """Headings of Markdown files with their level."""
    p = r"(?m)^(#{1,6})[ \t]+([^\n\r]+?)[ \t\r]*$"
    x = files.where(F.col("path").endswith(".md") & F.col(text).isNotNull()).select("repo_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("h"), F.regexp_extract_all(text, F.lit(p), 2).alias("t"))).alias("e"))
    return x.select("repo_id", "path", F.length("e.h").alias("level"), F.col("e.t").alias("title"))


def urls(files: DataFrame, text: str = "content") -> DataFrame:
    """Hosts of absolute URLs named in files."""
    h = F.regexp_extract_all(text, F.lit(r"https?://([A-Za-z0-9.-]+)"), 1)
    return files.where(F.col(text).isNotNull()).select("repo_id", "path", F.explode(F.array_distinct(h)).alias("host"))


def detected_roots(files: DataFrame, markers: tuple[str, ...] = ("package.json", "go.mod", "pom.xml", "pyproject.toml", ".npmrc", "package-lock.json", ".env")) -> DataFrame:
    """Directories that a marker file makes a root of their own, with the markers found."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.isin(*markers)).groupBy("repo_id", paths.dirname("path").alias("root")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("markers"))


def python_symbols(files: DataFrame, text: str = "content") -> DataFrame:
    """``repo_id, path, name, kind, line, calls`` of functions and classes in Python files that parse."""
    slim = files.where(F.col("path").endswith(".py") & F.col(text).isNotNull()).select("repo_id", "path", F.col(text).alias("text"))

    def visit(node: ast.AST, out: list) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                calls = sorted({c.func.id for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)}) if kind == "function" else []
                out.append((child.name, kind, child.lineno, calls))
            visit(child, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    try:
                        found: list = []
                        visit(ast.parse(t.lstrip("﻿")), found)
                    except (SyntaxError, ValueError, RecursionError):
                        continue
                at += [i] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("repo_id").take(take), batch.column("path").take(take), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string()))], names=["repo_id", "path", "name", "kind", "line", "calls"])

    return slim.mapInArrow(run, "repo_id string, path string, name string, kind string, line int, calls array<string>")


def call_edges(symbols: DataFrame) -> DataFrame:
    """Calls of functions of the same file (confidence 0.85) or, where a name is unique in the repository, of another
    file (0.7): ``repo_id, caller_path, caller, callee_path, callee, confidence``."""
    f = symbols.where("kind = 'function'").select("repo_id", "path", "name", "calls").dropDuplicates(["repo_id", "path", "name"])
    want = f.select("repo_id", F.col("path").alias("caller_path"), F.col("name").alias("caller"), F.explode("calls").alias("callee")).where("caller <> callee")
    by_name = f.select("repo_id", F.col("name").alias("callee"), F.col("path").alias("callee_path"))
    lone = by_name.withColumn("n", F.count("*").over(Window.partitionBy("repo_id", "callee"))).where("n = 1").drop("n")
    here = want.join(by_name, ["repo_id", "callee"]).where("caller_path = callee_path").withColumn("confidence", F.lit(0.85))
    there = want.join(lone, ["repo_id", "callee"]).where("caller_path <> callee_path").withColumn("confidence", F.lit(0.7))
    cols = ["repo_id", "caller_path", "caller", "callee_path", "callee", "confidence"]
    return here.select(*cols).unionByName(there.select(*cols))
