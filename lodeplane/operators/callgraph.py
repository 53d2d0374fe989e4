"""Functions, calls and the call graph of source files in five languages, by lines, in built-in expressions.

A file is split into lines once; each line gives the function that it defines and the names that it calls. The function around a
line is the last one defined at or before it in its file. Windows never reach beyond a file. Files larger than memory are
none in practice; a line is the unit of work.

Calls resolve within their file first; else to functions of that name in other files of the repository whose module the
calling file imports. Names that more than ``MANY`` files define are left unresolved. The confidence says how it was done.
Defined results: null contents, paths and languages without rules give no rows; equal rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings of paths by language (fixed values).
SCRIPT, OTHER = r"\.(js|mjs|cjs|jsx|ts|tsx)$", r"\.(py|go|java)$"
#: The function that a line defines, by language.
DEFINES = {
    r"\.py$": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    r"\.go$": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]",
    r"\.java$": r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;=]*$",
    SCRIPT: r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>)|^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*\([^(){};]*\)\s*(?::\s*[^{=]+)?\{\s*$",
}
#: Words before a bracket that call nothing (fixed values).
KEYWORDS = "if for while switch catch return function def func with elif and or not in is lambda print assert del raise except yield await new typeof instanceof super this class range len constructor".split()
CALLED = r"([A-Za-z_]\w*)\s*\("
IMPORTED = r"(?:from|import|require\()\s*[\"'(]?\s*([\w./@-]+)|from\s+[\"']([\w./@-]+)"
MANY = 20


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """``repo_id, path, line, src``: the lines of source files, counted from 1."""
    known = files.where(F.col(text).isNotNull() & (F.col("path").rlike(SCRIPT) | F.col("path").rlike(OTHER)))
    return known.select("repo_id", "path", F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line", "src")).withColumn("line", F.col("line") + 1)


def defined(path: Column | str, src: Column | str) -> Column:
    """The name of the function that a line defines, null if it defines none."""
    path, out = F.col(path) if isinstance(path, str) else path, F
    for ending, rule in DEFINES.items():
        groups = [F.regexp_extract(src, rule, i) for i in range(1, 4 if ending == SCRIPT else 2)]
        out = out.when(path.rlike(ending), F.concat(*groups))
    name = out.otherwise(F.lit(""))
    return F.when((name != "") & ~name.isin(*KEYWORDS), name)


def functions(files: DataFrame) -> DataFrame:
    """``repo_id, path, name, line`` of the functions defined, each at its first line in a file."""
    f = lines(files).select("repo_id", "path", "line", defined("path", "src").alias("name")).where("name is not null")
    return f.groupBy("repo_id", "path", "name").agg(F.min("line").alias("line"))


def calls(files: DataFrame) -> DataFrame:
    """``repo_id, path, line, caller, callee``: names called in lines, under the function around the line."""
    all_lines = lines(files).select("repo_id", "path", "line", defined("path", "src").alias("name"), F.regexp_extract_all("src", F.lit(CALLED), 1).alias("called"))
    around = F.last("name", ignorenulls=True).over(Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = all_lines.where("name is not null or size(called) > 0").select("repo_id", "path", "line", "name", around.alias("caller"), F.explode("called").alias("callee"))
    return placed.where(~F.col("callee").isin(*KEYWORDS) & F.col("caller").isNotNull() & (F.coalesce("name", F.lit("")) != F.col("callee"))).select("repo_id", "path", "line", "caller", "callee")


def modules(files: DataFrame) -> DataFrame:
    """``repo_id, path, module``: the last segments of the modules that files import."""
    found = lines(files).where(F.col("src").rlike(r"^\s*(import|from|export)\b|require\(")).select("repo_id", "path", F.regexp_extract("src", IMPORTED, 1).alias("a"), F.regexp_extract("src", r"from\s+[\"']([\w./@-]+)", 1).alias("b"))
    last = F.regexp_extract(F.when(F.col("b") != "", F.col("b")).otherwise(F.col("a")), r"([\w-]+)$", 1)
    return found.select("repo_id", "path", last.alias("module")).where("module <> ''").distinct()


def call_graph(files: DataFrame) -> DataFrame:
    """``repo_id, src, dst, confidence, kind``: edges between functions named ``path::name``; the best edge of a pair counts."""
    f = functions(files).select("repo_id", F.col("path").alias("target"), F.col("name").alias("callee"))
    c = calls(files).select("repo_id", "path", "caller", "callee").distinct()
    here = c.join(f, ["repo_id", "callee"]).where("path = target").withColumn("confidence", F.when(F.col("path").rlike(SCRIPT), 0.9).otherwise(0.85))
    stem = F.regexp_extract("target", r"([^/]+?)(?:\.\w+)?$", 1)
    named = f.withColumn("n", F.count("*").over(Window.partitionBy("repo_id", "callee"))).where(F.col("n") <= MANY).withColumn("module", stem)
    there = c.join(modules(files), ["repo_id", "path"]).join(named, ["repo_id", "callee", "module"]).where("path <> target").withColumn("confidence", F.when(F.col("path").rlike(SCRIPT), 0.85).otherwise(0.7))
    both = here.select("repo_id", "path", "caller", "target", "callee", "confidence").unionByName(there.select("repo_id", "path", "caller", "target", "callee", "confidence"))
    edge = both.select("repo_id", F.concat_ws("::", "path", "caller").alias("src"), F.concat_ws("::", "target", "callee").alias("dst"), "confidence").where("src <> dst")
    return edge.groupBy("repo_id", "src", "dst").agg(F.max("confidence").alias("confidence")).withColumn("kind", F.lit("calls"))
