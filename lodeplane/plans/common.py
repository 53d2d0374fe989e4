"""What several query modules share: current entities in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.operators import entities
from lodeplane.sources.tables import table


def apis(spark: SparkSession, d: str, kind: str = "working") -> DataFrame:
    return entities.current_apis(table(spark, d, "apis"), kind)


def files(spark: SparkSession, d: str, kind: str = "working") -> DataFrame:
    return entities.current_files(table(spark, d, "files"), kind)


def repos(spark: SparkSession, d: str) -> DataFrame:
    """The registry, each repository once."""
    return entities.latest(table(spark, d, "repos"), ["repo_id"], [F.desc_nulls_last("added_at"), F.desc_nulls_last("last_init_at"), F.desc_nulls_last("name")])


def repo_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph of repositories: one edge per calling and called repository, with the number of distinct calls."""
    from lodeplane.functions.text import filled

    e = table(spark, d, "cross_repo_http_edges")
    clean = e.select(filled("source_repo").alias("src"), filled("target_repo").alias("dst"), F.upper(F.trim("method")).alias("method"), F.trim("route").alias("route"))
    return clean.where("src is not null and dst is not null and src <> dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("calls"))


#: Version and running number of a route, which callers and served entry points spell each in their own way.
_CALLED, _SERVED = r"^/(?:api|internal|v[0-9]+)/([a-z]+)/[^/:{]+", r"^/(?:api|internal|v[0-9]+)/([a-z]+)-[^/]+"


def called_route(c: str = "route"):
    """The route of a call without version and running number."""
    return F.regexp_replace(F.trim(c), _CALLED, "/$1")


def served_route(c: str = "route"):
    """The route of an entry point without version and running number."""
    return F.regexp_replace(F.trim(c), _SERVED, "/$1")


def sql_called(c: str = "route") -> str:
    return f"regexp_replace(trim({c}), '{_CALLED}', '/\\1')"


def sql_served(c: str = "route") -> str:
    return f"regexp_replace(trim({c}), '{_SERVED}', '/\\1')"


def sql_apis(name: str = "w", kind: str = "working") -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, api_id ORDER BY received_at DESC NULLS LAST, first_seen_at DESC NULLS LAST, diff DESC NULLS LAST) AS rn FROM apis WHERE snapshot_kind = '{kind}' AND api_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL)"


def sql_files(name: str = "f", kind: str = "working") -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY received_at DESC NULLS LAST, file_id DESC) AS rn FROM files WHERE snapshot_kind = '{kind}' AND path IS NOT NULL) WHERE rn = 1)"


SQL_REPOS = "r AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY added_at DESC NULLS LAST, last_init_at DESC NULLS LAST, name DESC NULLS LAST) AS rn FROM repos) WHERE rn = 1)"
SQL_EDGES = "e AS (SELECT src, dst, count(*) AS calls FROM (SELECT DISTINCT nullif(lower(trim(source_repo)), '') AS src, nullif(lower(trim(target_repo)), '') AS dst, upper(trim(method)) AS method, trim(route) AS route FROM cross_repo_http_edges) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2)"


def collect(namespace: dict, sql: dict[str, str]) -> tuple[dict, dict]:
    """The registered functions of a module (all whose names are keys of ``sql``), and the SQL that is not empty."""
    return {k: namespace[k] for k in sql}, {k: v for k, v in sql.items() if v}
