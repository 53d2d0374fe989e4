"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.llm import credentials, encode, garbled, handwritten, leakage, syntax
from lodeplane.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "files"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_files(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "files")).select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.error_rates(table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.foreign_files(table(spark, d, "files"), table(spark, d, "repos")).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.foreign_files(table(spark, d, "files"), table(spark, d, "repos")).groupBy("reason").agg(F.count("*").alias("files"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source: the size of the corpus in the tokenizer's terms."""
    docs = table(spark, d, "documents")
    ids = encode.encode_texts(docs.select("doc_id", "text"))
    return docs.select("doc_id", "doc_kind").join(ids, "doc_id").groupBy("doc_kind").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p7_found(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_keys(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    g = garbled.garbled_texts(table(spark, d, "documents"))
    return g.select("doc_id", F.col("page").alias("read_as"), F.col("true").alias("written_as"), F.when(F.col("page") != "lost", F.col("text")).alias("restored"))


def p8_mapping(spark: SparkSession, d: str) -> DataFrame:
    return garbled.learned_mapping(garbled.garbled_texts(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_rates, p5_found, p5_reasons, p6_ids, p6_counts, p7_found, p7_items, p8_found, p8_restored, p8_mapping)}


def _p5() -> str:
    h = handwritten
    limits = " ".join(f"WHEN regexp_matches(p, '\\.({e})$') THEN [{m}, {b}]" for e, (m, b) in h.LAYOUT.items())
    return f"""
WITH roots AS (SELECT DISTINCT repo_id FROM repos WHERE regexp_matches(root_path || '/', '{h.PLACES}')),
f AS (SELECT DISTINCT file_id, repo_id, coalesce(path, '') AS p, coalesce(content, '') AS c FROM files),
t AS (SELECT *, replace(replace(regexp_replace(c, '{h.IMAGE}', 'data:', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM f),
l AS (SELECT *, string_split(x, chr(10)) AS lines, greatest(length(x), 1) AS n, greatest(length(regexp_replace(x, '\\s+', '', 'g')), 1) AS visible FROM t),
s AS (SELECT *, length(x) AS chars, n / greatest(len(list_filter(lines, lambda y: length(y) > 0)), 1) AS mean_line, coalesce(list_sum(list_filter(list_transform(lines, lambda y: length(y)), lambda y: y >= {h.LONG_LINE})), 0) / n AS long, length(regexp_replace(array_to_string(list_filter(lines, lambda y: length(y) >= {h.LONG_LINE}), ''), '[^\\s]+', '', 'g')) / greatest(length(array_to_string(list_filter(lines, lambda y: length(y) >= {h.LONG_LINE}), '')), 1) AS long_blank, 1 - visible / n AS blank, length(regexp_replace(x, '[^0-9]+', '', 'g')) / visible AS digits,
 length(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) / visible AS alnum, len(regexp_extract_all(x, '\\b[0-9][0-9A-Fa-fxX_.]*\\b')) / greatest(len(regexp_extract_all(x, '\\w+')), 1) AS numbers, 1 - length(regexp_replace(x, '{h.RUN}', '', 'g')) / n AS runs,
 regexp_matches(p, '{h.CODE}') AS code, CASE WHEN regexp_matches(x, '(?m){h.HEAD_ENDS}') THEN regexp_extract(x, '(?s)\\A(.*?)(?m:{h.HEAD_ENDS})', 1) ELSE x END AS head,
 CASE {limits} ELSE {list(h.OTHER)} END AS least FROM l)
SELECT DISTINCT file_id FROM s WHERE repo_id IN (SELECT repo_id FROM roots WHERE repo_id IS NOT NULL) OR regexp_matches(p, '{h.PLACES}') OR regexp_matches(p, '{h.OUTPUTS}') OR regexp_matches(p, '{h.LOCKED}') OR regexp_matches(p, '{h.NAMES}') OR regexp_matches(head, '{h.TOOL}') OR regexp_matches(head, '{h.COPY}')
OR (code AND chars >= {h.LEAST_CHARS} AND ((runs >= {h.RUN_SHARE} AND alnum >= {h.ALNUM_SHARE}) OR (digits >= {h.DIGIT_SHARE} AND numbers >= {h.NUMBER_DENSITY})
 OR (long > 0 AND ((mean_line >= least[1] AND blank <= least[2]) OR (long >= {h.LONG_SHARE} AND long_blank <= least[2])))))
"""


ORACLE: dict[str, str] = {"p5_found": _p5()}
