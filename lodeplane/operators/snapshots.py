"""What changed between full snapshots of a keyed table.

Every delivered snapshot is unpivoted into signed cells ``(key, field, value)``: a row of snapshot *s* counts +1 in the
step that ends with *s* and -1 in the step that starts with *s*; one more cell per row marks the presence of the key. In
the sums per cell everything that stayed the same cancels out. What is left tells the change: a presence of +1 is an
added record, -1 a removed one, and 0 with other cells left a changed one, whose fields are those of the cells.

Two shuffles: one for the winning row of each record and snapshot (combined on the map side, so that a key delivered
again and again costs no more than any other), one that brings the two rows of a step together. The cells are made after
that shuffle, and both sums run in its partitioning. A step holds at most two rows per key, so no group is large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.functions.text import filled, folded, squeezed

SNAPSHOT_TABLES = ("shared_externals", "baseline_shared_externals", "cross_repo_http_edges")


def member_set(json: Column | str) -> Column:
    """The set in a JSON array of ids, of objects with ``repoId``, or of nulls, as a sorted array of folded ids.

    Null, blank and ``[]`` give the empty set. Text that is no JSON array gives one member, the text itself, so that a
    change of it still counts. Elements that are null, blank or objects without ``repoId`` are skipped.
    """
    text = squeezed(json)
    parsed = F.from_json(text, "array<string>")
    opaque = F.array(F.lower(text))
    listed = F.when(parsed.isNull(), F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(opaque)).otherwise(parsed)
    ids = F.transform(listed, lambda e: folded(F.when(e.startswith("{"), F.get_json_object(e, "$.repoId")).otherwise(e)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda e: e.isNotNull() & (e != ""))))


def winning_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the greatest by ``order``, ties by the values themselves; nulls in ``order`` come first."""
    best = F.max(F.struct(*order, *values)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{v}").alias(v) for v in values])


def snapshot_changes(rows: DataFrame, fields: Mapping[str, Column], key: Column, *, table: str, snapshot: str = "snapshot_no", received: str = "received_at") -> DataFrame:
    """Signed rows of one table: ``tbl, snapshot_no, record_key, sign, cells``; feed the union to ``classify``.

    ``key`` names the record; rows with a null key or snapshot name none and are left out. ``fields`` are the compared
    values as strings, null being a value of its own. Extra columns of any name are ignored.
    """
    names = list(fields)
    flat = rows.select(key.alias("_key"), F.col(snapshot).cast("int").alias("_no"), F.col(received).alias("_at"), *[c.cast("string").alias(f"_v{i}") for i, c in enumerate(fields.values())])
    values = [f"_v{i}" for i in range(len(names))]
    best = winning_rows(flat.where(F.col("_key").isNotNull() & F.col("_no").isNotNull()), ["_key", "_no"], ["_at"], values)
    # The snapshot numbers are a list as long as the table's history of deliveries, not as its rows.
    steps = rows.select(F.col(snapshot).cast("int").alias("_no")).where(F.col("_no").isNotNull()).distinct()
    steps = steps.agg(F.array_sort(F.collect_set("_no")).alias("all"))
    later = steps.select(F.explode(F.transform("all", lambda n, i: F.struct(n.alias("_no"), F.get(F.col("all"), i + 1).alias("_next"), (i > 0).alias("_ends")))).alias("s")).select("s.*")
    row = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *[F.struct(F.lit(n).alias("field"), F.col(v).alias("value")) for n, v in zip(names, values, strict=True)])
    steps_of = F.array_compact(F.array(
        F.when(F.col("_ends"), F.struct(F.col("_no").alias("no"), F.lit(1).alias("sign"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("no"), F.lit(-1).alias("sign"))),
    ))
    return best.join(later, "_no").select(F.lit(table).alias("tbl"), F.col("_key").alias("record_key"), row.alias("cells"), F.explode(steps_of).alias("s")).select("tbl", F.col("s.no").alias("snapshot_no"), "record_key", F.col("s.sign").alias("sign"), "cells")


def classify(signed: DataFrame) -> DataFrame:
    """``tbl, snapshot_no, record_key, change_type, changed_fields`` from signed rows."""
    step = ["tbl", "snapshot_no", "record_key"]
    cells = signed.repartition(*step).select(*step, "sign", F.explode("cells").alias("c")).select(*step, "c.field", "c.value", "sign")
    sums = cells.groupBy(*step, "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    records = sums.groupBy(*step).agg(
        F.sum(F.when(F.col("field") == "", F.col("n")).otherwise(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("fields"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return records.select(*step, kind.alias("change_type"), F.when(F.col("presence") == 0, F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def _mark(c: str) -> Column:
    return F.coalesce(filled(c), F.lit("unchanged"))


def externals_changes(rows: DataFrame, table: str) -> DataFrame:
    """Signed rows of a table of shared externals; ``consumers_json`` counts as a set."""
    fields = {"name": squeezed("name"), "category": folded("category"), "diff": _mark("diff"), "consumers": F.to_json(member_set("consumers_json"))}
    return snapshot_changes(rows, fields, folded("provider_id"), table=table)


def edges_changes(rows: DataFrame, table: str = "cross_repo_http_edges") -> DataFrame:
    """Signed rows of the edges, whose key has four parts and whose content is ``diff`` alone; a null part counts as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    key = F.concat_ws("|", part(folded("source_repo")), part(folded("target_repo")), part(F.upper(squeezed("method"))), part(squeezed("route")))
    return snapshot_changes(rows, {"diff": _mark("diff")}, key, table=table)


def workspace_changes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All changes of the three snapshot tables; an empty table adds nothing."""
    parts = [edges_changes(df, n) if n == "cross_repo_http_edges" else externals_changes(df, n) for n, df in tables.items()]
    return classify(reduce(DataFrame.unionByName, parts))


def change_counts(changes: DataFrame) -> DataFrame:
    """Records added, removed and changed per table and snapshot."""
    return changes.groupBy("tbl", "snapshot_no").agg(*[F.count(F.when(F.col("change_type") == k, 1)).alias(k) for k in ("added", "removed", "changed")])
