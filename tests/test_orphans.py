"""Orphan references: half-open lives, returning targets, ties, repeats, hot keys, brute force."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeplane.operators import orphans as O


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def found(spark, targets, refs):
    t = spark.createDataFrame([(k, at(s), at(u)) for k, s, u in targets], "k string, s timestamp_ntz, u timestamp_ntz")
    r = spark.createDataFrame([(i, k, at(h)) for i, k, h in refs], "i bigint, k string, t timestamp_ntz")
    out = O.orphan_references(O.references(r, F.col("k"), "t", "i", table="x", field="f"), O.deltas(t, F.col("k"), "s", "u"))
    return sorted(x.record_id for x in out.collect())


def test_boundaries_and_returning_ids(spark):
    targets = [("a", 10, 20), ("a", 30, None), ("b", None, None), ("c", 5, 5), ("d", 9, 3)]
    refs = [(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "a", 30), (6, "b", 1), (7, "c", 5), (8, "d", 5), (9, "z", 5), (10, None, 5), (11, "a", None)]
    assert found(spark, targets, refs) == [1, 4, 6, 7, 8, 9, 11]


def test_repeats_empty_tables_and_hot_key(spark):
    assert found(spark, [], [(1, "a", 1), (1, "a", 1)]) == [1]
    assert found(spark, [("a", 1, None)], []) == []
    targets = [("hot", h, h + 1) for h in range(0, 200, 2)] * 2
    refs = [(i, "hot", i % 200) for i in range(600)]
    assert found(spark, targets, refs) == [i for i in range(600) if (i % 200) % 2]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 60))), max_size=8), st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), max_size=12))
def test_against_brute_force(spark, targets, refs):
    refs = [(i, k, h) for i, (k, h) in enumerate(refs)]
    want = [i for i, k, h in refs if not any(k == tk and s <= h and (u is None or u > h) for tk, s, u in targets)]
    assert found(spark, targets, refs) == want


def test_workspace_spelling_and_extra_columns(spark):
    apis = spark.createDataFrame([("working", "R1", "GET:/a::f", "GET", "/a", at(0), None, 1), ("baseline", "r1", "GET:/b::f", "GET", "/b", at(0), None, 2)], "snapshot_kind string, repo_id string, api_id string, method string, route string, first_seen_at timestamp_ntz, deleted_at timestamp_ntz, key int")
    repos = spark.createDataFrame([("r1", at(0), at(10))], "repo_id string, added_at timestamp_ntz, removed_at timestamp_ntz")
    cursors = spark.createDataFrame([(1, " r1", " get:/A::F", "get:/a ", at(1)), (2, "r1", "GET:/b::f", "GET:/b", at(1)), (3, "r2", " ", "GET:/a", at(1)), (4, "r1", None, None, at(1))], "cursor_id bigint, repo_id string, api_id string, entry_point_id string, reviewed_at timestamp_ntz")
    edges = spark.createDataFrame([(1, "R1 ", at(9)), (2, "r1", at(10)), (3, None, at(1))], "edge_id bigint, target_repo string, snapshot_at timestamp_ntz")
    out = O.orphan_references(O.workspace_references(cursors, edges), O.workspace_deltas(apis, repos))
    assert {(r.ref_field, r.record_id) for r in out.collect()} == {("api_id", 2), ("entry_point_id", 2), ("entry_point_id", 3), ("target_repo", 2)}
