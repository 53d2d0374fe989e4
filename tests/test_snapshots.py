"""What changed between snapshots: winning rows, spellings, gaps, empty tables, extra columns."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodeplane.operators import snapshots as S

EXT = "row_id bigint, snapshot_no int, provider_id string, name string, category string, consumers_json string, diff string, received_at timestamp_ntz"
EDGE = "edge_id bigint, snapshot_no int, source_repo string, target_repo string, method string, route string, diff string, received_at timestamp_ntz"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def changes(df, table="shared_externals"):
    signed = S.edges_changes(df) if table == "cross_repo_http_edges" else S.externals_changes(df, table)
    return {(r.snapshot_no, r.record_key): (r.change_type, tuple(r.changed_fields)) for r in S.classify(signed).collect()}


def test_kinds_of_change_over_a_gap(spark):
    rows = [
        (1, 1, "a", "N", "c", '["x"]', None, at(1)),
        (2, 1, "b", "N", "c", '["x"]', None, at(1)),
        (3, 1, "c", "N", "c", '["x","y"]', "added", at(1)),
        (4, 4, "A ", " N", "C", '[{"repoId":"X"}, null]', " ", at(2)),  # other spelling, same content
        (5, 4, "c", "N2", "c", '["y"]', "modified", at(2)),
        (6, 4, "d", "N", "c", None, None, at(2)),
        (7, 4, None, "N", "c", None, None, at(2)),
        (8, None, "e", "N", "c", None, None, at(2)),
    ]
    got = changes(spark.createDataFrame(rows, EXT))
    assert got == {(4, "b"): ("removed", ()), (4, "c"): ("changed", ("consumers", "diff", "name")), (4, "d"): ("added", ())}


def test_latest_row_wins_and_repeats_do_not_count(spark):
    rows = [(1, 1, "a", "old", "c", "[]", None, at(1)), (1, 1, "a", "old", "c", "[]", None, at(1)), (2, 1, "a", "new", "c", "[]", None, at(5)), (3, 2, "a", "new", "c", "", "unchanged", at(3)), (4, 2, "a", "older", "c", "", None, None)]
    assert changes(spark.createDataFrame(rows, EXT)) == {}


def test_consumers_in_many_spellings(spark):
    texts = ['["a", "b"]', '[ "B", " a" ]', '["\\u0061","b","a"]', '[{"repoId": "a"},{"repoId":"b"},null,""]', '[{"other":1},"a","b"]']
    rows = [(i, i + 1, "k", "n", "c", t, None, at(i)) for i, t in enumerate(texts)]
    assert changes(spark.createDataFrame(rows, EXT)) == {}
    rows = [(0, 1, "k", "n", "c", "not json", None, at(0)), (1, 2, "k", "n", "c", "other", None, at(0))]
    assert changes(spark.createDataFrame(rows, EXT)) == {(2, "k"): ("changed", ("consumers",))}


def test_edges_key_and_empty_table(spark):
    rows = [(1, 1, " R1", "r2 ", "get", "/a", None, at(1)), (2, 3, "r1", "R2", "GET ", "/a", "Added ", at(1)), (3, 3, "r1", "r2", "GET", "/A", None, at(1))]
    assert changes(spark.createDataFrame(rows, EDGE), "cross_repo_http_edges") == {(3, "r1|r2|GET|/a"): ("changed", ("diff",)), (3, "r1|r2|GET|/A"): ("added", ())}
    assert changes(spark.createDataFrame([], EXT)) == {}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "a", "n", "c", None, None, at(1), 7, "x"), (2, 2, "a", "m", "c", None, None, at(1), 8, "y")], EXT + ", sign int, field string")
    df = df.withColumn("cells", df.name).withColumn("_key", df.name).withColumn("best", df.name)
    assert changes(df) == {(2, "a"): ("changed", ("name",))}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from("abc"), st.sampled_from(["x", "y", None]), st.integers(0, 3)), max_size=14))
def test_against_brute_force(spark, rows):
    data = [(i, no, k, "n", v, None, None, at(h)) for i, (no, k, v, h) in enumerate(rows)]
    state = {}
    for _, no, k, _, v, _, _, t in data:
        state.setdefault(no, {}).setdefault(k, []).append((t, v is not None, v or ""))
    state = {no: {k: max(x)[2] for k, x in ks.items()} for no, ks in state.items()}
    want = {}
    nos = sorted(state)
    for a, b in zip(nos, nos[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                want[b, k] = "added"
            elif k not in state[b]:
                want[b, k] = "removed"
            elif state[a][k] != state[b][k]:
                want[b, k] = "changed"
    got = {k: v[0] for k, v in changes(spark.createDataFrame(data, EXT)).items()}
    assert got == want
