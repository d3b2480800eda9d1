"""Linkage and snapshot deltas against literal re-computations in Python."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch import operators as O

SETTINGS = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
IDS = st.sampled_from([None, "", "a", "b", "c"])
ROWS = st.lists(st.tuples(IDS, st.integers(0, 2)), max_size=8)


def frame(spark, data, name="v"):
    return spark.createDataFrame(data, f"id string, {name} int")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def link_by_hand(left, right, how, null_safe):
    def same(a, b):
        return a == b and (null_safe or a is not None)

    out = [(k, v, w) for k, v in left for j, w in right if same(k, j)]
    if how != "inner":
        out += [(k, v, None) for k, v in left if not any(same(k, j) for j, _ in right)]
    if how == "full":
        out += [(j, None, w) for j, w in right if not any(same(k, j) for k, _ in left)]
    return Counter(out)


@SETTINGS
@given(
    left=ROWS, right=ROWS, how=st.sampled_from(["inner", "left", "full"]), null_safe=st.booleans()
)
def test_link_records(spark, left, right, how, null_safe):
    got = O.link_records(
        frame(spark, left), frame(spark, right, "w"), "id", how=how, null_safe=null_safe
    )
    assert bag(got.select("id", "v", "w")) == link_by_hand(left, right, how, null_safe)


@SETTINGS
@given(left=ROWS, right=ROWS, how=st.sampled_from(["left", "full"]), null_safe=st.booleans())
def test_link_records_to_unique_partners(spark, left, right, how, null_safe):
    right = list({k: (k, v) for k, v in right}.values())
    got = O.link_records(
        frame(spark, left),
        frame(spark, right, "w"),
        "id",
        how=how,
        null_safe=null_safe,
        right_unique=True,
    )
    assert bag(got.select("id", "v", "w")) == link_by_hand(left, right, how, null_safe)


def test_link_records_refuses_shared_columns(spark):
    with pytest.raises(ValueError, match="shared"):
        O.link_records(frame(spark, [("a", 1)]), frame(spark, [("a", 1)]), "id")
    with pytest.raises(ValueError, match="unsupported"):
        O.link_records(frame(spark, []), frame(spark, [], "w"), "id", how="cross")


def merged_by_hand(a, b):
    """Rows of a full outer join on all columns, nulls equal."""
    m, n = Counter(a), Counter(b)
    return {
        t: m[t] * n[t] if m[t] and n[t] else m[t] + n[t] for t in {*m, *n}
    }


@SETTINGS
@given(a=ROWS, b=ROWS)
def test_natural_full_join_counts_copies(spark, a, b):
    got = O.natural_full_join(frame(spark, a), frame(spark, b))
    assert {(r.id, r.v): r.copies for r in got.collect()} == merged_by_hand(a, b)


@SETTINGS
@given(a=ROWS, b=ROWS)
def test_symmetric_delta(spark, a, b):
    merged = merged_by_hand(a, b)
    per_id = Counter()
    for (key, _), copies in merged.items():
        per_id[key] += copies
    want = Counter({t: 1 for t in merged if per_id[t[0]] == 1})
    assert bag(O.symmetric_delta(frame(spark, a), frame(spark, b), "id")) == want


@SETTINGS
@given(a=ROWS, b=ROWS)
def test_once_only_new_and_classified(spark, a, b):
    cur, prev = frame(spark, a), frame(spark, b)
    seen = Counter(k for k, _ in a + b)
    assert bag(O.once_only(cur, prev, "id")) == Counter(t for t in a + b if seen[t[0]] == 1)

    have = {k for k, _ in b if k is not None}
    assert bag(O.new_records(cur, prev, "id")) == Counter(t for t in a if t[0] not in have)

    m, n = Counter(a), Counter(b)
    for r in O.classify_delta(cur, prev, "id").collect():
        mine = Counter({t: c for t, c in m.items() if t[0] == r.id})
        theirs = Counter({t: c for t, c in n.items() if t[0] == r.id})
        want = (
            "new" if not theirs else "removed" if not mine
            else "unchanged" if mine == theirs else "changed"
        )
        assert (r.change, r.rows_current, r.rows_previous) == (
            want, mine.total(), theirs.total()
        )


def test_once_only_fills_missing_columns(spark, rows):
    a = spark.createDataFrame([("x", 1)], "id string, v int")
    b = spark.createDataFrame([("y", 1, 7)], "id string, v int, row int")
    assert rows(O.once_only(a, b, "id")) == [("x", 1, None), ("y", 1, 7)]
    assert rows(O.symmetric_delta(a, b, "id")) == [("x", 1, None), ("y", 1, 7)]
