"""Property tests (hypothesis) over small generated event sets."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from fillwise.operators import analytics as A
from fillwise.operators import lifecycle as L
from fillwise.operators.dedup import latest
from tests_helpers import events

row = st.fixed_dictionaries({
    "order_id": st.sampled_from(["a", "b", "c"]),
    "event_type": st.sampled_from(["created", "fulfilled"]),
    "signature": st.sampled_from(["s1", "s2", "s3", "s4"]),
    "_version": st.integers(0, 3),
    "give_amount_usd": st.one_of(st.none(), st.floats(0, 1000, allow_nan=False).map(lambda x: round(x, 2))),
    "take_amount_usd": st.one_of(st.none(), st.floats(0, 1000, allow_nan=False).map(lambda x: round(x, 2))),
    "block_time": st.integers(0, 5).map(lambda d: dt.datetime(2001, 1, 1) + dt.timedelta(days=d)),
    "taker": st.one_of(st.none(), st.sampled_from(["t1", "t2"])),
})
SETTINGS = settings(max_examples=8, deadline=None)


def canon(df):
    return sorted(tuple(r) for r in df.collect())


@SETTINGS
@given(st.lists(row, max_size=8))
def test_latest_is_idempotent_and_absorbs_redelivery(spark, rows):
    ev = events(spark, rows)
    once = latest(ev)
    assert canon(latest(once)) == canon(once)
    assert canon(latest(ev.unionByName(ev))) == canon(once)


@SETTINGS
@given(st.lists(row, max_size=8))
def test_totals_equal_sum_of_days(spark, rows):
    ev = latest(events(spark, rows))
    tot = A.total_stats(ev).first()
    days = A.daily_volumes(ev, 365, "2001-12-31 00:00:00").collect()
    assert tot.total_created == sum(d.created_count for d in days)
    assert abs(tot.total_created_volume_usd - sum(d.created_volume_usd for d in days)) < 1e-6


@SETTINGS
@given(st.lists(row, max_size=8))
def test_lifecycle_aggregate_equals_join_form(spark, rows):
    ev = latest(events(spark, rows))
    assert canon(L.lifecycles(ev)) == canon(L.lifecycle_join(ev))
