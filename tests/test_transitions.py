"""Runs that change their state as events come, against a plain fold."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quarrymill.streaming import runs

KINDS = ("signup", "view", "click", "purchase", "refund")


def day(k, n):
    rng = random.Random(k)
    start = dt.datetime(2024, 1, 1 + k)
    return [(k * 1000 + i, start + dt.timedelta(seconds=60 * i), rng.randrange(9 if k < 2 else 4), rng.choice(KINDS), 1.0, "{}") for i in range(n)]


def folded(events):
    status, out = {}, {}
    for e, _, u, kind, *_ in sorted(events, key=lambda x: (x[1], x[0])):
        before = status.get(u, "")
        ok = kind in runs.ALLOWED.get(before, ())
        status[u] = kind if ok else before
        out[e] = (u, before, status[u], "accepted" if ok else "refused")
    return out


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    batches = [day(0, 300), day(1, 200), day(4, 100), day(5, 50)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for rows in batches:  # one batch for each call, and the state goes on
        random.Random(1).shuffle(rows)
        spark.createDataFrame(rows, runs.EVENTS).coalesce(1).write.mode("append").parquet(f"{top}/in")
        changes = runs.transitions(runs.event_stream(spark, f"{top}/in"))
        runs.write(changes, f"{top}/out", f"{top}/check").awaitTermination()
    return [e for b in batches for e in b], spark.read.parquet(f"{top}/out").collect()


def test_replay_equals_a_fold(results):
    events, got = results
    assert {r.event_id: (r.user_id, r.before, r.status, r.outcome) for r in got if r.event_id is not None} == folded(events)
    assert {r.outcome for r in got} == {"accepted", "refused", "stuck"}


def test_runs_that_stop_are_stuck(results):
    events, got = results
    last = {}
    for _, ts, u, *_ in events:
        last[u] = max(last.get(u, ts), ts)
    stuck = {r.user_id for r in got if r.outcome == "stuck"}
    assert stuck >= {u for u, ts in last.items() if ts < dt.datetime(2024, 1, 4)}
    final = {e[2]: f for e, f in ((e, folded(events)[e[0]]) for e in sorted(events, key=lambda x: (x[1], x[0])))}
    assert all(r.status == final[r.user_id][2] for r in got if r.outcome == "stuck" and r.user_id > 3)
