"""Streams over a folder of several files in several batches, against brute force."""

import datetime

import pytest

from cuemill.plans import texts

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows():
    """The newest events come in the first file."""
    start = datetime.datetime(2024, 1, 1)
    return [(k, start + datetime.timedelta(minutes=37 * k % 1000, days=k % 5), k % 3, "view", k / 4, "{}") for k in range(60, 0, -1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("streams"))
    found = sorted(rows(), key=lambda r: r[1], reverse=True)
    for part in range(3):
        spark.createDataFrame(found[part * 20 : part * 20 + 20], EVENTS).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    return d


def test_sessions_include_open_ones_and_late_events(spark, folder):
    gap, want = datetime.timedelta(minutes=30), []
    for user in range(3):
        for ts in sorted(r[1] for r in rows() if r[2] == user):
            if want and want[-1][0] == user and ts < want[-1][2]:
                want[-1] = (user, want[-1][1], ts + gap, want[-1][3] + 1)
            else:
                want.append((user, ts, ts + gap, 1))
    got = texts.stream_sessions(spark, folder, files_per_batch=1).selectExpr("user_id", "cast(start AS timestamp_ntz)", "cast(end AS timestamp_ntz)", "events").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ring_and_daily(spark, folder):
    got = {r["user_id"]: (r["newest"], r["evicted"]) for r in texts.stream_ring(spark, folder, files_per_batch=1).collect()}
    ids = {u: sorted(r[0] for r in rows() if r[2] == u) for u in range(3)}
    assert got == {u: (",".join(map(str, x[-4:])), len(x) - 4) for u, x in ids.items()}
    want = {}
    for r in rows():
        minutes, jobs = want.get(f"{r[1]:%Y-%m-%d}", (0, 0))
        want[f"{r[1]:%Y-%m-%d}"] = (minutes + r[4], jobs + 1)
    assert {r["bucket"]: (r["minutes"], r["jobs"]) for r in texts.stream_daily(spark, folder, files_per_batch=1).collect()} == want
