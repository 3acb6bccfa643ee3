import random

import pytest
from pyspark.sql import functions as F

from cuemill.streaming import activity, log

SCHEMA = "n long, at long, message string"


@pytest.fixture
def source(spark, tmp_path):
    """Appends rows as one more file."""

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return str(tmp_path / "in")

    return add


def rows_of(rng, first, count):
    return [(k, rng.randrange(50), f"token=abcd{k} x") for k in range(first, first + count)]


def run(spark, where, folder, **options):
    log.run_log(activity.watch_folder(spark, where, SCHEMA, files_per_batch=1), folder, order=["at", "n"], secret=["message"], **options)


def test_ids_have_no_gaps_and_follow_each_batchs_order(spark, source, tmp_path):
    rng = random.Random(1)
    parts = [rows_of(rng, 0, 40), rows_of(rng, 40, 3), rows_of(rng, 43, 70)]
    for p in parts:
        where = source(p)
    run(spark, where, str(tmp_path / "a"), capacity=10)
    got = spark.read.parquet(str(tmp_path / "a/log")).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 114))
    # Files come in the order of their times, which may be equal: batches are compared by what they hold.
    batches = [[r for r in got if r["batch"] == b] for b in range(3)]
    assert sorted(sorted(r["n"] for r in b) for b in batches) == sorted(sorted(r[0] for r in p) for p in parts)
    assert all([(r["at"], r["n"]) for r in b] == sorted((r["at"], r["n"]) for r in b) for b in batches)
    assert all(r["message"] == "token=[redacted] x" for r in got)
    assert sorted(r["id"] for r in log.feed(spark, str(tmp_path / "a")).collect()) == list(range(104, 114))
    assert [r["id"] for r in log.newest(spark, str(tmp_path / "a"), 3).collect()] == [113, 112, 111]


def test_stop_and_restart_equal_one_run(spark, source, tmp_path):
    rng = random.Random(2)
    folders = [str(tmp_path / x) for x in ("one", "two")]
    for p in (rows_of(rng, 0, 9), rows_of(rng, 9, 20), rows_of(rng, 29, 5)):
        where = source(p)
        run(spark, where, folders[0], capacity=12)  # stopped after each file
    run(spark, where, folders[1], capacity=12)
    for name in ("log", "feed"):
        one, two = (spark.read.parquet(f"{f}/{name}") for f in folders)
        of_last = lambda df: sorted(r["n"] for r in df.where(F.col("batch") == 2).collect())
        assert sorted(r["id"] for r in one.collect()) == sorted(r["id"] for r in two.collect()) and len(of_last(one)) == len(of_last(two))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "r")
    rng = random.Random(3)
    first, second = (spark.createDataFrame(rows_of(rng, k, 25), SCHEMA).repartition(3) for k in (0, 25))
    add = lambda df, b: log.feed_batch(log.append_batch(df, b, folder, order=["at"], secret=["message"]), b, folder, capacity=30)
    state = lambda: (sorted(map(tuple, spark.read.parquet(f"{folder}/log").collect())), sorted(map(tuple, log.feed(spark, folder).collect())))
    add(first, 0)
    add(second, 1)
    before = state()
    add(second, 1)
    assert state() == before and len(before[0]) == 50 and len(before[1]) == 30
    add(second.limit(0), 2)
    assert state()[0] == before[0] and sorted(r[0] for r in state()[1]) == list(range(21, 51))


def test_a_lost_feed_begins_with_the_newest_of_the_log(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "l")
    rng = random.Random(4)
    parts = [spark.createDataFrame(rows_of(rng, k, 10), SCHEMA) for k in (0, 10)]
    log.feed_batch(log.append_batch(parts[0], 0, folder, order=["at"], secret=[]), 0, folder, capacity=14)
    shutil.rmtree(f"{folder}/feed")
    log.feed_batch(log.append_batch(parts[1], 1, folder, order=["at"], secret=[]), 1, folder, capacity=14)
    assert sorted(r["id"] for r in log.feed(spark, folder).collect()) == list(range(7, 21))


def test_first_of_a_signature_opens_and_later_ones_comment(spark, tmp_path):
    folder = str(tmp_path / "i")
    make = lambda rows: spark.createDataFrame(rows, "event long, signature string").repartition(2)
    batches = [make([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")]), make([(6, "b"), (7, "c"), (8, "c"), (9, "")]), make([(10, "a"), (11, "c")])]

    def deliveries():
        return {r["event"]: (r["action"], r["issue"], r["title"]) for r in spark.read.parquet(f"{folder}/deliveries").collect()}

    for turn, b in [(0, batches[0]), (1, batches[1]), (1, batches[1]), (2, batches[2]), (2, batches[2])]:
        log.issue_batch(b, turn, folder, order=["event"], title=F.concat(F.lit("t"), "signature"))
    opened = {1: "ta", 3: "tb", 4: "t", 5: "t", 7: "tc", 9: "t"}
    of = {2: 1, 6: 3, 8: 7, 10: 1, 11: 7}
    assert deliveries() == {k: ("created", f"issue-{k}", t) for k, t in opened.items()} | {k: ("commented", f"issue-{v}", None) for k, v in of.items()}
    assert spark.read.parquet(f"{folder}/issues").count() == 3
