import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from cuemill.llm import sharding
from cuemill.llm.queries import op2_sharding


def check(rows, texts, shards):
    counts, slots, places = Counter(), defaultdict(list), defaultdict(Counter)
    left = Counter()
    for k, t in texts:
        raw = (t or "").encode()
        left[(k, len(raw) + 8, zlib.crc32(raw))] += 1
    for r in rows:
        left[(r["doc_id"], r["size"], r["text_crc32"])] -= 1
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
        places[r["text_crc32"]][r["shard"]] += 1
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert not any(left.values())
    if rows:
        every = [counts[s] for s in range(shards)]
        assert max(every) - min(every) <= 1
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return places


def test_rows_are_even_and_groups_stay_together(spark, make_docs):
    rng = random.Random(4)
    texts = [f"single {k}" for k in range(700)] + [f"group {k}" for k in range(60) for _ in range(rng.randint(2, 9))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    places = check(sharding.assign_shards(make_docs(rows), shards=8).collect(), rows, 8)
    split = [c for c in places.values() if sum(c.values()) > 1 and len(c) > 1]
    assert len(split) <= 8


def test_group_larger_than_a_shard(spark, make_docs):
    rows = list(enumerate(["hot"] * 400 + [f"s{k}" for k in range(800)]))
    places = check(sharding.assign_shards(make_docs(rows), shards=12).collect(), rows, 12)
    # 1200 rows, shards of 100: the group needs four of them at least.
    assert len(places[zlib.crc32(b"hot")]) <= 8


def test_all_linked(spark, make_docs):
    rows = list(enumerate([f"t{k % 5}" for k in range(203)]))
    check(sharding.assign_shards(make_docs(rows), shards=7).collect(), rows, 7)


@pytest.mark.parametrize("texts", [[], [None], [None, None, "", ""], ["a"] * 3])
def test_few_rows(spark, make_docs, texts):
    rows = list(enumerate(texts))
    docs = make_docs(rows) if rows else make_docs(["x"]).limit(0)
    check(sharding.assign_shards(docs, shards=24).collect(), rows, 24)


def test_repeated_and_null_ids_long_text_and_clashing_columns(spark, make_docs):
    long = "wörd " * 300_000
    rows = [(1, "same"), (1, "same"), (None, "x"), (None, None), (4, long), (5, long)]
    docs = make_docs(rows).withColumnRenamed("source", "shard").withColumnRenamed("lang", "grp")
    check(sharding.assign_shards(docs, shards=3).collect(), rows, 3)


def placed(spark, rows, texts):
    kept = [(r["shard"], zlib.crc32((t or "").encode())) for t, r in zip(texts, sorted(rows, key=lambda r: r["doc_id"]), strict=True)]
    return spark.createDataFrame(kept, "shard int, grp long")


def test_few_edges_are_cut(spark, make_docs):
    rng = random.Random(6)
    texts = [f"group {k}" for k in range(50) for _ in range(rng.randint(2, 9))] + [f"s{k}" for k in range(300)]
    rows = list(enumerate(texts))
    after = sharding.cut_edges(placed(spark, sharding.assign_shards(make_docs(rows), shards=6).collect(), texts)).first()
    start = spark.createDataFrame([(k * 7919 % 6, zlib.crc32(t.encode())) for k, t in rows], "shard int, grp long")
    before = sharding.cut_edges(start).first()
    assert after["edges"] == before["edges"] > 0
    assert after["cut"] < 0.1 * before["cut"]


@pytest.mark.parametrize("seed", range(3))
def test_cut_near_the_best_of_small_graphs(spark, make_docs, seed):
    """Against the least cut of all placements of groups in two even shards."""
    rng = random.Random(seed)
    sizes = [rng.randint(2, 4) for _ in range(3)]
    texts = [f"g{k}" for k, n in enumerate(sizes) for _ in range(n)] + ["own a", "own b"]
    rows, half = list(enumerate(texts)), (len(texts) + 1) // 2
    pairs = lambda n: n * (n - 1) // 2
    best = min(
        sum(pairs(n) - pairs(k) - pairs(n - k) for n, k in zip(sizes, split, strict=True))
        for split in itertools.product(*(range(n + 1) for n in sizes))
        if half - 2 - len(texts) % 2 <= sum(split) <= half
    )
    got = sharding.cut_edges(placed(spark, sharding.assign_shards(make_docs(rows), shards=2).collect(), texts)).first()["cut"]
    assert best <= got <= best + 4


def test_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(op2_sharding(spark, "/root/testdata/sf0.001").collect(), [(r[0], r[1]) for r in docs], 24)


def test_no_python_in_any_plan(spark, make_docs, monkeypatch):
    plans = []

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    keep = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", written)
    found = sharding.assign_shards(make_docs([f"text {k % 7}" for k in range(60)]), shards=4)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and not any("Python" in p or "Arrow" in p or "Pandas" in p for p in plans)


def test_rows_without_id_and_text_are_spread(spark, make_docs):
    texts = [(None, None)] * 90 + [(k, f"t{k}") for k in range(30)]
    check(sharding.assign_shards(make_docs(texts), shards=6).collect(), texts, 6)
