import json
import random
import re

from pyarrow import fs as pafs

from cuemill.sources import files, store, tail


def test_lines_from_the_end_in_any_block_size(tmp_path):
    rng = random.Random(1)
    for lines in ([], [""], ["a"], ["a", ""], ["", "", "b"], ["é" * rng.randint(0, 40) for _ in range(50)]):
        raw = "\n".join(lines).encode()
        (tmp_path / "x").write_bytes(raw)
        want, at = [], 0
        for line in raw.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        for block in (1, 2, 3, 7, 64, 1000):
            got = [(a, x) for a, x, _ in tail.lines_from_the_end(pafs.LocalFileSystem(), str(tmp_path / "x"), block)]
            assert got == want[::-1]


def test_the_end_of_a_long_log_costs_little_and_equals_the_whole_scan(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "log").mkdir()
    for part in range(3):
        rows = [json.dumps({"n": k, "text": "x" * rng.randint(0, 300)}) if k % 7 else rng.choice(["", "  ", "{broken", "[1]", '"text"']) for k in range(4000)]
        (tmp_path / f"log/part-{part}.jsonl").write_text("\n".join(rows) + rng.choice(["", "\n"]))
    found = tail.tail(spark, str(tmp_path / "log"), limit=50, block=4096).collect()
    assert max(r["bytes_read"] for r in found) < 40_000 < min(p.stat().st_size for p in (tmp_path / "log").iterdir()) / 10
    got = [r["n"] for r in tail.recent(spark, str(tmp_path / "log"), "n long, text string", limit=70).collect()]
    whole = files.json_lines(spark, str(tmp_path / "log/part-2.jsonl"), "n long, text string").collect()
    assert got == sorted((r["n"] for r in whole if r["n"] is not None), reverse=True)[:70]
    assert tail.recent(spark, str(tmp_path / "log"), "n long", limit=0).count() == 0
    assert tail.recent(spark, str(tmp_path / "none"), "n long").count() == 0


def test_stored_jobs_are_pruned_by_status_and_time(spark, tmp_path):
    rows = [(f"j{k}", json.dumps({"status": ["done", "error", "2024"][k % 3], "created": k / 2, "batch_id": f"b{k % 5}"})) for k in range(90)] + [("bad", "{no"), ("none", None), ("odd", '{"status": 5, "created": "x"}')]
    where = str(tmp_path / "jobs")
    store.store_jobs(spark.createDataFrame(rows, "id string, data string").repartition(3), where)
    found = store.stored_jobs(spark, where, status=["error"], since=20.0, batch_id="b1")
    assert sorted(r["id"] for r in found.collect()) == sorted(f"j{k}" for k in range(90) if k % 3 == 1 and k / 2 >= 20 and k % 5 == 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*status", plan) and "GreaterThanOrEqual(created" in plan
    every = {r["id"]: (r["status"], r["created"], r["data"]) for r in store.stored_jobs(spark, where).collect()}
    assert len(every) == 93 and every["bad"] == (None, None, "{no") and every["none"] == (None, None, None) and every["odd"][0] == "5" and every["j2"][0] == "2024"
