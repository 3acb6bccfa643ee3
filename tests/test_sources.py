import json

import pandas as pd
from pyspark.sql import functions as F

from cuemill.sources import files, sinks
from cuemill.streaming import activity


def test_bad_lines_are_left_out(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").collect()) == [1, 2]


def test_folder_of_documents(spark, tmp_path):
    for name, doc in (("x", {"id": "one", "status": "a"}), ("y", {"status": "b"}), ("z", {"id": "one", "status": "c"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = files.json_folder(spark, str(tmp_path), "id string, status string").collect()
    assert sorted((r["id"], r["status"]) for r in got) == [("one", "a"), ("y", "b")]


def test_feed_ranks_follow_lines_that_count(spark):
    lines = ['{"id": "a", "duration": "3:07"}', "broken", '{"title": "no id"}', '{"id": "s", "is_short": 1}', '{"id": "b", "duration": "12s", "category_id": 10}']
    rows = spark.createDataFrame(list(enumerate(lines)), "pos int, value string")
    got = files.ranked_feed(rows).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["seconds"], r["is_music"]) for r in got] == [(1, "a", 187, None), (2, "b", 12, True)]


def test_script(spark):
    text = "# Talk\n<!-- not\nspoken -->\nHello <!-- aside -->\nthere.\n\n![x](img/a.png)\n<!-- pause: 1.5 -->\n## Intro ##\n- **Bye** [now](http://x).\n> quoted\n\n## Intro\n"
    got = files.scripts(spark.createDataFrame([(1, text)], "id int, text string").withColumnRenamed("id", "script"), key="script").orderBy("position").collect()
    assert [(r["id"], r["title"], r["image"], r["pause_after"], r["paragraphs"]) for r in got] == [
        ("talk", "Talk", "a.png", 1.5, ["Hello there."]),
        ("intro", "Intro", "", None, ["Bye now. quoted"]),
        ("intro-2", "Intro", "", None, []),
    ]


def test_json_script_and_bad_ones(spark):
    doc = json.dumps({"title": "T", "slides": ["plain text", {"id": "x", "narration": ["a  b", "c\n\nd"], "pause_after": 99}, {"title": "Über", "text": "e"}]})
    rows = spark.createDataFrame([(1, doc), (2, "{broken"), (3, None)], "script int, text string")
    got = files.scripts(rows, key="script").orderBy("position").collect()
    assert [(r["script"], r["id"], r["pause_after"], r["paragraphs"]) for r in got] == [(1, "slide-1", None, ["plain text"]), (1, "x", 30.0, ["a b", "c", "d"]), (1, "ber", None, ["e"])]


def test_slide_ids_are_unique_and_paragraphs_end_at_blank_lines(spark):
    doc = json.dumps([{"title": "Intro"}, {"id": "intro-2", "text": ["a"]}, {"title": "intro!"}, {"title": "INTRO"}, 7, {"narration": None, "text": "unread"}, {"paragraphs": "p\n \nq", "image": "c:\\x\\y.png"}])
    md = "before\n\n  \nstill **before**\n# One #\n1. first\n``\n* snake_case _is_ kept\n> > said\n\n<!-- pause: 2 -->\n![](a b)\n![i](one.png)\n![i](two.png)\n<!-- pause: 45 -->\n<!-- open\nend"
    rows = spark.createDataFrame([(1, doc), (2, md), (3, "# only a title"), (4, " ")], "position int, text string")
    got = [tuple(r) for r in files.scripts(rows.withColumnRenamed("position", "script"), key="script").orderBy("script", "position").collect()]
    assert got[:7] == [
        (1, 0, "intro", "Intro", "", None, []),
        (1, 1, "intro-2", "", "", None, ["a"]),
        (1, 2, "intro-3", "intro!", "", None, []),
        (1, 3, "intro-4", "INTRO", "", None, []),
        (1, 4, "slide-5", "", "", None, []),
        (1, 5, "slide-6", "", "", None, []),
        (1, 6, "slide-7", "", "y.png", None, ["p", "q"]),
    ]
    assert got[7:] == [(2, 0, "slide-1", "", "", None, ["before", "still before"]), (2, 1, "one", "One", "one.png", 30.0, ["first snake_case is kept said", "![](a b)"])]


def test_fixtures_and_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text(json.dumps({"id": "one", "segments": [1]}))
    (tmp_path / "rates.json").write_text(json.dumps({"rates": {}}))
    assert [r["id"] for r in files.fixtures(spark, str(tmp_path), "id string, segments array<int>").collect()] == ["one"]
    raw = (tmp_path / "a.json").read_bytes()
    want = {n: hashlib.sha256(str(len(raw)).encode() + raw[: n or None]).hexdigest() for n in (0, 4)}
    for n in (0, 4):
        got = {r["path"].rpartition("/")[2]: r["hash"] for r in files.file_hashes(spark, str(tmp_path), prefix=n).collect()}
        assert got["a.json"] == want[n]


def test_csv_has_a_header(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]


def test_ring_across_two_runs(spark, tmp_path):
    source = tmp_path / "in"
    write = lambda ids: spark.createDataFrame(pd.DataFrame({"user_id": [1] * len(ids), "event_id": ids})).coalesce(1).write.mode("append").parquet(str(source))
    write([1, 2, 3])
    write([4, 5, 6])
    stream = activity.ring(activity.watch_folder(spark, str(source), "user_id long, event_id long", files_per_batch=1), keep=4)
    activity.run_available(stream, str(tmp_path / "run"), mode="update", name="ring_rows")
    last = spark.table("ring_rows").orderBy(F.desc("evicted")).first()
    assert list(last["newest"]) == [3, 4, 5, 6] and last["evicted"] == 2


def test_lines_are_put_together_from_partial_writes(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "ab"), (1, 2, "c\n10%\r20%\nre"), (1, 3, "st\n")], "stream long, seq long, data string").coalesce(1).write.parquet(str(source))
    stream = activity.assemble_lines(activity.watch_folder(spark, str(source), "stream long, seq long, data string"))
    activity.run_available(stream, str(tmp_path / "run"))
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "run/out")).collect()] == ["abc", "20%", "rest"]
