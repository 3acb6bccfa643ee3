"""Queries without SQL take all rows and whole texts: small tables against brute force."""

import difflib
import re

import pytest

from cuemill.plans import registry

LONG = "same words at the start of every one of these long texts, well beyond sixty letters, "


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(2, "a short text"), (3, LONG + "then apples"), (4, LONG + "then oranges"), (5, LONG + "then apples"), (7, "Other, words!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in docs], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(43, LONG + "then apples"), (1, "not the first word: a short text")], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    talk = [(1, 0, "user", "x" * 90), (1, 1, "assistant", "y" * 60 + "different after sixty")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    near = [(k, [float(k % 2 == 0), float(k % 2), 0.01 * k], k % 2) for k in (1, 21, 41, 2, 22, 3)]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def read(d, name, spark):
    return spark.read.parquet(f"{d}/{name}.parquet").collect()


def test_duplicate_score(spark, tables):
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    want = {}
    for a in read(tables, "part", spark):
        scores = []
        for b in read(tables, "nation", spark):
            ratio = difflib.SequenceMatcher(None, plain(a["p_name"]), plain(b["n_name"])).ratio()
            scores.append(ratio * (0.5 if abs(a["p_partkey"] % 40 - b["n_nationkey"] % 40) > 5 else 1))
        best = max(scores)
        want[a["p_partkey"]] = (pytest.approx(best), "likely_duplicate" if best >= 0.85 else "possible" if best >= 0.6 else "clear")
    got = {r["p_partkey"]: (r["best"], r["verdict"]) for r in registry.QUERIES["duplicate_score"](spark, tables).collect()}
    assert got == want and want[3][1] == "likely_duplicate"


def test_cer(spark, tables):
    # "x " before and "ab "s after the text: that many insertions in the whole strings.
    from cuemill.sources.standin import segments

    want = {}
    for r in segments(spark, tables).collect():
        longest = max(len(r["text"]), len(r["translated"]))
        want[r["job"], r["idx"]] = pytest.approx((longest - min(len(r["text"]), len(r["translated"]))) / longest)
    assert {(r["job"], r["idx"]): r["cer"] for r in registry.QUERIES["cer"](spark, tables).collect()} == want


def test_greedy_match_takes_odd_vectors(spark, tables):
    got = {r["a"] for r in registry.QUERIES["greedy_match"](spark, tables).collect()}
    assert {1, 21, 41} & got and 3 in got


def test_duplicate_suffix_takes_whole_texts(spark, tables):
    from cuemill.functions import scalars
    from pyspark.sql import functions as F

    slugs = {r["doc_id"]: r["s"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", scalars.slug(F.col("text")).alias("s")).collect()}
    seen, want = {}, {}
    for k in sorted(slugs):
        seen[slugs[k]] = nth = seen.get(slugs[k], 0) + 1
        want[k] = slugs[k] if nth == 1 else f"{slugs[k]}-{nth}"
    assert {r["doc_id"]: r["unique_id"] for r in registry.QUERIES["duplicate_suffix"](spark, tables).collect()} == want
    assert want[2] == "a-short-text"
