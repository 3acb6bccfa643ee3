import random

from pyspark.sql import functions as F

from cuemill.llm import langid, toxicity
from cuemill.llm.queries import op4_toxicity, op5_language_id

SF = "/root/testdata/sf0.01"


def auc(pairs):
    pairs = sorted(pairs)
    ranks = [k for k, (_, y) in enumerate(pairs) if y]
    p = len(ranks)
    return (sum(ranks) - p * (p - 1) / 2) / (p * (len(pairs) - p))


def sentences(rng, n, insults=()):
    plain = [a + b for a in ("mor", "tel", "wan", "pri", "lo", "sen") for b in ("ta", "ning", "der", "vos", "li")]
    out = []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 25))]
        if insults:
            words[rng.randrange(len(words))] = rng.choice(insults)
        out.append(" ".join(words))
    return out


def test_toxicity_learns_words_and_their_disguises():
    rng = random.Random(2)
    model = toxicity.fit_texts(sentences(rng, 150, ["bloggard", "zwickel", "frumpet"]), sentences(rng, 200))

    def value(text):
        words = [w for t in toxicity.tokens_of(text) for w in toxicity.words_of(t)]
        return model.score(float(model.words(words).max())) if words else model.score(model.bias)

    for text in ("you bloggard", "zwickel!", "a frumpet.", "bloggaard here", "z w i c k e l", "zwi-ckel"):
        assert value("morta wander " + text) > 0.5, text
    for text in ("morta wander", "prining lovos", "", "a b", "12 34"):
        assert value(text) < 0.5, text


def test_toxicity_edge_rows(spark, make_docs):
    rng = random.Random(3)
    model = toxicity.fit_texts(sentences(rng, 60, ["zwickel"]), sentences(rng, 80))
    long = "morta " * 300_000 + "zwickel"
    rows = [(1, None), (2, ""), (3, long), (4, "zwickel"), (4, "zwickel"), (None, "tella")]
    docs = make_docs(rows).withColumnRenamed("source", "score")
    got = sorted(((r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect()), key=str)
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (4, 1), (None, 0)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert sorted((r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()), key=str) == [1, 2, None]


def test_toxicity_without_labels(spark, make_docs):
    labels = spark.createDataFrame([(0, None)], "doc_id long, toxic int")
    assert toxicity.fit(make_docs(["a text"]), labels) is None


def test_toxicity_held_out(spark):
    rows = op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "toxic").collect()
    assert auc([(r[0], r[1]) for r in rows]) > 0.9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op5_language_id(spark, SF).join(docs, "doc_id").where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert rows[0] > 0.9


def test_language_edge_rows(spark, make_docs):
    texts = [("aa", " ".join(["the cat sat on the mat"] * 3)), ("bb", "der hund lief über die straße"), ("bb", "eine straße über den hund"), (None, "ignored"), ("aa", None), ("aa", "the dog and the cat")]
    labelled = spark.createDataFrame(texts, "lang string, text string")
    model = langid.fit(labelled)
    assert model.languages == ["aa", "bb"]
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the cat"), (5, "über die straße " * 100_000), (4, "the cat"), (None, "x")]
    docs = make_docs(rows).withColumnRenamed("source", "score")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb")} <= got
    assert langid.predict(docs, model).count() == 7
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.fit(labelled.limit(0)) is None


def test_language_rejection_by_distance(spark, make_docs):
    labelled = spark.createDataFrame([("aa", "the cat sat on the mat"), ("bb", "der hund lief")], "lang string, text string")
    model = langid.fit(labelled, reject_beyond=0.5)
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.predict(make_docs(["the cat sat on the mat", "ξένη γλώσσα"]), model).collect()}
    assert got == {0: ("aa", False), 1: ("und", True)}


def test_calibrated_rejection(spark, make_docs):
    rng = random.Random(5)
    words = {"aa": ["the", "cat", "sat", "mat", "house", "which"], "bb": ["der", "hund", "lief", "über", "straße", "nicht"]}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(5, 40)))) for lang, w in words.items() for _ in range(150)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert 0 < model.reject_beyond < 1
    texts = ["the cat sat which house mat " * 4, "ξένη γλώσσα και άλλα πολλά ακόμη", "der hund lief über nicht straße " * 4]
    got = {r["doc_id"]: (r["nearest"] != "und", r["lang_pred"], r["rejected"]) for r in langid.predict(make_docs(texts), model).collect()}
    assert got == {0: (True, "aa", False), 1: (True, "und", True), 2: (True, "bb", False)}


def test_language_sample_is_bounded_and_covers_copies(spark, make_docs):
    rows = [("aa", f"text {k} of many") for k in range(3000)] + [("aa", "a hot copy")] * 2000 + [("bb", f"rare {k}") for k in range(7)] + [("aa", "x" * 500)]
    table = spark.createDataFrame(rows, "l string, t string").repartition(4)
    found = langid.sample_of(table, 100, 400).to_pylist()
    assert sum(r["l"] == "aa" for r in found) == 100 and sum(r["l"] == "bb" for r in found) == 7
    assert len({r["t"] for r in found}) == len(found)
    assert found == langid.sample_of(table.repartition(7), 100, 400).to_pylist()


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    import numpy as np

    text = np.frombuffer("Größe und Häuser, viele! ".encode() * 40, np.uint8)
    whole = langid.term_counts(text, np.array([0, len(text)]))
    monkeypatch.setattr(langid, "PART", 7)
    assert (langid.term_counts(text, np.array([0, len(text)])) == whole).all()


def test_toxicity_kernel_against_plain_subsequences():
    from collections import Counter
    from itertools import combinations

    import numpy as np

    def weights(word):
        out = Counter()
        for i in combinations(range(len(word)), 3):
            if i[2] - i[0] < toxicity.SPAN:
                out["".join(word[k] for k in i)] += toxicity.DECAY ** (i[2] - i[0] + 1)
        return out

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(30)]
    kernel = toxicity.Kernel.of(Counter("".join(words)))
    got = kernel.matrix(words, words[:10])
    for i, a in enumerate(words):
        for j, b in enumerate(words[:10]):
            x, y = weights(a), weights(b)
            norms = kernel.norms(np.array([len(a), len(b)]))
            assert abs(got[i, j] - sum(v * y[k] for k, v in x.items()) / norms.prod()) < 1e-5


def test_toxicity_fit_limits(spark, make_docs):
    docs = make_docs(["zwickel " * 30, "a clean text", "too long " * 50])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, fit_chars=300) is not None
    assert toxicity.fit(docs, labels, fit_chars=100) is None
    assert toxicity.fit(docs, labels, fit_rows=1) is not None
