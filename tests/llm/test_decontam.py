import random
import re

import pytest

from cuemill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            b = words(text)
            n = min(window, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if grams and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(name))
        out[k] = (len(w), len(hit), sorted(found))
    return out


def result(docs, bench, **options):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.match_documents(docs, bench, **options).collect()}


def test_against_brute_force(spark, make_docs):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(25)] + [(99, None), (100, "Zwölf Über straße 9 z")]
    texts = ["", None, "..,,", "ZWÖLF über", "zwölf Über, Straße 9 z! zwölf über straße 9 z"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts += ["noise " + (items[k][1] or "") + " noise" for k in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(make_docs(texts), bench) == brute(list(enumerate(texts)), items)


def test_longest_match_and_place(spark, make_docs):
    item = " ".join(f"t{k}" for k in range(30))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    text = "a b c " + " ".join(f"t{k}" for k in range(4, 21)) + " d"
    r = decontam.match_documents(make_docs([text]), bench).first()
    assert (r["longest"], r["longest_item"], r["longest_start"], r["n_hit"]) == (17, "7", 3, 17)


def test_windows_do_not_cross_documents(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = result(make_docs(["a b c d e", "f g h i j"], partitions=1), bench)
    assert [got[k][1] for k in (0, 1)] == [0, 0]


def test_empty_tables_and_clashing_columns(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert result(make_docs(["a b"]), bench.limit(0)) == {0: (2, 0, [])}
    assert result(make_docs(["a b"]).limit(0), bench) == {}
    docs = make_docs(["x a b"]).withColumnRenamed("source", "n_hit").withColumnRenamed("lang", "items")
    assert result(docs, bench)[0] == (3, 2, ["1"])
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == []


def test_blocks_of_the_benchmark_give_the_same(spark, make_docs, monkeypatch):
    items = [(k, " ".join(f"v{(k * 7 + j) % 40}" for j in range(14))) for k in range(30)]
    texts = [" ".join(f"v{(k * 3 + j) % 40}" for j in range(60)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = result(make_docs(texts), bench)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert result(make_docs(texts), bench) == once == brute(list(enumerate(texts)), items)
    mixed = make_docs([*enumerate(texts), (90, "clean words"), (91, None), (None, texts[0]), (3, texts[3])])
    assert sorted(r["doc_id"] for r in decontam.decontaminate(mixed, bench).collect()) == [90, 91]
    assert decontam.match_documents(mixed, bench).count() == 24


def test_a_passage_shared_by_items_and_documents(spark, make_docs):
    passage = " ".join(f"p{k}" for k in range(15))
    items = [(k, f"{passage} own{k}") for k in range(40)]
    texts = [f"x{k} {passage} y" for k in range(30)] + [f"{passage} own3"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(make_docs(texts), bench) == brute(list(enumerate(texts)), items)


def test_very_long_text(spark, make_docs):
    item = " ".join(f"q{k}" for k in range(12))
    text = "filler " * 900_000 + item + " filler" * 1000
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert result(make_docs([text]), bench)[0] == (901_012, 12, ["1"])


@pytest.mark.parametrize("window", [1, 2, 5])
def test_other_windows(spark, make_docs, window):
    items, texts = [(1, "a b c a b d")], ["a b", "b d", "c a x a b d", "d"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(make_docs(texts), bench, window=window) == brute(list(enumerate(texts)), items, window)
