import random
import re

import numpy as np
import pytest

from cuemill.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def result(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = ["", None, "  \t ", "one two", "ONE two", "one two three four five", "One two\nthree four five"]
    passage = [f"p{k}" for k in range(40)]
    for _ in range(6):
        base = [f"b{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        rows += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(12)]
    rows += [" ".join([f"r{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))] + passage) for _ in range(25)]
    chain = [f"c{k}" for k in range(60)]
    for _ in range(10):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark, make_docs):
    rows = corpus(2)
    assert result(make_docs(rows)) == brute(rows)


def common(seed):
    """Most documents share a passage; many differ in little else, some are near copies of each other."""
    rng = random.Random(seed)
    passage, rows = [f"p{k}" for k in range(60)], []
    for _ in range(70):
        own = [f"r{rng.randrange(10**6)}" for _ in range(rng.randint(0, 45))]
        rows.append(" ".join(own + passage if rng.random() < 0.5 else passage + own))
        if rng.random() < 0.3:
            rows.append(" ".join(edited(rng, rows[-1].split(), rng.randint(1, 3))))
    rows += [" ".join(edited(rng, [f"g{k}" for k in range(80)], 4)) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_common_shingles_in_long_lists_cut_into_blocks(spark, make_docs, monkeypatch, seed):
    for name, value in (("HOT", 6), ("REPORTED", 2), ("LONG", 5), ("SHORT", 4), ("BLOCK", 8), ("TOGETHER", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = common(seed)
    assert result(make_docs([*rows, rows[0], rows[1]])) == brute(rows)


def test_one_of_each_with_null_and_repeated_ids(spark, make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "own text of no id here"), (None, "own text of no id here"), (None, None), (2, ""), (3, None), (4, "x y z w v u"), (4, "quite another text for this id")]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(make_docs(rows)).collect()), key=str)
    assert [k for k, _ in kept if k is not None] == [1, 2, 3, 4]
    assert [t for k, t in kept if k is None] == ["own text of no id here", None]
    assert jaccard.one_of_each(make_docs(rows).limit(0)).count() == 0


def test_threshold_is_inclusive(spark, make_docs):
    # 7 of 8, 6 of 8 and 5 of 8 shingles shared: words 0..10 against shorter runs.
    w = [f"x{k}" for k in range(12)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:10])), (2, " ".join([*w[:9], "y"]))]
    assert result(make_docs(rows)) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark, make_docs):
    docs = make_docs([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    docs = docs.withColumnRenamed("source", "root").withColumnRenamed("lang", "size")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (None, 0, None), (None, 2, None)]


def test_empty_table(spark, make_docs):
    assert result(make_docs(["x"]).limit(0)) == {}


def test_large_group_of_near_copies(spark, make_docs):
    rng = random.Random(8)
    base = [f"g{k}" for k in range(150)]
    rows = list(enumerate([" ".join(edited(rng, base, 3)) for _ in range(200)] + [" ".join(base)]))
    assert result(make_docs(rows)) == brute(rows)


def test_one_of_each_keeps_the_columns(spark, make_docs):
    docs = make_docs([(4, "a b c d e f"), (2, "a b c d e f"), (9, "z"), (8, "")])
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 8, 9]


def test_bitmap_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m, k = rng.integers(1, 3000, 3)
        k = min(int(k), int(n), int(m))
        pool = rng.integers(0, 2**63, int(n + m), dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:k], pool[n : n + m - k]])
        shared = len(np.intersect1d(a, b))
        assert jaccard.most_shared(jaccard.parity_bitmap(a), len(a), jaccard.parity_bitmap(b), len(b)) >= shared


def test_very_long_text(spark, make_docs):
    long = " ".join(str(k) for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, "short text only")]
    assert result(make_docs(rows)) == {1: (119_996, 1), 2: (119_997, 1), 3: (1, 3)}


def test_repeated_ids_with_different_texts(spark, make_docs):
    # Ids 0 to 29 have two texts each, in both orders; 100 + k is a near copy of one of them.
    rows = []
    for k in range(30):
        own = [(k, " ".join(f"{side}{k}w{i}" for i in range(40))) for side in "ab"]
        rows += own if k % 2 else own[::-1]
        rows.append((100 + k, own[1][1] + f" z{k}"))
    found = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(make_docs(rows)).collect()}
    assert found == {(k, k % 100) for k in [*range(30), *range(100, 130)]}
