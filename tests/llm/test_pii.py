import hashlib
import random
import re

from pyspark.sql import functions as F

from cuemill.llm import pii
from cuemill.llm.queries import op7_pii

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (name, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def base(docs):
    return {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find_pii(docs).select("doc_id", "base").collect()}


def test_base_spans_against_the_plain_patterns(spark, make_docs):
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c_x@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.4", "4041894974608795", "4111 1111-1111 1111", "123456789012", "+1 (988) 555-2485", "+49-30.123 456 7)", "+1", "é𝄞", "word", ".", "-", " ", "  ", "\n", "99", "+12345678901234567"]
    texts = ["", None] + ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    assert base(make_docs(texts)) == {k: brute(t) for k, t in enumerate(texts)}


def test_long_runs(spark, make_docs):
    texts = ["7" * 200_000, "a" * 200_000, "x@" * 3000, "1.2.3.4 " * 3000, "ab@cd.ef " * 4000, "id-4711x " * 20_000]
    # The plain patterns take quadratic time on the first two, which hold no span.
    assert base(make_docs(texts)) == {k: brute(t) if k > 1 else [] for k, t in enumerate(texts)}


def test_contexts_of_seeds_discover_identifiers(spark, make_docs):
    texts = [f"Please contact member id: user{k}@mail.example.com today" for k in range(12)]
    texts += ["Please contact member id: QX-778812 today", "the year 20245612 was fine", "contact the member id: ZR-991 now"]
    rows = {r["doc_id"]: r["found"] for r in pii.find_pii(make_docs(texts)).collect()}
    assert [texts[12][s["start"] : s["end"]] for s in rows[12]] == ["QX-778812"]
    assert rows[13] == []
    assert all(rows[k] == [] for k in range(12))


def test_redaction(spark, make_docs):
    texts = ["mail a@b.cd, call +1 (988) 555-2485 or 10.0.0.1.", "clean text", None, "é𝄞 a@b.cd é", "a@b.cd"]
    docs = make_docs(texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[0][0] == "mail [EMAIL], call [PHONE] or [IP]."
    assert got[1] == ("clean text", 10) and got[2][0] is None
    assert got[3] == ("é𝄞 [EMAIL] é", 12) and got[4][0] == "[EMAIL]"


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a@b.cd"), (1, "a@b.cd"), (None, "1.2.3.4"), (None, None)]).withColumnRenamed("source", "base").withColumnRenamed("lang", "row")
    assert pii.find_pii(docs).count() == 4
    # "None" comes before "[".
    assert sorted((r["text"] for r in pii.redact(docs).collect()), key=str) == [None, "[EMAIL]", "[EMAIL]", "[IP]"]
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert pii.redact(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = [n for n, _ in PATTERNS]
    rows = op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_opaque_keys_seed_their_own_contexts(spark, make_docs):
    texts = [f'les token = "{hashlib.sha1(bytes([k])).hexdigest()}" enon' for k in range(8)] + ['le token = "77abc-9" et', "plain 4711-abc here"]
    rows = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"]] for r in pii.find_pii(make_docs(texts)).collect()}
    assert all(rows[k] == [hashlib.sha1(bytes([k])).hexdigest()] for k in range(8))
    assert rows[8] == ["77abc-9"] and rows[9] == []


def test_rounds_go_on_until_no_pattern_is_added(spark):
    # Each pattern is trusted only by what the one before it has found.
    rows = [("p0", f"v{k}", 1) for k in range(6)] + [(f"p{n}", f"v{k + 6 * d}", 0) for n in range(1, 7) for d in (n - 1, n) for k in range(6)]
    spans = spark.createDataFrame(rows, "pattern string, value string, seed int")
    names = lambda **o: sorted(r["pattern"] for r in pii.trusted_patterns(spans, precision=0.5, **o).collect())
    assert names() == [f"p{n}" for n in range(7)]
    assert names(rounds=2) == ["p0", "p1"]


def test_redaction_of_long_texts_with_many_spans(spark, make_docs):
    text = "x é𝄞 a@b.cd 10.0.0.1, " * 3000
    clean = "x é𝄞 [EMAIL] [IP], " * 3000
    long = "y" * 10_000 + " a@b.cd " + "z" * 9000
    edge = "a@b.cd " + "q " * 4093 + "1.2.3.4"
    got = {r["doc_id"]: r["text"] for r in pii.redact(make_docs([text, long, edge, None])).collect()}
    assert got == {0: clean, 1: long.replace("a@b.cd", "[EMAIL]"), 2: "[EMAIL] " + "q " * 4093 + "[IP]", 3: None}


def test_found_spans_against_the_planted_ones(spark):
    """Precision and recall of found spans against the form in which keys are planted in the test tables."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    planted = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    rows = pii.find_pii(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    found = {(r["doc_id"], s["start"], s["end"]) for r in rows for s in r["found"]}
    assert planted and len(found & planted) / len(planted) > 0.95
    assert sum(r["n_seeds"] for r in rows) < len(found)
    assert len(found & planted) / len(found) > 0.9


def keys(n):
    return [hashlib.sha1(f"k{k}".encode()).hexdigest() for k in range(n)]


def found_values(spark, make_docs, texts, **options):
    rows = pii.find_pii(make_docs(texts), **options).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"]] for r in rows}, sum(r["n_seeds"] for r in rows)


def test_withheld_keys_are_found_through_patterns_and_keys_alone_are_not(spark, make_docs):
    # Words around the keys differ from text to text: only what touches them repeats.
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    texts = [f"{w} key=<{v}> {w}x" for w, v in zip(words, keys(120), strict=True)] + [f"{w}y {v} {w}z" for w, v in zip(words, [x[::-1] for x in keys(60)], strict=False)]
    got, seeds = found_values(spark, make_docs, texts)
    assert all(got[k] == [v] for k, v in enumerate(keys(120)))
    assert all(got[k] == [] for k in range(120, 180))  # opaque, but no pattern introduces them
    assert 25 <= seeds <= 75
    assert found_values(spark, make_docs, texts, seed_percent=0) == ({k: [] for k in range(180)}, 0)


def test_a_pattern_with_other_instances_is_not_trusted(spark, make_docs):
    texts = [f"ref <{v}> end" for v in keys(20)] + [f"ref <{1000 + k}-{k}x> end" for k in range(200)]
    got, _ = found_values(spark, make_docs, texts)
    # Two tokens to the left introduce mostly other things; with the form of the value they introduce keys alone.
    assert all(got[k] == [v] for k, v in enumerate(keys(20))) and all(got[k] == [] for k in range(20, 220))


def test_contexts_to_the_right_and_to_the_left(spark):
    row = spark.sql("SELECT 'the  Key no. 77 (' AS l, ') of\nuser' AS r, 'ab12' AS v").select(pii._patterns(F.col("l"), F.col("r"), F.col("v")).alias("p")).first()
    assert row["p"] == ["l2 no. 00 (", "l1 00 ( h4", "r1 ) of h4", "lr ( h4 )"]
    row = spark.sql("SELECT '' AS l, '' AS r, '9' AS v").select(pii._patterns(F.col("l"), F.col("r"), F.col("v")).alias("p")).first()
    assert row["p"] == []


def test_no_python_in_the_plan(spark, make_docs):
    rows = pii.match_rows(make_docs(["x"]), keep=("doc_id",))
    for df in (rows, pii.spans_of(rows), pii.redact(make_docs(["a@b.cd"]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
