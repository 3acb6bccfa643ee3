"""Queries of the corpus operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import bpe, decontam, jaccard, langid, lloyd, negatives, packing, pii, sharding, tokenbin, topk, toxicity, warc
from cuemill.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("prompt", F.expr(packing.FIRST_LINE))
    return packing.pack_documents(docs, packing.default_tokenizer(), prompt_chars="prompt", cache_bytes=512 << 20, **packing.LIMITS)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.top_k(vectors, queries, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    # The query's language is the nearest one; whether the distance rejects it stands beside it.
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "distance", "rejected")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenbin.new_folder(spark)
    manifest = tokenbin.write_tokens(table(spark, sf_dir, "documents"), folder, tokenbin.default_tokenizer())
    return tokenbin.read_tokens(spark, folder, manifest).drop("ids")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_context"),
        "n_seeds",
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=75)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), topk.quantise(F.col("embedding"), 256).alias("v"))
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"), positives=5, k=10, low_percent=30, high_percent=90)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    return lloyd.cluster(vectors, k=16, rounds=3, width=64)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_bpe": op13_bpe,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _lloyd_sql(rounds: int) -> str:
    """One CTE for each round's assignment and means; floor division is spelt out, as DuckDB's cuts towards zero."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "SELECT vec_id, any_value(v) AS v, min(ROW(d, n)) AS best FROM (SELECT x.vec_id, x.v, c.n, {far}::BIGINT AS d FROM x, {cents} c) GROUP BY vec_id"
    steps = []
    for r in range(rounds):
        own = nearest.format(far=far, cents=f"c{r}")
        steps.append(f"a{r} AS ({own})")
        steps.append(f"""m{r} AS (
            SELECT n, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS v
            FROM (SELECT best[2] AS n, i, sum(v[i])::BIGINT AS s, count(*) AS k FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY n)""")
        steps.append(f"c{r + 1} AS (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (n))")
    steps.append(f"f AS ({nearest.format(far=far, cents=f'c{rounds}')})")
    return f"""
        WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h LIMIT 16)),
        {", ".join(steps)}
        SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
               (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM f JOIN c{rounds} c ON best[2] = c.n"""


ORACLES: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id != d.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, payload_bytes >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload_digest) AS again,
                     min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to FROM f""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
              FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM g),
        o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
              FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, i, o.n, item_id FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g
              FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * common >= 75 * (ca.n + cb.n - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, reached) AS (SELECT doc_id, doc_id FROM c UNION SELECT node, b FROM r JOIN e ON reached = a),
        k AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k ON d.doc_id = k.node""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_inner_product(a.v, d.v)::BIGINT AS score
            FROM v a JOIN v d ON a.vec_id % 100 = 0 AND a.vec_id != d.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_centroid_clustering": _lloyd_sql(3),
}
