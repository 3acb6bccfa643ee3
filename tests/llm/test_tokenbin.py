import zlib

import numpy as np
import public_tokenizers
import pytest

from cuemill.llm import tokenbin
from cuemill.llm.queries import op6_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for k, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_round_trip(spark, make_docs):
    texts = ["", None, "Hello, World", "long " * 30_000, *[f"document {k} about {k % 7}" for k in range(200)]]
    folder = tokenbin.new_folder(spark)
    manifest = tokenbin.write_tokens(make_docs(texts), folder, PATH)
    got = [tuple(r) for r in tokenbin.read_tokens(spark, folder, manifest).orderBy("doc_id").collect()]
    assert [(a, b, c, d, list(e)) for a, b, c, d, e in got] == expected(list(enumerate(texts)))
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(texts)


def test_empty_table(spark, make_docs):
    folder = tokenbin.new_folder(spark)
    manifest = tokenbin.write_tokens(make_docs(["x"]).limit(0), folder, PATH)
    assert manifest.count() == 0


def test_one_document_is_read_alone_and_bad_files_are_refused():
    out = tokenbin.TokenFileWriter(tokenbin.train_dictionary([b"ab" * 50] * 40))
    for k in (3, 5, 9):
        out.add(k, np.arange(k, dtype=np.uint32))
    raw = out.to_bytes()
    book = tokenbin.TokenFile(raw)
    assert book.find(5).tolist() == [0, 1, 2, 3, 4]
    assert book.find(4) is None
    with pytest.raises(ValueError):
        tokenbin.TokenFile(b"x" * len(raw))
    damaged = bytearray(raw)
    damaged[60] ^= 1
    with pytest.raises(ValueError):
        tokenbin.TokenFile(bytes(damaged))


def test_dictionary_with_few_samples():
    assert tokenbin.train_dictionary([]) == b""
    out = tokenbin.TokenFileWriter(tokenbin.train_dictionary([b"few"]))
    out.add(None, np.array([1, 2], np.uint32))
    book = tokenbin.TokenFile(out.to_bytes())
    assert book.key(0) is None and book.ids(0).tolist() == [1, 2]


def test_query_over_whole_table(spark):
    got = [tuple(r) for r in op6_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == [x[:4] for x in expected(rows)]


def test_repeated_and_null_keys_long_texts_and_clashing_columns(spark, make_docs):
    rows = [(7, "same row"), (7, "same row"), (None, "no key"), (None, None), (2, "wörd " * 200_000), (7, "other text <|endoftext|> here")]
    docs = make_docs(rows).withColumnRenamed("source", "k").withColumnRenamed("lang", "h")
    folder = tokenbin.new_folder(spark)
    manifest = tokenbin.write_tokens(docs, folder, PATH)
    got = tokenbin.read_tokens(spark, folder, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 2, 7, 7, 7]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    want = {(k, crc) for k, _, _, crc, _ in expected([(k or -1, t) for k, t in rows])}
    assert {(-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got} == want


def test_the_dictionary_pays_for_itself():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 40_000, 60).astype(np.uint32)
    docs = [np.concatenate([common[k % 30 : k % 30 + 20], rng.integers(0, 40_000, 5).astype(np.uint32)]) for k in range(3000)]
    raw = tokenbin.train_dictionary([d.astype("<u2").tobytes() for d in docs[:1000]])
    sizes = {}
    for name, dictionary in (("with", raw), ("without", b"")):
        out = tokenbin.TokenFileWriter(dictionary)
        for k, d in enumerate(docs):
            out.add(k, d)
        sizes[name] = len(out.to_bytes())
    assert sizes["with"] < 0.8 * sizes["without"]
