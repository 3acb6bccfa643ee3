import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tokenizers import Tokenizer

from cuemill.llm import packing
from cuemill.llm._tokens import Encoder
from cuemill.llm.queries import op1_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, limit=2048):
    tok = Tokenizer.from_file(PATH)
    expected = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        ids = expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(ids) > 0 and r["doc_tokens"] == len(expected[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    for k, ids in expected.items():
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) == len(ids)
    waste = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        size = sum(r["length"] for r in own)
        assert size <= limit
        waste += 0 if size & (size - 1) == 0 else limit - size
    return waste, sequences


def test_pieces_cover_each_document_once(spark, make_docs):
    rng = random.Random(3)
    texts = ["", None, "one", " a  b\n\tc ", "Ünïcode 中文 <|endoftext|>"] + [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta\n"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    docs = make_docs(texts)
    waste, _ = check(packing.pack_documents(docs, PATH).collect(), dict(enumerate(texts)))
    assert waste == 0


def test_very_long_text_and_empty_table(spark, make_docs):
    texts = ["word " * 60_000]
    check(packing.pack_documents(make_docs(texts), PATH).collect(), dict(enumerate(texts)))
    assert packing.pack_documents(make_docs(["x"]).limit(0), PATH).count() == 0


def test_clashing_extra_columns_are_ignored(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs(["a b c", "d"]).withColumn("start", F.lit("x")).withColumn("sequence_id", F.lit(7))
    assert {r["doc_id"] for r in packing.pack_documents(docs, PATH).collect()} == {0, 1}


def test_all_three_limits_hold(spark):
    # Prompts and answers balance, so that sequences can be filled although each limit binds.
    rows = [(k, "turn " * (5 + 37 * k % 90), None if k % 7 == 0 else 5 * (k % 60)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked long").repartition(2)
    out = packing.pack_documents(docs, PATH, max_tokens=256, max_segments=4, max_loss_tokens=100, prompt_chars="asked").collect()
    texts = {k: t for k, t, _ in rows}
    _, sequences = check(out, texts, 256)
    for own in sequences.values():
        assert len(own) <= 4
        assert sum(r["loss_tokens"] for r in own) <= 100
    tok = Tokenizer.from_file(PATH)
    for k, text, n in rows:
        own = [r for r in out if r["doc_id"] == k]
        prompt = len(tok.encode(text[: n or 0], add_special_tokens=False).ids)
        assert sum(r["loss_tokens"] for r in own) == own[0]["doc_tokens"] - prompt
    assert max(sum(r["loss_tokens"] for r in own) for own in sequences.values()) == 100
    assert max(map(len, sequences.values())) == 4


def test_prompts_end_where_their_characters_end():
    rng = random.Random(4)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name))
        for _ in range(300):
            text = "".join(rng.choice(["é", "a", " the", "\n", "中", " ", "<|endoftext|>", "1"]) for _ in range(rng.randint(0, 30)))
            plain = e.tok.encode(text, add_special_tokens=False)
            for n in (0, 1, 5, 100):
                got = e.prompt_ids(text, n, np.array(plain.ids, np.int64))
                if e.id_bytes is None:
                    assert got == len(e.tok.encode(text[:n], add_special_tokens=False).ids)
                else:
                    at = np.cumsum([0, *e.id_bytes[plain.ids]])[:-1]
                    assert sum(e.id_bytes[plain.ids]) == len(text.encode()) and got == int((at < len(text[:n].encode())).sum())


def test_repeated_rows_are_packed_each(spark, make_docs):
    out = packing.pack_documents(make_docs([(1, "same text"), (1, "same text")]), PATH).collect()
    assert sum(r["length"] for r in out) == 2 * out[0]["doc_tokens"]


def test_limits_must_be_positive(spark, make_docs):
    with pytest.raises(ValueError):
        packing.pack_documents(make_docs(["x"]), PATH, max_segments=0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_by_parts_equals_whole_texts(name):
    rng = random.Random(5)
    letters = [*"ab é'st\n\t   　\x1c1 2,.!Ω中ß́<|endoftext|>", "<|endoftext|>", "<|startoftext|>", " <|endoftext|> ", "<|EndOfText|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for special_as_text in (False, True):
        e = Encoder(public_tokenizers.path(name), special_as_text)
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = special_as_text
        assert e.by_parts
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_characters_of_each_class_against_the_plain_call(name):
    rng = random.Random(11)
    ranges = [(0x20, 0x7F), (0xC0, 0x130), (0x131, 0x180), (0x400, 0x460), (0x2010, 0x2028), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0x300, 0x370), (0x590, 0x5F0), (0x600, 0x6FF), (0x900, 0x980), (0xAC00, 0xAD00), (0x1F600, 0x1F650), (0x2000, 0x2010), (0x0, 0x20), (0x2150, 0x2190), (0x1D400, 0x1D500)]
    texts = []
    for lo, hi in ranges:
        for _ in range(60):
            texts.append("".join(chr(rng.choice([rng.randrange(lo, hi), rng.randrange(lo, hi), 32, 97, 49, 46, 39])) for _ in range(40)))
    e, plain = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_spelt_special_tokens_are_those_tokens():
    e = Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(["a <|endoftext|> b"])] == [[64, 220, 50256, 275]]


def test_query_over_whole_table(spark):
    rows = op1_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    waste, sequences = check(rows, texts)
    # The loss limit leaves at most 16 of 2048 places open, the segment limit more where documents are tiny.
    assert waste <= 0.01 * sum(r["length"] for r in rows)
    assert all(len(own) <= 8 and sum(r["loss_tokens"] for r in own) <= 2032 for own in sequences.values())
