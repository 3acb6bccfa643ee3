import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest

from cuemill.llm import bpe
from cuemill.llm.queries import op13_bpe

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", "\n", "a  b\n c \n\nd  ", " 'll 've A'S a's", "x\n", "\nx y\n z", "tab\tand\r\nreturn", "\x1c \x85 \xa0x",
    "é İstanbul ǅ ²³ ½ ſs 'S 'Ll ΣΑΣ", "é x́ y", "한국어 ١٢ Ω≈ç √ ｆｕｌｌ", "日本語、テスト。 ﾊﾝ", "…—–‘’“”",
    "<|endoftext|>a<|startoftext|> b <|endoftext", "x<|endoftext|><|endoftext|>", "__init__ a_b _ 12.5% (x)!", "\U0001f600\U0001f601 ok", "word " * 3000,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "antidisestablishmentarianism" * 9,
]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def plain(symbols, merges):
    """The definition: the leftmost of the lowest-ranked pairs is merged until none is left."""
    symbols = list(symbols)
    while True:
        found = [(merges.one[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges.one]
        if not found:
            return symbols
        rank, k = min(found)
        symbols[k : k + 2] = [int(merges.made[rank])]


def toy():
    vocab = {c: k for k, c in enumerate("abcd")}
    pairs = [("a", "a"), ("b", "a"), ("aa", "b"), ("c", "d"), ("aa", "aa"), ("ba", "cd"), ("d", "c")]
    for a, b in pairs:
        vocab[a + b] = len(vocab)
    return bpe.Merges(vocab, pairs)


def test_both_trees_against_the_definition():
    merges, rng = toy(), random.Random(1)
    rows = [[rng.randrange(4) for _ in range(n)] for n in range(34) for _ in range(12)] + [[0] * 31, [0] * 32, [1, 0] * 9]
    assert [bpe.merge_long(r, merges) for r in rows] == [plain(r, merges) for r in rows]
    wide = np.full((len(rows), 34), -1)
    for k, r in enumerate(rows):
        wide[k, : len(r)] = r
    done = bpe.merge_forest(wide, merges)
    assert [r[r >= 0].tolist() for r in done] == [plain(r, merges) for r in rows]
    for width in (1, 2, 3, 4, 5):
        some = [r for r in rows if len(r) == width]
        done = bpe.merge_forest(np.array(some), merges)
        assert [r[r >= 0].tolist() for r in done] == [plain(r, merges) for r in some]


@pytest.mark.parametrize("name", NAMES)
def test_ids_and_texts_are_the_librarys(name):
    tok, own, back = library(name), bpe.TreeEncoder(public_tokenizers.path(name)), bpe.Decoder(public_tokenizers.path(name))
    assert own.splits is not None and own.drops_blanks == (name == NAMES[0])
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["ing", " ", "th", "é", "'s", "7", "\n", "zq", "Ω", "-", "<|endoftext|>", "a" * 70]) for _ in range(60)) for _ in range(60)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for own in (own, bpe.TreeEncoder(public_tokenizers.path(name), cache_bytes=900)):
        assert [ids_of(x) for x in own.encode(texts)] == want
        assert [ids_of(x) for x in own.encode(texts)] == want  # through the caches
    own.splits = None
    for cache in own.bound.caches:
        cache.clear()
    assert [ids_of(x) for x in own.encode(texts)] == want
    assert [back.text(np.array(x, np.int64)) for x in want] == [tok.decode(x, skip_special_tokens=False) for x in want]


def test_a_long_piece_takes_little_more_than_linear_time():
    own = bpe.TreeEncoder(public_tokenizers.path(NAMES[0]))
    rng = random.Random(2)
    took = []
    for n in (20_000, 80_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        began = time.process_time()
        found = [ids_of(x) for x in own.encode([text])]
        took.append(time.process_time() - began)
        assert found == [library(NAMES[0]).encode(text, add_special_tokens=False).ids]
    assert took[1] < 10 * took[0]


def test_whole_table_against_the_library(spark):
    sf, tok = "/root/testdata/sf0.001", library(NAMES[0])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in op13_bpe(spark, sf).collect()) == sorted(want)


def test_encoded_and_decoded_tables(spark, make_docs):
    tok, path = library(NAMES[1]), public_tokenizers.path(NAMES[1])
    texts = [None, *ODD, "same", "same"]
    docs = make_docs([(k if k % 5 else None, t) for k, t in enumerate(texts)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "x")
    encoded = bpe.encode_documents(docs, path)
    want = sorted((tuple(tok.encode(t or "", add_special_tokens=False).ids) for t in texts))
    assert sorted(tuple(r["ids"]) for r in encoded.collect()) == want
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, path).collect()) == sorted(t or "" for t in texts)
    assert bpe.round_trip(docs.limit(0), path).count() == bpe.encode_documents(docs.limit(0), path).count() == 0
    odd = spark.createDataFrame([(1, [5, None, -2, 10**9]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(odd, path).collect()} == {1: tok.decode([5]), 2: None, 3: ""}


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path(NAMES[0]), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["dropout"] = 0.5
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.TreeEncoder(str(tmp_path / "t.json"))
