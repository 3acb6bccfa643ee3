import public_tokenizers
import pytest

from cuemill.llm._tokens import Encoder

ODD = [
    "", " ", "\n", "a  b\n c \n\nd  ", " 'll 've A'S a's", "x\n", "\nx y\n z", "tab\tand\r\nreturn", "\x1c \x85 \xa0x",
    "é İstanbul ǅ ²³ ½ ſs 'S 'Ll", "é x́ y", "한국어 ١٢ Ω≈ç √ ｆｕｌｌ", "日本語、テスト。 ﾊﾝ", "…—–‘’“”",
    "<|endoftext|>a<|startoftext|> b", "__init__ a_b _ 12.5% (x)!", "\U0001f600\U0001f601 ok", "word " * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name, monkeypatch):
    encoder = Encoder(public_tokenizers.path(name))
    assert encoder.splits is not None
    want = encoder._raw(ODD)
    assert list(encoder.encode(ODD)) == want
    assert list(encoder.encode(ODD)) == want  # through the caches
    monkeypatch.setattr("cuemill.llm._tokens.CACHE_BYTES", 800)
    assert list(encoder.encode(ODD)) == want
    encoder.splits = None
    for cache in (encoder.firsts, encoder.others, encoder.loose):
        cache.clear()
    assert list(encoder.encode(ODD)) == want
