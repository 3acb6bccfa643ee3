import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("189", 189), ("189s", 189), ("189.5", 189), ("189S", 189), ("1.5s", 1), ("3:07", 187), ("3:7", 187), ("1:02:03", 3723), ("N/A", None), ("", None), ("-4", -4), ("1:2:3:4", None), ("a:b", None), ("nan", None)],
)
def test_durations(spark, text, seconds):
    assert one(spark, scalars.parse_duration(F.lit(text))) == seconds


@pytest.mark.parametrize(("text", "value"), [("3.5", 3.5), ("NaN", None), ("inf", None), ("-Infinity", None), ("N/A", None), (None, None)])
def test_finite(spark, text, value):
    assert one(spark, scalars.finite(F.lit(text).cast("string"))) == value
    assert one(spark, scalars.safe_number(F.lit(text).cast("string"))) == (value or 0.0)


def test_states_and_severity(spark):
    rows = [("complete",), ("error",), ("cancelled",), ("paused",), ("running",), ("odd",), (None,)]
    got = values(spark, rows, "s string", a=scalars.state(F.col("s")), b=scalars.severity(scalars.state(F.col("s"))))
    assert got == [("done", "ok"), ("failed", "bad"), ("cancelled", "warn"), ("attention", "warn"), ("active", "ok"), ("other", "ok"), ("other", "ok")]


def test_source_label(spark):
    rows = [("batch", "title", "x", 1), (" ", "title", "x", 1), (None, None, "a -> b -> c", 1), (None, "", None, 7), (None, None, None, None)]
    got = values(spark, rows, "a string, b string, c string, d int", x=scalars.source_label(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert [x for (x,) in got] == ["batch", "title", "a -> b", "7", "unknown"]


def test_secrets_and_masks(spark):
    text = "hf_abcdefgh12 Bearer abcdefgh.12345 api_key=zzzz, token: t1; password='hunter22' Authorization: abcd rest"
    assert one(spark, scalars.redact_secrets(F.lit(text))) == "[redacted] Bearer [redacted] api_key=[redacted], token: t1; password=[redacted] Authorization: [redacted] rest"
    assert [x for (x,) in values(spark, [("abcdefgh",), ("abc",), ("",)], "s string", x=scalars.mask(F.col("s")))] == ["abcd…", "…", None]


def test_signatures_ignore_what_varies(spark):
    a = "Cannot read /data/jobs/12/out.wav at 0xFF after 3.5 s"
    b = "cannot  read /data/jobs/999/other.wav at 0x1a after 12 s"
    sign = lambda t, stage="tts": one(spark, scalars.error_signature(F.lit(stage), F.lit(t)))
    assert sign(a) == sign(b) and len(sign(a)) == 12
    assert one(spark, scalars.normalise_error(F.lit("Job 1234abcd failed: C:\\tmp\\x y 12.5s 0x1F 01234567-89ab-cdef-0123-456789abcdef"))) == "job <hex> failed: <path> y <n>s <hex> <id>"
    assert sign(a) != sign(a, "translate") and sign(a) != sign("Cannot write it")


def test_word_contains(spark):
    got = [one(spark, scalars.word_contains(F.lit(t), "new york")) for t in ("In New York.", "newyork", "xnew york", "NEW YORK2", None)]
    assert got == [True, False, False, True, None]


def test_clock(spark):
    assert one(spark, scalars.clock_ms(F.lit(3723004))) == "01:02:03,004"
    assert one(spark, scalars.clock_ms(F.lit(-5))) == "00:00:00,000"


def test_error_rate(spark):
    rows = [("abc", "abd"), ("", ""), ("x", ""), ("", "ab"), ("日本", "日本語")]
    got = [x for (x,) in values(spark, rows, "a string, b string", x=scalars.error_rate(F.col("a"), F.col("b")))]
    assert got == pytest.approx([1 / 3, 0.0, 1.0, 1.0, 1 / 3])


def test_script_ratio(spark):
    got = [one(spark, scalars.script_ratio(F.lit(t), tx.SCRIPTS["cyrillic"])) for t in ("мир", "world", "ми ab", "12!")]
    assert got == [1.0, 0.0, 0.5, 1.0]


def test_foreign_letters(spark):
    assert one(spark, tx.foreign_letters(F.lit("Это её"), "bg-BG")) == "эё"
    assert one(spark, tx.foreign_letters(F.lit("Это"), "en")) == ""


def test_rejections(spark):
    cases = [("hi", "", "empty"), ("hi", "x" * 81, "too long"), ("hi", "Here is the translation: ho", "prose about the task"), ("hello there", "hello there friend", "wrong script"), ("hello", "привет", None), ("hi", None, "empty")]
    got = values(spark, [(a, b) for a, b, _ in cases], "a string, b string", x=tx.rejected(F.col("a"), F.col("b"), language="ru"))
    assert [x for (x,) in got] == [c for *_, c in cases]


def test_stems(spark):
    pairs = [("translation", "translations", True), ("cat", "dog", False), ("walk", "walked", True), ("ab", "abc", False), ("Mother-Land", "mothers", True)]
    got = values(spark, [p[:2] for p in pairs], "a string, b string", x=tx.same_stem(F.col("a"), F.col("b")))
    assert [x for (x,) in got] == [p[2] for p in pairs]


def test_ratio_is_the_standard_library_one(spark):
    pairs = [("hello world", "hello word"), ("", ""), ("abc", None), ("x" * 250, "x" * 249 + "y")]
    got = values(spark, pairs, "a string, b string", x=tx.sequence_ratio("a", "b"))
    assert [x for (x,) in got] == pytest.approx([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs])


def test_sentences(spark):
    text = "Dr. Smith came at 5 p.m. on Monday. He said: “Go!” Then J. Doe left... and nobody spoke. ¿Why?"
    assert one(spark, tx.sentences(F.lit(text))) == ["Dr. Smith came at 5 p.m. on Monday.", "He said: “Go!”", "Then J. Doe left... and nobody spoke.", "¿Why?"]
    assert one(spark, tx.sentences(F.lit(None).cast("string"))) == []


def test_markup_and_replies(spark):
    assert one(spark, tx.strip_markup(F.lit("**bold** [x](http://y) `code` *it*"))) == "bold x code it"
    assert one(spark, tx.clean_reply(F.lit('<think>hm</think>Translation: "Hola"'))) == "Hola"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The U.S. Supreme Court ruled in No. 34. It took 3.5 years.", ["The U.S. Supreme Court ruled in No. 34.", "It took 3.5 years."]),
        ('He said "Stop." Then he left.', ['He said "Stop."', "Then he left."]),
        ("It cost 1,672 days. 2021 came and went.", ["It cost 1,672 days.", "2021 came and went."]),
        ("wait... and see", ["wait... and see"]),
        ("Wait... Then go", ["Wait...", "Then go"]),
        ("  spaced \n out.   Twice.  ", ["spaced out.", "Twice."]),
        ("(Mr. Smith) left. lower stays", ["(Mr. Smith) left. lower stays"]),
        ("Is it Mr.! No", ["Is it Mr.! No"]),
        ("11 Dec. 2014 was cold", ["11 Dec. 2014 was cold"]),
    ],
)
def test_sentence_ends(spark, text, want):
    assert one(spark, tx.sentences(F.lit(text))) == want


def test_chunks_keep_all_words_within_the_limit():
    text = "First, the court ordered a delimitation; second, it set a deadline of twelve months, which passed in February 2021, and third, it archived the file three days later without checking whether anything had actually been done."
    for most in (40, 78, 120, 220):
        got = tx.balanced_chunks(text, most)
        assert " ".join(got) == text and max(map(len, got)) <= most
        assert not any(x.endswith("third,") for x in got)
    assert tx.balanced_chunks("a " + "x" * 50 + " b", 10) == ["a", "x" * 50, "b"]
    assert tx.balanced_chunks("", 10) == [] and tx.balanced_chunks(None, 10) == [] and tx.balanced_chunks("short", 10) == ["short"]
    even = tx.balanced_chunks("word " * 20, 80)
    assert len(even) == 2 and min(map(len, even)) > 30


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('<think>hm\n</think> Translation: "Hola"', "Hola"),
        ("<reasoning>a</reasoning>ПЕРЕВОД : «да»", "да"),
        ("Text to translate: Hello\nHola /no_think", "Hola"),
        ("/nothink Hola /nothinking", "Hola /nothinking"),
        ("```Hola```", "Hola"),
        ('"Hola" dijo "ella"', '"Hola" dijo "ella"'),
        ('"Hola» y', '"Hola» y'),
        ("„Guten Tag“", "Guten Tag"),
        ("“Hola»", "“Hola»"),
        ('"', '"'),
        (None, ""),
    ],
)
def test_replies_lose_their_scaffolding(spark, reply, want):
    assert one(spark, tx.clean_reply(F.lit(reply).cast("string"))) == want


def test_bleed_needs_foreign_letters_or_a_language_of_the_same_script(spark):
    found = lambda s, t, *langs: one(spark, tx.bleed(F.lit(s), F.lit(t), *langs))
    assert found("Вони прийшли", "Те дойдоха і ї", "bg", "uk") == "non-bg letters 'ії'"
    assert found("прийшли вчора разом", "разом те прийшли вчора 12345", "bg", "mk") == "verbatim mk word(s) ['вчора', 'прийшли', 'разом']"
    assert found("Madrid hello", "Мадрид hello", "ru", "en") == "" == found("hello there", "hello", "de", "de")
    assert found("hello", "hello x", "de") == "" == found("hello", "hello", "", "en")
    assert found("hello word1 hello", "hello word1", "de", "en") == "verbatim en word(s) ['hello']"


def test_chunks_have_the_least_cost():
    from itertools import product

    rng = random.Random(6)

    def cost(words, cuts, even):
        """Of all pieces that the marks ``cuts`` (behind which words) make; None where one is too long."""
        total, first, prices = 0.0, 0, tx.cut_costs(words)
        for k, cut in enumerate((*cuts, True)):
            if cut:
                piece = " ".join(words[first : k + 1])
                if len(piece) > 20 and k > first:
                    return None, None
                total += prices[k] + (len(piece) / even - 1) ** 2
                first = k + 1
        return total, cuts

    for _ in range(40):
        words = ["x" * rng.choice([1, 3, 5, 8, 25]) + rng.choice(["", "", ",", ";", "—"]) for _ in range(rng.randint(2, 9))]
        flat = " ".join(words)
        got = tx.balanced_chunks(flat, 20)
        assert " ".join(got) == flat
        if len(flat) <= 20:
            continue
        even = len(flat) / -(-len(flat) // 20)
        least = min(c for c, _ in (cost(words, cuts, even) for cuts in product((False, True), repeat=len(words) - 1)) if c is not None)
        ends, marks = 0, set()
        for piece in got:
            ends += len(piece.split())
            marks.add(ends - 1)
        assert abs(cost(words, tuple(k in marks for k in range(len(words) - 1)), even)[0] - least) < 1e-9


def test_chunks_at_clauses():
    got = tx.balanced_chunks("The court ordered a delimitation of the forest; second, it set a deadline of twelve months for the agency.", 60)
    assert not any(c.endswith("second,") for c in got) and any(c.startswith("second,") for c in got)
    assert [len(x) for x in tx.balanced_chunks("word " * 20_000, 80)][:3] == [79, 79, 79]


def test_failed_downloads(spark):
    blob = lambda t: scalars.output_blob(F.lit(t), F.lit(None))
    shape = lambda t: one(spark, scalars.failure_class(blob(t), scalars.FAILURE_SHAPES))
    assert [shape(t) for t in ("HTTP Error 403: Forbidden and Sign in to confirm you’re not a bot", "n challenge solving failed", "timed out", "403: Forbidden", "?")] == ["bot-check", "challenge-unsolved", "network", "forbidden", "unknown"]
    kind = lambda t: one(spark, scalars.failure_class(blob(t), scalars.DOWNLOAD_CLASSES))
    assert [kind(t) for t in ("status code 403", "error 403 forbidden", "timeout", "Requested format is not available", "only 403")] == ["persistent-403", "persistent-403", "network", "format", "unknown"]
    assert one(spark, scalars.error_line(F.lit("WARNING: a\nERROR: b\n ERROR: c \nend"), F.lit(""))) == "ERROR: c"
    assert one(spark, scalars.error_line(F.lit(" "), F.lit("x" * 400))) == "x" * 300
    assert one(spark, scalars.error_line(F.lit("1 a\n\tERROR: 0 x 1 \r\n2"), F.lit(None))) == "ERROR: 0 x 1"
    assert one(spark, scalars.error_line(F.lit("\t\n"), F.lit(" "))) == one(spark, scalars.error_line(F.lit(None), F.lit(None))) == scalars.SILENT
    assert one(spark, scalars.error_detail(F.lit("ERROR: b\nERROR: c"))) == "ERROR: b"
    assert one(spark, scalars.error_detail(F.lit("0 x\n  ERROR: 1 b 1 \nERROR: c"))) == "ERROR: 1 b 1"
    assert one(spark, scalars.error_detail(F.lit(" 7 end 7 "))) == "7 end 7"
    assert one(spark, scalars.rescue_commands(F.lit("age-gate"), F.lit("http://a b'c"))) == ["yt-dlp --cookies-from-browser firefox 'http://a b'\"'\"'c'"]
    assert one(spark, scalars.rescue_commands(F.lit("network"), F.lit(None))) == ["yt-dlp <URL>"]


def test_other_small_rules(spark):
    assert one(spark, scalars.epoch_seconds(F.lit("1754300000"))) == 1754300000.0
    assert one(spark, scalars.epoch_seconds(F.lit("2026-08-05T02:00"))) == 1785895200.0
    assert one(spark, scalars.epoch_seconds(F.lit("soon"))) is None
    assert one(spark, scalars.qa_text(F.lit("Hello,  «мир»!\t(ok)"))) == "hello мир ok"
    assert [one(spark, scalars.is_pair(F.lit(a), F.lit(b))) for a, b in (("es", "es-419"), ("pt-BR", "PT"), ("en", "de"))] == [False, False, True]
    assert one(spark, tx.digits(F.lit("18 ١٨ १८ 十八"))) == 6 and one(spark, tx.digits(F.lit("18 ١٨ १८ 十八"), "ja")) == 8
    assert [one(spark, tx.rejected(F.lit("hello"), F.lit(t))) for t in ("Okay, so the user wants", "Source text: x", "I'll translate", "ok")] == ["prose about the task"] * 3 + [None]
    assert [one(spark, tx.has_phrase(F.lit("In New-York (C++) today"), F.lit(p))) for p in ("new-york", "York", "C++", "tod", "In")] == [True, True, True, False, True]
