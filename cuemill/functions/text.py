"""Text expressions: names, scripts, bleed, inflection, cleanup, similarity.

Built-in expressions except where noted; the difflib ratio is a small pandas function, balanced chunks come from an Arrow one.
"""

from __future__ import annotations

import difflib
import re
from array import array
from collections.abc import Iterator
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

#: Letters that an alphabet lacks.
FOREIGN = {"bg": "іїєґыэё", "ru": "іїєґ", "uk": "ыэёъ", "mk": "іїєґыэёщъ"}
#: Scripts as regular-expression classes.
SCRIPTS = {
    "latin": r"A-Za-z\x{00C0}-\x{024F}",
    "cyrillic": r"\x{0400}-\x{04FF}\x{0500}-\x{052F}",
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "bengali": r"\x{0980}-\x{09FF}",
    "gujarati": r"\x{0A80}-\x{0AFF}",
    "gurmukhi": r"\x{0A00}-\x{0A7F}",
    "tamil": r"\x{0B80}-\x{0BFF}",
    "telugu": r"\x{0C00}-\x{0C7F}",
    "kannada": r"\x{0C80}-\x{0CFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}",
    "sinhala": r"\x{0D80}-\x{0DFF}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "lao": r"\x{0E80}-\x{0EFF}",
    "khmer": r"\x{1780}-\x{17FF}",
    "burmese": r"\x{1000}-\x{109F}",
    "georgian": r"\x{10A0}-\x{10FF}\x{1C90}-\x{1CBF}",
    "armenian": r"\x{0530}-\x{058F}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "japanese": r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
}
#: Languages that are written in one script other than Latin.
SCRIPT_OF = {
    "ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "mk": "cyrillic", "el": "greek", "he": "hebrew",
    "ar": "arabic", "fa": "arabic", "ur": "arabic", "hi": "devanagari", "mr": "devanagari", "ne": "devanagari",
    "bn": "bengali", "gu": "gujarati", "ta": "tamil", "te": "telugu", "kn": "kannada", "ml": "malayalam",
    "si": "sinhala", "th": "thai", "lo": "lao", "km": "khmer", "my": "burmese", "ka": "georgian", "hy": "armenian",
    "ko": "hangul", "ja": "japanese", "zh": "han",
}
#: Scripts in which capital letters mark names.
CASED = ("latin", "cyrillic", "greek")
#: Numerals of Chinese and Japanese beside digits.
HAN_NUMERALS = "〇零一壹二貳贰三參叁四肆五伍六陸陆七柒八捌九玖十拾百佰千仟万萬億兆"
#: What a model writes about a translation instead of the translation.
META_PROSE = (
    r"(?i)(the user (?:wants|asked|is asking|provided)|here(?:'s| is) (?:the|my) translation|source text\s*:|breakdown and translation"
    r"|combining and refining|let me (?:translate|think|break)|i(?:'ll| will| can) translate|as an ai\b|okay,? (?:so )?the user)"
)
#: Abbreviations after which a period ends no sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "sra", "jr", "st", "vs", "etc", "no", "nos", "art", "arts", "fig", "vol", "sec", "ch", "pp",
    "approx", "inc", "ltd", "lic", "e.g", "i.e", "u.s", "u.k", "a.m", "p.m",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
]
CONTRACTIONS = ("s", "m", "d", "t", "re", "ve", "ll")


def words(text: Column) -> Column:
    """Lower-case word tokens of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{5,}"), 0))


def foreign_letters(text: Column, language: str) -> Column:
    """The distinct letters that the language's alphabet lacks, sorted; empty for other languages."""
    letters = FOREIGN.get(language[:2].lower())
    if not letters:
        return F.lit("")
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]"), 0))), "")


def repeated_source_words(source: Column, target: Column) -> Column:
    """Long words without digits that the target repeats from the source."""
    return F.filter(F.array_intersect(long_words(target), long_words(source)), lambda w: ~F.regexp_like(w, F.lit("[0-9]")))


def script_of(language: str) -> str:
    """Script of a language code; Latin unless it is known to be another."""
    return SCRIPT_OF.get(language.strip().lower()[:2], "latin")


def letters_in(text: Column, script: str) -> tuple[Column, Column]:
    """Letters of a text, and those of them in the script."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    return F.length(letters), F.length(F.regexp_replace(letters, f"[^{SCRIPTS[script]}]+", ""))


def in_script(text: Column, language: str) -> Column:
    """Whether a text of at least 8 letters has 30 % of them in the language's script; always true for Latin."""
    if script_of(language) == "latin":
        return F.lit(True)
    letters, inside = letters_in(text, script_of(language))
    return (letters < 8) | (inside >= letters * F.lit(0.3))


def rejected(source: Column, target: Column, *, language: str = "") -> Column:
    """Why a translation can't be one: empty, too long, prose about the task, wrong script; null if it can."""
    t = F.trim(F.coalesce(target, F.lit("")))
    out = F.when(F.length(t) == 0, "empty").when(F.length(t) > F.greatest(F.lit(80), F.length(source) * 5), "too long")
    return out.when(F.regexp_like(t, F.lit(META_PROSE)), "prose about the task").when(~in_script(t, language), "wrong script")


def digits(text: Column, language: str = "") -> Column:
    """Digits of any script; for Chinese and Japanese their numerals too."""
    more = HAN_NUMERALS if script_of(language) in ("han", "japanese") else ""
    return F.length(F.regexp_replace(text, rf"[^\p{{Nd}}{more}]+", ""))


#: Pairs of quotation marks that may wrap a whole reply.
QUOTE_PAIRS = {'"': '"', "'": "'", "«": "»", "“": "”", "„": "“", "”": "”"}


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_reply(text: Column) -> Column:
    """A model's reply without what it adds to a translation.

    That is: thinking blocks, a label in front, lines that repeat the task ("Text to translate: ..."), the token that
    switches thinking off, code ticks, and one pair of quotation marks around the whole; quotation marks inside stay.
    """
    out = _bare(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))
    out = F.regexp_replace(out, r"(?iuU)\A\s*(?:Translation|Перевод)\s*:\s*", "")
    out = F.regexp_replace(out, r"(?m)^\s*Text(?: to translate)?\s*:.*$", "")
    out = F.regexp_replace(out, r"(?iU)/no_?think\b", "")
    out = _bare(F.regexp_replace(_bare(out), "^`+|`+$", ""))
    first, last, inner = F.left(out, F.lit(1)), F.right(out, F.lit(1)), F.substring(out, F.lit(2), F.length(out) - 2)
    wrapped = F.lit(False)
    for opening, closing in QUOTE_PAIRS.items():
        wrapped = wrapped | ((first == opening) & (last == closing))
    return _bare(F.when((F.length(out) > 1) & wrapped & ~F.contains(inner, last), inner).otherwise(out))


def bleed(source: Column, target: Column, target_lang: str, source_lang: str = "") -> Column:
    """What shows that a translation carries its source; empty if nothing does.

    Letters that the target's alphabet lacks come first. Long words repeated from the source count only between two
    languages of one script: across scripts they are names and numbers, which should carry over. Three words are shown.
    """
    ours, theirs = target_lang[:2].lower(), source_lang[:2].lower()
    if not ours:
        return F.lit("")
    foreign = foreign_letters(target, target_lang)
    out = F.when(foreign != "", F.concat(F.lit(f"non-{target_lang} letters '"), foreign, F.lit("'")))
    if theirs and ours != theirs and SCRIPT_OF.get(ours) == SCRIPT_OF.get(theirs):
        repeated = F.array_sort(repeated_source_words(source, target))
        shown = F.concat(F.lit(f"verbatim {source_lang} word(s) ['"), F.array_join(F.slice(repeated, 1, 3), "', '"), F.lit("']"))
        out = out.when(F.size(repeated) > 0, shown)
    return out.otherwise("")


#: Inline markup and what of it is spoken.
INLINE = [
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(\*\*|__)(.+?)\1", "$2"),
    (r"(?U)(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", "$1"),
    (r"(?U)(?<![\w_])_(?!\s)(.+?)(?<!\s)_(?![\w_])", "$1"),
    ("`", ""),
]


def strip_markup(text: Column) -> Column:
    """Links, emphasis and code ticks reduced to their text, white space at the ends cut; underscores inside words stay."""
    for pattern, kept in INLINE:
        text = F.regexp_replace(text, pattern, kept)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_head(token: Column) -> Column:
    """ "Marvin's" without its contraction."""
    return F.regexp_replace(token, rf"(?i)(.)['’](?:{'|'.join(CONTRACTIONS)})$", "$1")


def source_names(text: Column, stopwords: list[str]) -> Column:
    """Capitalised words of at least three letters that aren't all capitals or stop words, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z’'-]{2,}"), 0), name_head)
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & (w != F.upper(w)) & ~F.lower(w).isin(stopwords or [""]))
    return F.array_distinct(kept)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(n == 0, 0).when(F.size(at) > 0, at[0] - 1).otherwise(n).cast("int")


def same_stem(a: Column, b: Column) -> Column:
    """Whether two words share a stem with short endings (of the whole, or of their first hyphened parts)."""

    def close(x: Column, y: Column) -> Column:
        n = common_prefix(F.lower(x), F.lower(y))
        longer = F.greatest(F.length(x), F.length(y))
        return (n >= F.greatest(F.lit(3.0), longer * 0.6)) & (F.length(x) - n <= 3) & (F.length(y) - n <= 3)

    return close(a, b) | close(F.split(a, "-")[0], F.split(b, "-")[0])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks similarity of the standard library; feed it distinct, blocked pairs."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


_OPENERS, _CLOSERS = r"\"'“‘(\[¿¡", r"\"'”’)\]"
#: The end of a sentence: not inside a run of marks; a single period not after an abbreviation or an initial. A mark comes
#: first, so that what stands before it is looked at there and not at every character.
_STOP = (
    rf"(?=[.!?…])(?<![.!?…])((?:(?<!(?:^| )[{_OPENERS}]{{0,4}}(?i:{'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)}|\p{{L}}))\.(?!\.)|\.(?=\.)|[!?…])"
    rf"[.!?…]*+[{_CLOSERS}]*+) (?=[\p{{Lu}}\p{{Nd}}{_OPENERS}])"
)


def sentences(text: Column) -> Column:
    """Sentences of a paragraph, its blanks collapsed; abbreviations and initials don't end one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.filter(F.split(F.regexp_replace(flat, _STOP, "$1\u0001"), "\u0001"), lambda x: x != "")


#: What a cut costs beside the squared share by which a piece differs from the even length: inside a clause, and behind
#: a short clause that leads into the next one ("and third,"). A piece over the limit (a long word) costs nothing more.
INSIDE_CLAUSE, BEHIND_LEAD_IN = 1.0, 2.0
_CLAUSE_MARKS, _LEAD_IN = (";", ":", ",", "—", "–"), 14
#: Characters of chunks that a task gives on together.
_HELD = 1 << 18


def cut_costs(words: list[str]) -> list[float]:
    """What a cut behind each word costs; nothing behind the last one."""
    out = [cost for _, cost in _priced(" ".join(words))]
    return [*out[:-1], 0.0]


def _priced(flat: str) -> Iterator[tuple[int, float]]:
    """Where each word of a text with single blanks ends, and what a cut behind it costs, word by word."""
    clause = -1
    for m in re.finditer("[^ ]+", flat):
        w = m[0]
        clause += 1 + len(w)
        ends = w.endswith(_CLAUSE_MARKS)
        yield m.end(), (0.0 if ends else INSIDE_CLAUSE) + (BEHIND_LEAD_IN if w.endswith(",") and clause <= _LEAD_IN else 0.0)
        clause = -1 if ends else clause


def balanced_chunks(text: str | None, most: int) -> list[str]:
    """Pieces of at most ``most`` characters with the least total cost of their cuts and lengths; a longer word stays whole.

    Blanks are collapsed. The even length is the text's over the fewest pieces it could have. The cheapest way to cut the
    text before each word is found from those of the words before it, as far back as a piece can reach.
    """
    flat = re.sub(r"\s+", " ", text or "").strip(" ")
    if len(flat) <= most:
        return [flat] if flat else []
    even = len(flat) / -(-len(flat) // most)
    # Numbers in arrays: a long text's words are never all held as objects.
    starts, best, origin, first = array("q", [0]), array("d", [0.0]), array("q", [0]), 0
    for k, (end, cost) in enumerate(_priced(flat)):
        while first < k and end - starts[first] > most:
            first += 1
        found, where = inf, first
        for i in range(first, k + 1):
            if (price := best[i] + ((end - starts[i]) / even - 1) ** 2) < found:
                found, where = price, i
        best.append(found + (cost if end < len(flat) else 0.0))
        origin.append(where)
        starts.append(end + 1)
    pieces, stop = [], len(origin) - 1
    while stop:
        pieces.append(flat[starts[origin[stop]] : starts[stop] - 1])
        stop = origin[stop]
    return pieces[::-1]


def chunk_rows(docs: DataFrame, most: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, chunk): a row for each balanced chunk of each text; null and blank texts have none.

    A task cuts one text after another and gives its rows on in small batches, so it holds one text's chunks and some rows.
    """
    fields = docs.select(key).schema.add("pos", IntegerType()).add("chunk", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = ([], [], []), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names)

        names = [key, "pos", "chunk"]
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                for pos, piece in enumerate(balanced_chunks(t.as_py(), most)):
                    for column, value in zip(out, (k.as_py(), pos, piece), strict=True):
                        column.append(value)
                    held += len(piece)
                    if held > _HELD:
                        yield flush()
                        out, held = ([], [], []), 0
        if held:
            yield flush()

    return docs.select(key, text).mapInArrow(run, fields)


def is_latin(token: Column) -> Column:
    """Whether a token has letters, all of them Latin."""
    letters = F.regexp_replace(token, r"\P{L}+", "")
    return (F.length(letters) > 0) & ~F.regexp_like(letters, F.lit(r"[^\x{0000}-\x{024F}]"))


#: A word with its inner apostrophes and hyphens, and a capitalised Latin one.
WORD = r"\p{L}+(?:[’'-]\p{L}+)*"
NAME = r"\b[A-Z][A-Za-z’'-]{2,}\b"


def name_spots(text: Column, stopwords: list[str]) -> Column:
    """(name, initial) of a line's capitalised words, each once; ``initial``: it is the line's first word."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NAME), 0), name_head)
    names = F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & (x != F.upper(x)) & ~F.lower(x).isin(stopwords or [""])))
    # Only the first of them can begin the line.
    leads = F.regexp_like(text, F.lit(r"^\P{L}*" + NAME)) & (F.get(found, F.lit(0)) == F.get(names, F.lit(0)))
    spots = lambda some, initial: F.transform(some, lambda x: F.struct(x.alias("name"), initial.alias("initial")))
    head = F.when(leads, spots(F.slice(names, 1, 1), F.lit(True))).otherwise(spots(F.slice(names, 1, 1), F.lit(False)))
    return F.when(F.size(names) > 0, F.concat(head, spots(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), F.lit(False)))).otherwise(F.array().cast("array<struct<name:string,initial:boolean>>"))


def target_candidates(text: Column, cased: bool) -> Column:
    """A translated line's words that may render a name: three letters, capitalised but not all capitals; Latin only, unless the script has case."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & (w != F.upper(w)) & F.regexp_like(w, F.lit(r"^\p{Lu}")))
    return kept if cased else F.filter(kept, is_latin)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text between characters that aren't letters, whatever its case."""
    quoted = F.regexp_replace(F.trim(phrase), r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?iu)(?<!\p{L})"), quoted, F.lit(r"(?!\p{L})")))


def duplicate_score(ratio: Column, seconds_a: Column, seconds_b: Column, *, tolerance: float = 5.0) -> Column:
    """The title ratio, halved if both durations are known and differ by more than the tolerance."""
    far = F.abs(seconds_a - seconds_b) > tolerance
    return F.when(far, ratio * 0.5).otherwise(ratio)


def duplicate_verdict(best: Column) -> Column:
    return F.when(best >= 0.85, "likely_duplicate").when(best >= 0.6, "possible").otherwise("clear")
