"""Column expressions: states, safe numbers, labels, redaction, error signatures, durations, predicates.

All are built-in expressions, so they run inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status vocabulary by state.
STATES = {
    "done": ["complete"],
    "failed": ["error", "interrupted"],
    "cancelled": ["cancelled"],
    "attention": ["awaiting_translation_review", "paused"],
    "active": [
        "preparing", "queued", "scheduled", "uploaded", "running", "downloading", "extracting", "transcribing",
        "diarizing", "translating", "synthesizing", "assembling", "merging",
    ],
}
UNBILLED = ["error", "cancelled", "failed"]
SEVERITY_RANK = {"bad": 0, "warn": 1, "ok": 2}


def state(status: Column) -> Column:
    """done, failed, cancelled, attention, active or other."""
    out = F.when(F.lit(False), "")
    for name, values in STATES.items():
        out = out.when(status.isin(values), name)
    return out.otherwise("other")


def severity(job_state: Column) -> Column:
    return F.when(job_state == "failed", "bad").when(job_state.isin("attention", "cancelled"), "warn").otherwise("ok")


def severity_rank(level: Column) -> Column:
    """0 for bad, 1 for warn, 2 for ok, 3 for anything else."""
    return F.when(level == "bad", 0).when(level == "warn", 1).when(level == "ok", 2).otherwise(3)


def safe_number(text: Column) -> Column:
    """The number in ``text``; 0 where there is none or it isn't finite."""
    return F.coalesce(finite(text), F.lit(0.0))


def finite(text: Column) -> Column:
    """The number in ``text``, or null where there is none or it isn't finite."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def present(text: Column) -> Column:
    """Trimmed text; null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def source_label(batch_label: Column, title: Column, label: Column, job_id: Column) -> Column:
    """The first that isn't blank; the third loses its last " -> " suffix."""
    return F.coalesce(present(batch_label), present(title), present(F.regexp_replace(present(label), r" -> (?!.* -> ).*$", "")), job_id.cast("string"), F.lit("unknown"))


def parse_duration(text: Column) -> Column:
    """Whole seconds in "189", "189.5", "189S", "m:ss" or "h:mm:ss" (any case); null otherwise."""
    t = F.regexp_replace(F.lower(F.trim(text)), "s$", "")
    parts = F.transform(F.split(t, ":"), lambda p: F.trim(p).try_cast("long"))
    clock = F.aggregate(parts, F.lit(0).cast("long"), lambda total, n: total * 60 + n)
    return F.when(F.contains(t, F.lit(":")), F.when(F.size(parts).between(2, 3), clock)).otherwise(finite(t).try_cast("long"))


def normalise_title(text: Column) -> Column:
    """Lower case, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "))


#: What counts as a credential, most specific first, and what stays in front of it.
SECRETS = [
    (r"\bhf_[A-Za-z0-9]{8,}", "[redacted]"),
    (r"(?i)(Bearer\s+)([A-Za-z0-9._\-]{8,})", "$1[redacted]"),
    (r"(?i)((?:token|secret|api[_-]?key|password|authorization)\s*[=:]\s*)([\"']?)([^\s\"',}]{4,})\2", "$1[redacted]"),
]


def redact_secrets(text: Column) -> Column:
    """Access tokens, bearer credentials and key=value secrets of at least four characters replaced, quotes included."""
    for pattern, kept in SECRETS:
        text = F.regexp_replace(text, pattern, kept)
    return text


def mask(text: Column) -> Column:
    """The first four characters and an ellipsis; shorter text is hidden whole."""
    return F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 4), F.lit("…"))).when(F.length(text) > 0, F.lit("…"))


#: The parts of an error message that differ from run to run, in the order in which they are replaced.
VOLATILE = [
    (r"[a-z]:\\[^\s'\"]+", "<path>"),
    (r"(?U)(?:/[\w.@-]+){2,}", "<path>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
    (r"\b[0-9a-f]{8,}\b", "<hex>"),
    (r"0x[0-9a-f]+", "<hex>"),
    (r"\b\d+(?:\.\d+)?", "<n>"),
]


def normalise_error(text: Column) -> Column:
    """Lower case with paths, ids, hexadecimal and other numbers as placeholders; at most 300 characters."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, name in VOLATILE:
        out = F.regexp_replace(out, pattern, name)
    return F.left(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(300))


def error_signature(stage: Column, message: Column) -> Column:
    """Twelve hexadecimal digits that equal failures share."""
    return F.left(F.sha2(F.concat(F.coalesce(stage, F.lit("")), F.lit("|"), normalise_error(message)), 256), F.lit(12))


def iso_seconds(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")


def clock_ms(ms: Column, separator: str = ",") -> Column:
    """hh:mm:ss,mmm of whole milliseconds."""
    whole = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(whole / 3600000), 2), F.lit(":"), part(F.floor(whole / 60000) % 60, 2), F.lit(":"), part(F.floor(whole / 1000) % 60, 2), F.lit(separator), part(whole % 1000, 3))


def percent_delta(now: Column, before: Column) -> Column:
    """Change in per cent; null where there was nothing before."""
    return F.when(before > 0, (now - before) / before * 100.0)


def word_contains(text: Column, term: str) -> Column:
    """Whether ``term`` stands in ``text`` between characters that aren't letters, whatever its case."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in term)
    return F.regexp_like(text, F.lit(rf"(?iU)(?<!\p{{L}}){quoted}(?!\p{{L}})"))


def key_state(revoked: Column, expires: Column, last_used: Column, now: Column) -> Column:
    week = F.expr("INTERVAL 7 DAYS")
    return F.when(revoked, "revoked").when(expires < now, "expired").when(expires < now + week, "expiring").when(last_used.isNull(), "idle").otherwise("active")


#: Words of a failed download's output by shape, in the order in which they are looked for.
FAILURE_SHAPES = {
    "gone": ["video unavailable", "this video has been removed", "private video", "account associated with this video has been terminated", "video is not available"],
    "bot-check": ["sign in to confirm you're not a bot", "use --cookies-from-browser or --cookies"],
    "age-gate": ["sign in to confirm your age", "age-restricted", "inappropriate for some users"],
    "geo-block": ["not available in your country", "not made this video available in your country", "video is geo restricted"],
    "challenge-unsolved": ["challenge solving failed", "failed to solve", "unable to solve", "could not solve", "no challenge solver", "nsig extraction failed", "unable to extract nsig", "only images are available"],
    "format-unavailable": ["requested format is not available", "requested format not available"],
    "network": ["timed out", "connection reset", "temporary failure in name resolution", "connection refused", "network is unreachable"],
    "forbidden": ["http error 403", "status code 403", "403: forbidden"],
}
#: The same for the classes that come with commands ("persistent-403" is found by its own rule).
DOWNLOAD_CLASSES = {
    "bot-check": ["sign in to confirm you're not a bot", "use --cookies-from-browser or --cookies"],
    "age-gate": ["sign in to confirm your age", "age-restricted", "inappropriate for some users"],
    "geo-block": ["not available in your country", "not made this video available in your country", "geo restriction", "geo-restricted", "unavailable from your location", "blocked it in your country"],
    "persistent-403": [],
    "format": ["requested format is not available", "no video formats found", "only images are available"],
    "network": ["getaddrinfo failed", "temporary failure in name resolution", "name or service not known", "connection refused", "connection reset", "network is unreachable", "urlopen error", "timed out", "timeout", "ssl:"],
}
#: Which commands a class comes with; {} is the quoted source.
COMMANDS = {
    "embedded": 'yt-dlp --extractor-args "youtube:player_client=web_embedded" {}',
    "cookies": "yt-dlp --cookies-from-browser firefox {}",
    "plain": "yt-dlp {}",
    "update": "yt-dlp -U",
    "formats": "yt-dlp -F {}",
}
CLASS_COMMANDS = {
    "bot-check": ["cookies", "embedded"],
    "age-gate": ["cookies"],
    "geo-block": ["embedded", "plain"],
    "persistent-403": ["embedded", "cookies", "update", "plain"],
    "format": ["plain", "formats", "update"],
    "network": ["plain"],
    "unknown": ["update", "plain"],
}
#: An unsolved challenge, as against a run that merely mentions one.
CHALLENGE = ["failed to solve", "unable to solve", "could not solve", "no challenge solver", "nsig extraction failed", "unable to extract nsig"]


def _any_in(low: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def output_blob(stderr: Column, stdout: Column) -> Column:
    """Both outputs in lower case with plain apostrophes."""
    return F.replace(F.lower(F.concat_ws(" ", F.coalesce(stderr, F.lit("")), F.coalesce(stdout, F.lit("")))), F.lit("’"), F.lit("'"))


def is_forbidden(blob: Column) -> Column:
    """Whether an output is about HTTP status 403."""
    return _any_in(blob, ["http error 403"]) | (F.contains(blob, F.lit("403")) & _any_in(blob, ["forbidden", "status code 403"]))


def needs_challenge_solver(blob: Column) -> Column:
    return _any_in(blob, CHALLENGE)


def failure_class(blob: Column, needles: dict[str, list[str]]) -> Column:
    """The first class one of whose needles occurs in the blob; else unknown."""
    out = F.when(F.lit(False), "")
    for name, words in needles.items():
        out = out.when(_any_in(blob, words) if words else is_forbidden(blob), name)
    return out.otherwise("unknown")


#: Fixed value: what is said of a run that printed nothing.
SILENT = "yt-dlp failed without writing an error"


def _stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _error_lines(stderr: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(stderr, F.lit("")), r"\r\n|\n|\r"), lambda x: _stripped(x))
    return F.filter(lines, lambda x: F.startswith(x, F.lit("ERROR:")))


def error_line(stderr: Column, stdout: Column) -> Column:
    """The last line that begins with ERROR:, indented or not, 300 characters of it; else the last 300 of what was printed."""
    tail = F.coalesce(F.nullif(_stripped(stderr), F.lit("")), F.nullif(_stripped(stdout), F.lit("")))
    return F.coalesce(F.left(F.try_element_at(_error_lines(stderr), F.lit(-1)), F.lit(300)), F.right(tail, F.lit(300)), F.lit(SILENT))


def error_detail(stderr: Column) -> Column:
    """The first line that begins with ERROR:, else the output's begin; 200 characters of it."""
    return F.left(F.coalesce(F.try_element_at(_error_lines(stderr), F.lit(1)), _stripped(F.coalesce(stderr, F.lit("")))), F.lit(200))


def shell_quoted(text: Column) -> Column:
    """One shell word: as it is if harmless, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(F.regexp_like(text, F.lit(r"^[A-Za-z0-9_@%+=:,./-]+$")), text).otherwise(quoted)


def rescue_commands(name: Column, source: Column) -> Column:
    """The commands of a failure class for a source ("<URL>" where it is blank)."""
    target = F.when(F.coalesce(source, F.lit("")) != "", shell_quoted(source)).otherwise("<URL>")
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for kind, keys in CLASS_COMMANDS.items():
        out = out.when(name == kind, F.array(*[F.replace(F.lit(COMMANDS[k]), F.lit("{}"), target) for k in keys]))
    return out


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 from a number or an ISO-8601 time (in the session's zone, if it names none); null otherwise."""
    return F.coalesce(finite(F.trim(text)), F.try_to_timestamp(F.trim(text)).cast("double"))


def qa_text(text: Column) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def group_name(text: Column) -> Column:
    return F.lower(F.trim(text))


def base_language(code: Column) -> Column:
    """The first two letters of a language code, in lower case."""
    return F.left(F.lower(F.trim(code)), F.lit(2))


def is_pair(source: Column, target: Column) -> Column:
    """Whether two codes are of different languages, regions aside."""
    return F.left(F.lower(F.coalesce(source, F.lit(""))), F.lit(2)) != F.left(F.lower(F.coalesce(target, F.lit(""))), F.lit(2))


def salted_hash(token: Column, salt: Column) -> Column:
    return F.sha2(F.concat(salt, token), 256)


def guidance(base: Column, override: Column, floor: float, cross: Column) -> Column:
    """The override, if there is one (0 is none); else the base, between languages at least ``floor``."""
    return F.coalesce(F.nullif(override, F.lit(0)), F.when(cross, F.greatest(base, F.lit(floor))).otherwise(base))


def batch_limits(context: Column, lines: Column, chars: Column) -> Column:
    """(lines, chars) of one request: as set, or from the model's context (0 is unset)."""
    size = F.coalesce(F.nullif(context, F.lit(0)), F.lit(8192))
    most = F.coalesce(F.nullif(lines, F.lit(0)), F.greatest(F.lit(4), F.least(F.lit(24), F.floor(size / 512))))
    text = F.coalesce(F.nullif(chars, F.lit(0)), F.greatest(F.lit(800), F.least(F.lit(6000), F.floor(size / 4))))
    return F.struct(F.greatest(F.lit(1), F.least(most, F.lit(64))).cast("int").alias("lines"), F.greatest(F.lit(80), text).cast("int").alias("chars"))


def output_budget(chars: Column, lines: Column, headroom: int = 4096) -> Column:
    """Output tokens of a request: the headroom, 1.2 a character, 16 a line, 256."""
    return (F.lit(headroom) + F.floor(chars * F.lit(1.2)) + lines * 16 + 256).cast("long")


def batch_timeout(budget: Column, concurrency: Column, stretch: Column, *, seconds: float = 300.0, headroom: int = 4096) -> Column:
    """Seconds for a request: in proportion to its budget, to the requests at once and to the stretch, each at least once."""
    return F.lit(seconds) * F.greatest(F.lit(1.0), budget / F.lit(float(headroom))) * F.greatest(F.lit(1), concurrency) * F.greatest(F.lit(1), stretch)


def slug(text: Column) -> Column:
    return F.left(F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")), F.lit(48))


def script_ratio(text: Column, ranges: str) -> Column:
    """Share of the letters that lie in ``ranges`` (a regular-expression class); 1 without letters."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    inside = F.length(F.regexp_replace(letters, f"[^{ranges}]+", ""))
    return F.when(F.length(letters) == 0, 1.0).otherwise(inside / F.length(letters))


def low_confidence(words: Column, mean: Column, least: Column, logprob: Column) -> Column:
    return (words >= 3) & (((mean < 0.50) & (least < 0.15)) | (logprob < -0.9))


#: Edits beyond the difference of lengths that are looked for first.
BAND = 8


def error_rate(heard: Column, said: Column) -> Column:
    """Edit distance over the longer text's length; 0 or 1 if nothing was to be said.

    A text that stands within the other differs by what stands around it. Else a distance within a band about the difference
    of lengths is found by looking at the band alone; a larger one takes the whole table.
    """
    longest, apart = F.greatest(F.length(heard), F.length(said)), F.abs(F.length(heard) - F.length(said))

    def within(most: Column) -> Column:
        # As an array's only element the distance is computed once; -1 says that it is larger.
        found = F.array(F.call_function("levenshtein", heard, said, most.cast("int")))
        return F.get(F.filter(found, lambda x: x >= 0), F.lit(0))

    banded = F.coalesce(within(apart + BAND), within(apart + F.floor(longest / 8)), F.levenshtein(heard, said))
    distance = F.when(F.contains(heard, said) | F.contains(said, heard), apart).otherwise(banded)
    return F.when(F.length(said) == 0, F.when(F.length(heard) == 0, 0.0).otherwise(1.0)).otherwise(distance / longest)
