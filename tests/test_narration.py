import random
import textwrap

from cuemill.operators import narration

SCHEMA = "job int, idx int, start_ms long, end_ms long, text string"


def cut(text, per_line, lines):
    box = textwrap.wrap(text, width=per_line, break_long_words=False, break_on_hyphens=False)
    blanks = [k for k, c in enumerate(text) if c == " "]
    if (len(box) <= lines and all(len(x) <= per_line for x in box)) or not blanks:
        return [text]
    at = min(blanks, key=lambda k: abs(k - len(text) // 2))
    return cut(text[:at], per_line, lines) + cut(text[at + 1 :], per_line, lines)


def brute(rows, per_line, lines, gap=120, least=300):
    out = []
    for job in sorted({r[0] for r in rows}):
        cues = []
        for _, idx, start, end, text in sorted(r for r in rows if r[0] == job and r[4] and r[4].split()):
            parts, done = cut(" ".join(text.split()), per_line, lines), 0
            total, span = sum(map(len, parts)), max(0, end - start)
            for p in parts:
                moments = [start + (2 * span * n + total) // (2 * total) for n in (done, done + len(p))]
                cues.append([job, len(cues), idx, *moments, p])
                done += len(p)
        for a, b in zip(cues, cues[1:], strict=False):
            shaved = b[3] - gap - 1
            if b[3] - a[4] < gap + 1 and shaved - a[3] >= least:
                a[4] = shaved
        out += [tuple(c) for c in cues]
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for job in range(6):
        at = 0
        for idx in range(12):
            text = " ".join("x" * rng.choice([1, 3, 7, 12, 50]) + rng.choice(["", ",", "é"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))
            rows.append((job, idx, at, at + rng.choice([-5, 0, 900, 6000]), text))
            at = rows[-1][3] + rng.choice([0, 50, 121, 400])
    rows.append((9, 0, 0, 10, None))
    for per_line, lines in ((42, 2), (10, 1), (15, 3)):
        got = narration.narration_cues(spark.createDataFrame(rows, SCHEMA).repartition(3), per_line=per_line, lines=lines)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, per_line, lines)


def test_a_text_whose_words_break_badly_becomes_two_cues(spark):
    text = "They bar municipal permits on 20.1 hectares of forest inside the coastal zone."
    got = narration.narration_cues(spark.createDataFrame([(1, 0, 1000, 6200, text)], SCHEMA)).orderBy("cue").collect()
    assert len(got) == 2 and " ".join(r["text"] for r in got) == text
    assert got[0]["start_ms"] == 1000 and got[1]["end_ms"] == 6200 and got[1]["start_ms"] - got[0]["end_ms"] == 121


def test_empty_table(spark):
    assert narration.narration_cues(spark.createDataFrame([], SCHEMA)).count() == 0
