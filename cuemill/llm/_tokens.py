"""Encoding many texts with one tokenizer, word by word through a cache.

Byte-level and word-end BPE tokenizers split a text before they merge, and always between a character
that is not white space and a single blank that another such character follows. So the ids of a text
are those of its parts at these places, each with its blank in front, one after the other. Parts repeat
much more often than texts: each worker keeps the ids of parts it has seen. Tokenizers that split
otherwise (see ``splits_at_blanks``) encode whole texts.

A new part of common characters (``_COMMON``) is cut by the tokenizer's own splitting pattern, and the library's
model encodes the pieces, each once: this saves the library's bookkeeping of alignments, which costs
more than the merges. Whether that gives the tokenizer's ids is checked on ``_PROBE`` first.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from cuemill.llm import _common  # noqa: F401  (sets TOKENIZERS_PARALLELISM)

#: Bytes (about) that all caches of an encoder hold together, and characters of texts that are encoded together.
CACHE_BYTES, TOGETHER = 192 << 20, 1 << 20
#: What an entry of a cache costs besides its characters.
_ENTRY = 200
#: Characters whose class, case and normal form no two Unicode versions see differently; none combines with another.
_COMMON = re.compile("[\n -~\u00c0-\u012f\u0131-\u017f\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")
_PROBE = ["It's we'LL I'm 12.5% \u00c9l\u00e8ve\u2026 snake_case\n\nnext \u2014 \u041c\u0438\u0440!?", " a--b ((c)) 'tis 2024-01-31\n", "don't   stop \u65e5\u672c\u8a9e x" * 3, "~`@#$^&*{}[]|\\ <|x|>", "\n", "  "]
#: Fixed value: the splitting pattern of byte-level tokenizers that name none.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Characters at which Python splits words though they aren't white space in tokenizers' patterns.
_NOT_BLANK = re.compile("[\x1c-\x1f]")
_encoders: dict[tuple[str, bool], Encoder] = {}


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer's parts can be encoded one by one: byte-level BPE with its usual splitting pattern."""
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = before.get("pretokenizers", [before])
    splits = any(s.get("type") == "Split" and "\\p{L}" in json.dumps(s.get("pattern", "")).replace("\\\\", "\\") for s in steps)
    level = next((s for s in steps if s.get("type") == "ByteLevel"), None)
    plain = level is not None and not level.get("add_prefix_space", True) and (splits or level.get("use_regex", True))
    kinds = {n.get("type") for n in normal.get("normalizers", [normal]) if n}
    return spec.get("model", {}).get("type") == "BPE" and plain and kinds <= {"NFC", "Replace", "Lowercase"}


def splitting_pattern(spec: dict) -> re.Pattern | None:
    """The tokenizer's splitting pattern for texts of common characters; None if it has another form."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    split = next((s for s in steps if s.get("type") == "Split"), None)
    if len(steps) != (1 if split is None else 2) or (split and (split.get("behavior"), split.get("invert")) != ("Removed", True)):
        return None
    text = _BYTE_LEVEL if split is None else split["pattern"].get("Regex", r"\p")
    for unicode, own in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"[\p{L}]", r"[^\W\d_]"), (r"\p{L}", r"[^\W\d_]"), (r"[\p{N}]", r"\d"), (r"\p{N}", r"\d")):
        text = text.replace(unicode, own)
    return None if r"\p" in text else re.compile(text)


def drops_white_space(spec: dict) -> bool:
    """Whether the splitting pattern, of which only matches are kept, matches no white space."""
    split = re.search(r'"Regex": "(.*?)"', json.dumps(spec["pre_tokenizer"]))
    return split is not None and not re.search(r"\\s| ", json.loads(f'"{split[1]}"').replace(r"[^\s", "["))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class NotBetweenBlanks(Exception):  # noqa: N818
    """A text has white space beside a blank."""


class Bound:
    """What caches hold together; beyond ``most`` bytes (about) all begin anew."""

    def __init__(self, most: int | None = None) -> None:
        self.held, self.caches, self.most = 0, [], most

    def add(self, size: int) -> None:
        if self.held + size > (CACHE_BYTES if self.most is None else self.most):
            for c in self.caches:
                c.clear()
            self.held = 0
        self.held += size


class Cache(dict):
    """Remembers ``make(key)`` within ``bound``."""

    def __init__(self, make: Callable[[str], bytes], bound: Bound):
        super().__init__()
        self.make, self.bound = make, bound
        bound.caches.append(self)

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        bound = self.bound
        size = bound.held + _ENTRY + 2 * len(key) + len(found)
        if size > (CACHE_BYTES if bound.most is None else bound.most):
            bound.add(size - bound.held)
        else:
            bound.held = size
        self[key] = found
        return found

    def keep(self, key: str, found: bytes) -> None:
        self.bound.add(_ENTRY + 2 * len(key) + len(found))
        self[key] = found


def added_marks(spec: dict) -> list[str]:
    """Strings one of which every text with an added token contains; for a normalised token, what no letter case changes."""
    marks = []
    for token in spec.get("added_tokens", []):
        runs = re.findall(r"[\W\d_]+", token["content"])
        marks.append(max(runs, key=len, default="") if token.get("normalized") else token["content"])
    return marks


class Encoder:
    """A tokenizer's own ids: added tokens that a text spells out are those tokens.

    With ``special_as_text``, special tokens that a text spells out are ordinary text instead. Texts that may
    hold an added token are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache_bytes: int | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = added_marks(spec)
        self.by_parts = splits_at_blanks(spec)
        self.model, self.letters = self.tok.model, byte_letters()
        self.blank = self.letters[32]
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.splits = splitting_pattern(spec) if self.by_parts else None
        self.drops_blanks = False
        # Bytes of each id, where ids spell the text's bytes one after the other.
        spells = self.by_parts and not spec.get("normalizer") and not spec["model"].get("end_of_word_suffix")
        self.id_bytes = np.zeros(self.tok.get_vocab_size(), np.int64) if spells else None
        if spells:
            names = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
            for name, k in spec["model"]["vocab"].items():
                self.id_bytes[k] = names.get(k, len(name))
            for k, size in names.items():
                self.id_bytes[k] = size
        self.bound = Bound(cache_bytes)
        makers = (self._part, self._inner, lambda x: self._part(" " + x), self._piece)
        self.firsts, self.others, self.loose, self.pieces = (Cache(make, self.bound) for make in makers)
        if self.splits and [self._part(x) for x in _PROBE] != self._raw(_PROBE):
            self.splits = None
        # Where white space is no part of any piece, parts lie between any white space; else each has a blank in front.
        self.drops_blanks = self.splits is not None and drops_white_space(spec)
        self.joint = "" if self.drops_blanks else " "
        if self.drops_blanks:
            self.others.make = self._part
        for cache in self.bound.caches:
            cache.clear()

    def _piece(self, piece: str) -> bytes:
        # Of printable ASCII characters only the blank isn't its own letter.
        if piece.isascii() and piece.isprintable():
            spelt = piece.replace(" ", self.blank)
        else:
            spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()

    def _cut(self, part: str) -> list[str]:
        """The pieces of a part of common characters."""
        return self.splits.findall(part.lower() if self.lower else part)

    def _known(self, piece: str) -> bytes:
        """The ids of one of several pieces of a part; a piece that is a part of its own is remembered as that."""
        found = self.others.get(piece) if self.drops_blanks else self.others.get(piece[1:]) if piece[0] == " " else None
        return self.pieces[piece] if found is None else found

    def _part(self, part: str) -> bytes:
        if self.splits and (part.isascii() and part.isprintable() or _COMMON.fullmatch(part)):
            pieces = self._cut(part)
            return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._known, pieces))
        return self._raw([part])[0]

    def _inner(self, part: str) -> bytes:
        """A part that follows a single blank; it must begin and end with another character than white space."""
        if not part or part[0].isspace() or part[-1].isspace():
            raise NotBetweenBlanks
        return self._part(" " + part)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _slowly(self, text: str) -> bytes:
        """Texts with white space beside blanks, or with added tokens."""
        if not self.by_parts or any(m in text for m in self.marks):
            return self._raw([text])[0]
        if self.drops_blanks:
            return b"".join(map(self.others.__getitem__, text.split(" ")))
        first, *rest = _BLANK.split(text)
        return self.firsts[first] + b"".join(map(self.loose.__getitem__, rest))

    #: Remembers many new parts at once, before they are asked for one by one, if there is such a way.
    learn: Callable[[set[str]], None] | None = None

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_parts:
            yield from self._raw(texts)
            return
        plain = [not any(m in t for m in self.marks) for t in texts]
        if self.drops_blanks:
            plain = [ok and not _NOT_BLANK.search(t) for t, ok in zip(texts, plain, strict=True)]
            parts = [t.split() if ok else [] for t, ok in zip(texts, plain, strict=True)]
        else:
            parts = [t.split(" ") for t in texts]
            plain = [ok and not (own[1:] and (not own[0] or own[0][-1].isspace())) for own, ok in zip(parts, plain, strict=True)]
        firsts = 0 if self.drops_blanks else 1
        if self.learn:
            known = self.others
            self.learn({p for own, ok in zip(parts, plain, strict=True) if ok for p in own[firsts:] if p not in known})
        for t, ok, own in zip(texts, plain, parts, strict=True):
            try:
                if not ok:
                    raise NotBetweenBlanks
                ids = b"".join(map(self.others.__getitem__, own[firsts:]))
                yield self.firsts[own[0]] + ids if firsts else ids
            except NotBetweenBlanks:
                yield self._slowly(t)

    def prompt_ids(self, text: str, chars: int, ids: np.ndarray) -> int:
        """How many of a text's ids begin within its first ``chars`` characters."""
        if chars <= 0 or self.id_bytes is None:
            return len(self._raw([text[:chars]])[0]) // 4 if chars > 0 else 0
        end = len(text[:chars].encode())
        # Ids of one byte each reach furthest, so no later one begins there.
        starts = np.cumsum(self.id_bytes[ids[:end]])
        return int(np.searchsorted(starts, end, side="left")) + 1 if len(starts) and starts[-1] >= end else len(starts)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        batch, size = [], 0
        for text in texts:
            if batch and size + len(text) > TOGETHER:
                yield from self._together(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        if batch:
            yield from self._together(batch)


def encoder(path: str, special_as_text: bool = False, cache_bytes: int | None = None) -> Encoder:
    """The process's encoder for the tokenizer at ``path``; ``cache_bytes`` holds from now on."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    found = _encoders[path, special_as_text]
    found.bound.most = cache_bytes
    return found
