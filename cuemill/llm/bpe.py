"""BPE encoding by segment trees over adjacent pair ranks, and decoding, with a tokenizer file's vocabulary.

A piece (what the tokenizer's splitting pattern gives) is a row of symbols. Leaf i of its segment tree holds the rank of
the merge of symbol i with its right neighbour, together with i; each inner node holds the smaller of its two
children. So the root is the leftmost of the lowest-ranked merges. That merge changes three leaves, and only their
ancestors are computed anew: a piece of n symbols takes at most n merges of O(log n) each, however long it is. It
ends when the root says that no pair can be merged.

Short new pieces of a slice of texts are merged together, a forest of equal trees in NumPy with one merge of each piece
in a step; a long piece has its own tree. Normalising and splitting are the tokenizer's own; what a text spells of the added
tokens are those tokens. Parts and pieces that a worker has met are remembered, in bounded memory (``_tokens``).

Supported are byte-level BPE tokenizers without dropout, unknown token, byte fallback, subword prefix and
whole-word shortcut, whose added tokens are plain strings; others are refused. Decoding follows the file's decoder:
none (tokens joined by blanks) or byte level.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm._tokens import _COMMON, Bound, Cache, Encoder, byte_letters

#: Symbols of a piece at most that is merged in a forest, and pieces of a forest.
SHORT, FOREST = 64, 1 << 14
#: Bytes (about) that a worker remembers: no library holds alignments beside them, so it may be more than elsewhere.
CACHE_BYTES = 320 << 20
_NEVER = np.iinfo(np.int64).max


class Merges:
    """Ranks of adjacent pairs: ``look`` gives rank and merged symbol of pairs of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.one = pairs
        self.wide = max(vocab.values(), default=0) + 1
        codes = np.array([a * self.wide + b for a, b in pairs], np.int64)
        turn = np.argsort(codes)
        self.codes = np.append(codes[turn], _NEVER)
        self.ranks = np.append(np.array([r for r, _ in pairs.values()], np.int64)[turn], _NEVER)
        self.made = np.zeros(len(merges), np.int64)
        for rank, symbol in pairs.values():
            self.made[rank] = symbol

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``_NEVER`` where two symbols don't merge or one is missing (below zero)."""
        code = np.where((a < 0) | (b < 0), -1, a * self.wide + b)
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], _NEVER)


def merge_long(symbols: list[int], merges: Merges) -> list[int]:
    """A piece's symbols after all merges, by one segment tree."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    none = (_NEVER, _NEVER)
    tree = [none] * (2 * size)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = merges.one

    def leaf(i: int) -> tuple[int, int]:
        j = after[i]
        found = pairs.get((symbols[i], symbols[j])) if j < n else None
        return (found[0], i) if found else none

    for i in range(n - 1):
        tree[size + i] = leaf(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] != none:
        rank, i = tree[1]
        gone = after[i]
        symbols[i], after[i] = int(merges.made[rank]), after[gone]
        if after[i] < n:
            before[after[i]] = i
        changed = [(i, leaf(i))]
        if gone < n - 1:
            changed.append((gone, none))
        if before[i] >= 0:
            changed.append((before[i], leaf(before[i])))
        for place, value in changed:
            node = size + place
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if least == tree[node]:
                    break
                tree[node] = least
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merge_forest(pieces: np.ndarray, merges: Merges) -> np.ndarray:
    """Rows of symbols (-1 beyond a row's end) after all merges; -1 where a symbol has gone into another."""
    count, width = pieces.shape
    if width < 2:
        return pieces
    size = 1 << (width - 1).bit_length()
    symbols = np.full((count, size + 1), -1, np.int64)
    symbols[:, :width] = pieces
    after = np.broadcast_to(np.arange(1, size + 2), (count, size + 1)).copy()
    before = np.broadcast_to(np.arange(-1, size), (count, size + 1)).copy()
    # A leaf's key is rank * size + place, so that keys order by rank, then from left to right.
    rank = merges.look(symbols[:, :-1], symbols[:, 1:])
    tree = np.full((count, 2 * size), _NEVER, np.int64)
    tree[:, size:] = np.where(rank == _NEVER, _NEVER, rank * size + np.arange(size))
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] != _NEVER)
    while len(live):
        root = tree[live, 1]
        at = root % size
        gone = after[live, at]
        right, left = after[live, gone], before[live, at]
        symbols[live, at] = merges.made[root // size]
        symbols[live, gone] = -1
        after[live, at] = right
        inside = right <= size
        before[live[inside], right[inside]] = at[inside]
        beyond = np.where(inside, symbols[live, np.minimum(right, size)], -1)
        previous = np.where(left >= 0, symbols[live, np.maximum(left, 0)], -1)
        own, other = merges.look(symbols[live, at], beyond), merges.look(previous, symbols[live, at])
        held = left >= 0
        for rows, place, value in ((live, at, own), (live, gone, None), (live[held], left[held], other[held])):
            key = _NEVER if value is None else np.where(value == _NEVER, _NEVER, value * size + place)
            node = size + place
            tree[rows, node] = key
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = live[tree[live, 1] != _NEVER]
    return symbols[:, :width]


class TreeEncoder(Encoder):
    """The ids of a tokenizer file, merged by segment trees."""

    def __init__(self, path: str, cache_bytes: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model.get("type") != "BPE" or odd or not spec.get("pre_tokenizer"):
            raise ValueError(f"not a plain BPE tokenizer: {path} {odd}")
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(self.vocab, pairs)
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.spelt_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        letters = byte_letters()
        self.inner, self.final = (np.array([self.vocab.get(letters[b] + end, -1) for b in range(256)], np.int64) for end in ("", self.suffix))
        self.spelt = Cache(self._merge, Bound())
        super().__init__(path, cache_bytes=CACHE_BYTES if cache_bytes is None else cache_bytes)
        self.spelt.bound = self.bound
        self.bound.caches.append(self.spelt)

    def _symbols(self, spelt: str) -> list[int]:
        """Symbols of a piece in byte letters; the last one carries the word-end mark. Letters that the vocabulary lacks are dropped."""
        found = [self.vocab.get(c, -1) for c in spelt[:-1]] + [self.vocab.get(c + self.suffix, -1) for c in spelt[-1:]]
        return [x for x in found if x >= 0]

    def _merge(self, spelt: str) -> bytes:
        return array("I", merge_long(self._symbols(spelt), self.merges)).tobytes()

    def _letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        return self._merge(self._letters(piece))

    def _raw(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: added tokens first, then the tokenizer's normal form and pieces of what lies between."""
        out = []
        for text in texts:
            ids = []
            for k, section in enumerate(self.spelt_added.split(text) if self.spelt_added else [text]):
                if k % 2:
                    ids.append(array("I", [self.added[section]]).tobytes())
                elif section:
                    normal = self.tok.normalizer.normalize_str(section) if self.tok.normalizer else section
                    ids += [self.spelt[piece] for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
            out.append(b"".join(ids))
        return out

    def merge_all(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces: short ones in forests of equal trees."""
        raws = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raws], np.int64)
        flat, ends = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        # Trees of one size class are merged together; a letter that the vocabulary lacks (-1) is left to ``_piece``.
        odd = np.add.reduceat(symbols < 0, ends - sizes) if len(pieces) else np.empty(0, np.int64)
        classes = np.where((sizes > SHORT) | (odd > 0), -1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        out = {pieces[k]: self._piece(pieces[k]) for k in np.flatnonzero(classes < 0)}
        for c in np.unique(classes[classes >= 0]):
            group = np.flatnonzero(classes == c)
            for first in range(0, len(group), FOREST):
                some = group[first : first + FOREST]
                width = np.arange(1 << int(c))[None, :]
                inside = width < sizes[some][:, None]
                place = np.where(inside, (ends - sizes)[some][:, None] + width, 0)
                done = merge_forest(np.where(inside, symbols[place], -1), self.merges)
                kept = done >= 0
                raw, stops = done[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
                for k, a, b in zip(some.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    out[pieces[k]] = raw[a:b]
        return out

    def learn(self, new: set[str]) -> None:
        """Remember the ids of new parts; those of rarer characters are left to ``_part``."""
        if not self.splits:
            return
        cut = {p: self._cut(self.joint + p) for p in new if p and not p[0].isspace() and not p[-1].isspace() and _COMMON.fullmatch(p)}
        done = self.merge_all(list({x for pieces in cut.values() for x in pieces if len(pieces) == 1 or x not in self.pieces}))
        for p, pieces in cut.items():
            if len(pieces) == 1:
                self.others.keep(p, done[pieces[0]])
                continue
            for x in pieces:
                if x not in self.pieces and x in done:
                    self.pieces.keep(x, done[x])
            self.others.keep(p, b"".join([done[x] if x in done else self.pieces[x] for x in pieces]))


class Decoder:
    """Texts of ids, as the tokenizer's decode without skipping special tokens; ids that it doesn't have are left out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} of {path} isn't supported")
        tok = Tokenizer.from_file(path)
        names = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.names = np.array([names.get(i) for i in range(max(names, default=-1) + 1)], object)
        self.gaps = len(names) < len(self.names)
        self.byte_of = {letter: b for b, letter in byte_letters().items()} if kind else None

    def text(self, ids: np.ndarray) -> str:
        """The text of one document's ids (unsigned integers)."""
        if len(ids) and int(ids.max()) >= len(self.names):
            ids = ids[ids < len(self.names)]
        found = self.names[ids].tolist()
        if self.gaps:
            found = [t for t in found if t is not None]
        if self.byte_of is None:
            return " ".join(found)
        raw = b"".join(bytes(self.byte_of[c] for c in t) if all(c in self.byte_of for c in t) else t.encode() for t in found)
        return raw.decode("utf-8", errors="replace")


_encoders: dict[str, TreeEncoder] = {}
_decoders: dict[str, Decoder] = {}


def tree_encoder(path: str) -> TreeEncoder:
    """The process's encoder for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = TreeEncoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids_of(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<u4") for x in tree_encoder(path).encode((t.as_py() or "") for t in texts))


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every row's whole text, without added tokens, truncation or padding.

    A null text is empty and has no ids. Null keys and repeated rows are kept; an empty table gives no rows. A text that
    spells an added token gives that token's id, as the tokenizer's plain call does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(_ids_of(path, batch.column(1)))
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat).cast(pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _rows(docs, key, F.col(text)).mapInArrow(run, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every row's ids; null ids give a null text, null and unknown ids in a list are left out."""
    known = F.filter(F.col(ids), lambda x: x >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else decoder(path).text(np.array(x.as_py(), np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _rows(encoded, key, known.cast("array<long>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every row's ids and of the text that they decode to, both in one pass over whole texts.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256 (of UTF-8). Odd rows are
    as in ``encode_documents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        decimal = np.array([str(i) for i in range(len(back.names))], object)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            found = [(len(ids), sha(" ".join(decimal[ids].tolist())), sha(back.text(ids))) for ids in _ids_of(path, batch.column(1))]
            counts, ids, texts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, key, F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), value.alias("x"))
