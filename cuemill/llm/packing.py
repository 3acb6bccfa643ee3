"""Packing tokenised documents into training sequences: vector bin packing by dot product.

Every piece has a demand vector (tokens, segments, loss-bearing tokens: those behind its document's prompt) and every sequence a vector of
what it has left. A sequence takes, again and again, the piece that fits in all three dimensions and has
the largest dot product of its demand with what is left, both as shares of the limits. When nothing
fits any more, the piece with the largest dot product is cut to fill the gap ("cut" mode), so padding
only arises where another limit binds. What remains at the end of a partition is cut into sequences
whose lengths are powers of two, which need no padding.

Each Spark partition packs its own rows: no shuffle, and a task holds at most ``POOL`` pieces of less
than one sequence. A sequence's id is (partition << 33) + a counter, so a task that is run again
gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm._tokens import encoder

#: Pieces of less than a sequence that a task weighs against each other.
POOL = 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padded long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])


class Packer:
    """Places pieces into sequences; see the module's docstring."""

    def __init__(self, limit: int, segments: int, loss: int, first_sequence: int, pool: int = POOL):
        self.limits = np.array([limit, segments, loss], float)
        self.limit, self.max_segments, self.max_loss, self.pool = limit, segments, loss, pool
        self.next = first_sequence
        #: Waiting pieces (document, start, ids, first loss-bearing id of the document, its ids) and their demands.
        self.items: list[tuple[int | None, int, np.ndarray, int, int]] = []
        self.demand = np.zeros((pool + 1, 3))
        self.rows: list[tuple] = []

    @staticmethod
    def bearing(start: int, size: int, prompt: int) -> int:
        """Loss-bearing ids among ``size`` ids from ``start`` of a document whose first ``prompt`` ids bear none."""
        return max(0, start + size - max(start, prompt))

    @staticmethod
    def most(start: int, room: float, loss: float, prompt: int) -> int:
        """Ids from ``start`` that fit into ``room`` ids and ``loss`` loss-bearing ids."""
        return int(min(room, max(0, prompt - start) + loss))

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int) -> None:
        n, at = len(ids), 0
        while at < n:
            take = self.most(at, min(self.limit, n - at), self.max_loss, prompt)
            if take == self.limit:
                # It fills a sequence alone, so no other piece has a say.
                self._emit(doc_id, at, ids[at : at + take], prompt, n, self._open(), 0, take)
            else:
                self._wait((doc_id, at, ids[at : at + take], prompt, n))
            at += take

    def close(self) -> None:
        while self.items and not self._tail():
            self._fill()

    def _wait(self, item: tuple) -> None:
        size = len(item[2])
        self.demand[len(self.items)] = size, 1, self.bearing(item[1], size, item[3])
        self.items.append(item)
        if len(self.items) > self.pool:
            self._fill()

    def _drop(self, k: int) -> None:
        last = self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.demand[k] = self.demand[len(self.items)]

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, doc_id, start, ids, prompt, total, sequence, offset, padded) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, self.bearing(start, len(ids), prompt), padded))

    def _fill(self) -> None:
        """One sequence: pieces by the largest dot product, the last one cut to fit."""
        left, chosen = self.limits.copy(), []
        while left[0] > 0 and left[1] > 0 and self.items:
            demand = self.demand[: len(self.items)]
            score = demand @ (left / self.limits**2)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                chosen.append(self.items[k])
                left -= demand[k]
                self._drop(k)
                continue
            # Nothing fits whole: cut the piece with the largest dot product that can give something.
            open_to = (demand[:, 2] < demand[:, 0]) | (left[2] > 0)
            for k in np.argsort(np.where(open_to, -score, np.inf), kind="stable")[: int(open_to.sum())].tolist():
                doc_id, start, ids, prompt, total = self.items[k]
                take = self.most(start, min(left[0], len(ids)), left[2], prompt)
                if take:
                    break
            else:
                break
            chosen.append((doc_id, start, ids[:take], prompt, total))
            loss = self.bearing(start, take, prompt)
            left -= take, 1, loss
            self.items[k] = (doc_id, start + take, ids[take:], prompt, total)
            self.demand[k] -= take, 0, loss
        self._place(chosen)

    def _place(self, chosen: list[tuple]) -> None:
        sequence, offset = self._open(), 0
        size = sum(len(x[2]) for x in chosen)
        padded = size if size & (size - 1) == 0 else self.limit
        for doc_id, start, ids, prompt, total in chosen:
            self._emit(doc_id, start, ids, prompt, total, sequence, offset, padded)
            offset += len(ids)

    def _tail(self) -> bool:
        """Once less than a sequence is left: cut it into lengths that are powers of two."""
        size, segments, loss = self.demand[: len(self.items)].sum(axis=0).astype(int)
        if size >= self.limit or segments > self.max_segments or loss > self.max_loss:
            return False
        while self.items:
            want = 1 << (int(size).bit_length() - 1)
            size -= want
            chosen = []
            while want:
                doc_id, start, ids, prompt, total = self.items[-1]
                take = min(want, len(ids))
                chosen.append((doc_id, start, ids[:take], prompt, total))
                want -= take
                if take == len(ids):
                    self.items.pop()
                else:
                    self.items[-1] = (doc_id, start + take, ids[take:], prompt, total)
            self._place(chosen)
        return True

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


#: A document's first line, if another follows, is its prompt: those characters bear no loss.
FIRST_LINE = "instr(text, '\n')"
#: Limits of the query and of the pipeline, each of which decides for some sequences of the test tables.
LIMITS = {"max_tokens": 2048, "max_segments": 8, "max_loss_tokens": 2032}


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 64,
    max_loss_tokens: int | None = None,
    prompt_chars: str | None = None,
    special_as_text: bool = False,
    cache_bytes: int | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences of at most ``max_tokens`` ids.

    ``prompt_chars`` names a column with the number of leading characters that are prompt (null: none): ids
    that begin within them bear no loss, all later ids of the row do. ``cache_bytes`` bounds what a worker
    remembers of the encoding. One row per piece, as in ``PIECE``. Null
    text is an empty text: its only id is ``end_id``. Repeated rows are packed each on its own; a null key
    stays null; an empty table gives no rows; other columns are not read. ``special_as_text``: see ``Encoder``.
    """
    loss_limit = max_tokens if max_loss_tokens is None else max_loss_tokens
    if min(max_tokens, max_segments, loss_limit) < 1:
        raise ValueError("limits must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = encoder(tokenizer_path, special_as_text, cache_bytes), np.array([end_id], "<u4").tobytes()
        packer = Packer(max_tokens, max_segments, loss_limit, TaskContext.get().partitionId() << 33)
        for batch in batches:
            keys, heads = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = (x.as_py() or "" for x in batch.column(1))
            for k, x, head, raw in zip(keys, batch.column(1), heads, tok.encode(texts), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                packer.add(k, ids, tok.prompt_ids(x.as_py(), head, ids[:-1]) if head and x.is_valid else 0)
                if len(packer.rows) >= 4096:
                    yield packer.drain()
        packer.close()
        yield packer.drain()

    prompt = F.lit(0).cast("long") if prompt_chars is None else F.col(prompt_chars).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(run, PIECE)


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
