"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class from the start:
only one representative of each goes on. Two sets with similarity t share a shingle among the first
size - ceil(t * size) + 1 of each in any common order; the order is by a coarse frequency (shingles that
occur often within some task's rows, or whose lists turn out long, come last), then by hash.

Index lists hold the representatives that have a shingle in their prefix. Lists with the same members are
kept once. The lists of rare shingles are built by hash bucket; the postings of shingles that are known to
be frequent are dealt by shingle and document, so no task holds such a list.

Relations between sets save most comparisons, in two rounds:

1. In each list the head (the member whose set is most common, that is, the likeliest origin of the
   others) is compared with the other members. Members that it links are one component.
2. Answers of the other members are derived from the head's. What a set shares with the head, and how much
   of it lies outside, is known by then; two sets share at most the smaller of what they share with the
   head and the smaller of what they have outside. Only pairs in different components that this bound, size and
   position leave open are compared. Long lists are cut into blocks by size, position and whether
   the head's component holds the set; a pair of blocks is skipped as a whole if its bounds rule it out.

No link between two components is lost, and a group of n near copies costs about n comparisons. Before whole
sets are compared, parity bitmaps bound what two sets can share: the bits in which they differ are at most
the shingles in which the sets differ. They are two bits a shingle, so most suggested pairs end here.

Sets are compared in full, by distributed cogroups of at most ``TOGETHER`` members with a head. Components come
from label propagation with pointer jumping on tables; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import batches_of, broadcast_if_small, byte_table, give_back, materialize, mix64, word_hashes

#: Words are runs of anything but blanks and the five ASCII control characters of white space.
WORDS = byte_table({0x20, *range(0x09, 0x0E)})
#: Shingles that may be kept as frequent (16 bytes each in a broadcast); others count as rare.
FREQUENT = 1 << 20
#: Local occurrences from which a task reports a shingle, and known ones from which its list is dealt by document too.
REPORTED, HOT = 3, 4096
#: Members from which the list of a shingle makes it a frequent one.
LONG = 128
TOGETHER = 256
#: Bytes of a group's rows from which a task returns freed memory behind it.
LARGE = 4 << 20
#: Members of a list that stay one block, and members of a block of a longer list (about).
SHORT, BLOCK = 128, 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; all its words as one shingle, if it has fewer than ``n``."""
    words, firsts = word_hashes(data, offsets, WORDS)
    total = max(0, len(words) - n + 1)
    grams = np.zeros(total, np.uint64)
    for j in range(n):
        grams = mix64(grams * np.uint64(0x9FB21C651E98DF25) + words[j : j + total])
    for k in range(len(firsts) - 1):
        a, b = int(firsts[k]), int(firsts[k + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix64(h * np.uint64(0xD1342543DE82EF95) + w)
            yield h
        else:
            yield np.empty(0, np.uint64)


def least_common(size: np.ndarray | int, percent: int):
    """ceil(percent / 100 * size): shingles that a set of this size shares with any set it links with."""
    return (size * percent + 99) // 100


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles whose hash is i modulo the size, a power of two (64 to 65,536 bits)."""
    bits = 1 << min(16, max(6, (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_shared(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """An upper bound of the shingles that two sets share. The longer bitmap is folded to the shorter one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2


def summarise(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, set_a, set_b, bitmap) for every row, with two hashes of its set; and (shingle, n) for locally common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "size", "set_a", "set_b", "bitmap", "frequent"]
        pending: list[np.ndarray] = []
        held = 0

        def report() -> pa.Array:
            nonlocal pending, held
            every = np.concatenate(pending) if pending else np.empty(0, np.uint64)
            pending, held = [], 0
            every.sort()
            begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, int)
            counts = np.diff(np.r_[begins, len(every)])
            often = counts >= REPORTED
            return every[begins[often]].view(np.int64).tolist(), counts[often].tolist()

        for batch, data, offsets in batches_of(batches, "t"):
            sizes, a, b, maps, seen = [], [], [], [], set()
            for s in shingle_sets(data, offsets, n):
                sizes.append(len(s))
                maps.append(parity_bitmap(s) if len(s) else None)
                a.append(int(np.sum(mix64(s), dtype=np.uint64).view(np.int64)) if len(s) else None)
                b.append(int(np.sum(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64).view(np.int64)) if len(s) else None)
                if len(s) and (a[-1], b[-1]) not in seen:
                    seen.add((a[-1], b[-1]))
                    pending.append(s)
                    held += len(s)
            none = pa.array([None] * len(batch), pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(maps, pa.binary()), none], names)
            if held > 4_000_000:
                yield frequent_rows(*report())
        yield frequent_rows(*report())

    def frequent_rows(grams: list[int], counts: list[int]) -> pa.RecordBatch:
        kind = pa.struct([("g", pa.int64()), ("n", pa.int64())])
        pairs = pa.StructArray.from_arrays([pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["g", "n"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), lists.cast(pa.list_(kind))], ["doc_id", "size", "set_a", "set_b", "bitmap", "frequent"])

    rows = docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, "doc_id long, size long, set_a long, set_b long, bitmap binary, frequent array<struct<g:long,n:long>>")
    rows = materialize(rows, "sets")
    common = rows.where("frequent IS NOT NULL").select(F.explode("frequent").alias("f")).groupBy(F.col("f.g").alias("g")).agg(F.sum("f.n").alias("n"))
    return rows.where("size IS NOT NULL").drop("frequent"), common


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b): root is the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then follows labels twice; rounds end when
    nothing changes. Every round is written, so lost executors cost one round.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        new = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        for _ in range(2):
            up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = new.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = materialize(new, "roots")
        if new.where("old != root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _order(frequent: DataFrame):
    """The frequent shingles and their numbers in order of shingles, and a mask of their low bits, sent to all tasks."""
    top = frequent.orderBy(F.desc("n"), "g").limit(FREQUENT).toArrow()  # bounded by FREQUENT
    grams = top.column("g").to_numpy().view(np.uint64)
    turn = np.argsort(grams)
    grams, counts = grams[turn], np.minimum(top.column("n").to_numpy()[turn], 1 << 20)
    mask = np.zeros(1 << 20, bool)
    mask[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return frequent.sparkSession.sparkContext.broadcast((grams, counts, mask))


def _prefixes(batches: Iterator[pa.RecordBatch], order: tuple, n: int, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(doc, size, shingles, often, rank) of each non-empty set: its prefix with how often each is known to occur."""
    known, freq, bits = order
    for batch, data, offsets in batches_of(batches, "t"):
        for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(data, offsets, n), strict=True):
            if not len(s):
                continue
            often = np.zeros(len(s), np.int64)
            maybe = np.flatnonzero(bits[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(maybe) and len(known):
                spot = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                often[maybe] = np.where(known[spot] == s[maybe], freq[spot], 0)
            size = len(s)
            keep = size - least_common(size, percent) + 1
            turn = np.argsort(often, kind="stable")[:keep] if often.any() else np.arange(keep)
            yield doc, size, s[turn], often[turn], int(1e6 * (1 - np.mean(often > 0)))


def _in_buckets(own: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """(bucket, rows): the rows of each bucket as bytes."""
    turn = np.argsort(own, kind="stable")
    rows, own = rows[turn], own[turn]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
    ends = np.r_[begins[1:], len(own)] if len(own) else begins
    return pa.RecordBatch.from_arrays([pa.array(own[begins], pa.int64()), pa.array([rows[x:y].tobytes() for x, y in zip(begins, ends, strict=True)], pa.binary())], ["bucket", "rows"])


def long_shingles(reps: DataFrame, frequent: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(g, n) of the shingles, other than those dealt by document, whose lists would be long: prefixes counted, shingles alone."""
    shared = _order(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            grams = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            held, count = [], 0
            return _in_buckets((mix64(grams) % np.uint64(buckets)).astype(np.int64), grams)

        for _, _, s, often, _ in _prefixes(batches, shared.value, n, percent):
            held.append(s[often < HOT])
            count += len(held[-1])
            if count > 250_000:
                yield flush()
        yield flush()

    def counted(t: pa.Table) -> pa.Table:
        grams, counts = np.unique(np.frombuffer(b"".join(x.as_py() for x in t.column("rows")), np.uint64), return_counts=True)
        if t.nbytes > LARGE:
            give_back()
        many = counts >= LONG
        return pa.table({"g": grams[many].view(np.int64), "n": counts[many].astype(np.int64)})

    packed = reps.select("doc_id", F.col("text").alias("t")).mapInArrow(emit, "bucket long, rows binary")
    return packed.groupBy("bucket").applyInArrow(counted, "g long, n long")


def index_lists(reps: DataFrame, frequent: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(list, doc, size, pos, rank): members of each distinct index list of at least two representatives.

    ``pos`` is the earliest position that the list's shingle had in any equal list; ``rank`` orders heads.
    """
    shared = _order(frequent)
    posting = np.dtype([("g", "<u8"), ("doc", "<i8"), ("size", "<u4"), ("pos", "<u4"), ("rank", "<u4")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, hot, count
            rows = np.concatenate(held) if held else np.empty(0, posting)
            many = np.concatenate(hot) if hot else np.empty(0, bool)
            held, hot, count = [], [], 0
            # Buckets of frequent shingles are numbered from -1 downwards.
            own = (mix64(np.where(many, mix64(rows["g"]) + rows["doc"].view(np.uint64), rows["g"])) % np.uint64(buckets)).astype(np.int64)
            return _in_buckets(np.where(many, -1 - own, own), rows)

        for doc, size, s, often, rank in _prefixes(batches, shared.value, n, percent):
            rows = np.empty(len(s), posting)
            rows["g"], rows["doc"], rows["size"], rows["pos"], rows["rank"] = s, doc, size, np.arange(len(s)), rank
            held.append(rows)
            hot.append(often >= HOT)
            count += len(s)
            if count > 250_000:
                yield flush()
        yield flush()

    def merge(t: pa.Table) -> pa.Table:
        out = merged(t)
        if t.nbytes > LARGE:
            give_back()
        return out

    def merged(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x.as_py() for x in t.column("rows")), posting)
        if t.num_rows and t.column("bucket")[0].as_py() < 0:
            return table_of(rows["g"].view(np.int64), rows, rows["pos"], 1)
        rows = rows[np.lexsort((rows["doc"], rows["size"], rows["g"]))]
        begins = np.flatnonzero(np.r_[True, rows["g"][1:] != rows["g"][:-1]])
        lengths = np.diff(np.r_[begins, len(rows)])
        begins, lengths = begins[lengths > 1], lengths[lengths > 1]
        lists: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
        for b, m in zip(begins.tolist(), lengths.tolist(), strict=True):
            part = rows[b : b + m]
            # With sizes, as an id's rows may have sets of several sizes.
            member = mix64(part["doc"].astype(np.uint64) + np.uint64(0x1234567)) + part["size"].astype(np.uint64)
            name = int(np.sum(mix64(member), dtype=np.uint64).view(np.int64))
            if (old := lists.get((name, m))) is None:
                lists[(name, m)] = (b, m, part["pos"].copy())
            else:
                np.minimum(old[2], part["pos"], out=old[2])
        at = np.concatenate([np.arange(b, b + m) for b, m, _ in lists.values()]) if lists else np.empty(0, int)
        pos = np.concatenate([p for _, _, p in lists.values()]) if lists else np.empty(0, np.uint32)
        names = np.repeat(np.array([k[0] for k in lists], np.int64), [k[1] for k in lists])
        return table_of(names, rows[at], pos, 0)

    def table_of(names: np.ndarray, rows: np.ndarray, pos: np.ndarray, kind: int) -> pa.Table:
        columns = {"list": names, "doc": rows["doc"], "size": rows["size"].astype(np.int64), "pos": pos.astype(np.int64), "rank": rows["rank"].astype(np.int64)}
        return pa.table(columns | {"kind": np.full(len(rows), kind)})

    packed = reps.select("doc_id", F.col("text").alias("t")).mapInArrow(emit, "bucket long, rows binary")
    found = packed.groupBy("bucket").applyInArrow(merge, "list long, doc long, size long, pos long, rank long, kind long")
    found = materialize(found, "postings")
    rare = found.where("kind = 0").groupBy("list", "doc", "size", "rank").agg(F.min("pos").alias("pos"))
    hot = found.where("kind = 1").drop("kind")
    # Equal lists: one order of shingles holds for all sets, so the list with the least positions has the earliest of each member.
    member = F.xxhash64("doc", "size")
    # Sums of halves, as whole hashes would overflow.
    halves = F.sum(member.bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"), F.sum(F.shiftrightunsigned(member, 32)).alias("y")
    names = hot.groupBy("list").agg(F.count(F.lit(1)).alias("n"), *halves, F.sum("pos").alias("pos"))
    kept = names.where("n > 1").groupBy("n", "x", "y").agg(F.min_by("list", F.struct("pos", "list")).alias("list")).select("list")
    hot = hot.join(broadcast_if_small(materialize(kept, "hot-lists"), FREQUENT), "list")
    return rare.unionByName(hot)


def best_lists(reps: DataFrame, frequent: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Index lists in an order of shingles that also knows those whose lists would be long in a first order.

    The first order comes from what single tasks see, which leaves out shingles that are common in the whole table but
    rare in each task. Counting the prefixes shows them; the lists are built once, whether there are any or not.
    """
    long = long_shingles(reps, frequent, n, percent, buckets)
    known = frequent.unionByName(long).groupBy("g").agg(F.max("n").alias("n"))
    return index_lists(reps, materialize(known, "frequent"), n, percent, buckets)


def head_pairs(lists: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each list's head (list, h) with the members that size and position don't rule out."""
    both = lists.join(heads, "list").where("doc != h.doc")
    return both.where(_possible("size", "pos", "h.size", "h.pos", percent)).select(F.col("h.doc").alias("a"), F.col("doc").alias("b")).distinct()


def _needed(a: Column, b: Column, percent: int) -> Column:
    """100 + percent times the shingles that sets of these sizes share if they link, at least."""
    return (a + b) * percent


def _possible(size_a: str, pos_a: str, size_b: str, pos_b: str, percent: int) -> Column:
    """Sizes near enough, and enough shingles left after both positions for the overlap that a link needs."""
    a, b = F.col(size_a), F.col(size_b)
    shared = F.least(a - F.col(pos_a), b - F.col(pos_b))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (shared * (100 + percent) >= _needed(a, b, percent))


def open_pairs(lists: DataFrame, heads: DataFrame, roots: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one list that are in different components and that no bound rules out.

    ``known`` (a, b, least, most): bounds of what head a shares with b. Pairs with their list's head were compared.
    """
    label = roots.select(F.col("node").alias("doc"), "root")
    marked = lists.join(label, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    marked = materialize(marked, "marked")
    # A list whose members are all in one component has nothing left to say.
    mixed = marked.groupBy("list").agg((F.min("root") != F.max("root")).alias("mixed"), F.count(F.lit(1)).alias("n")).where("mixed AND n > 2")
    mixed = materialize(mixed.select("list", "n").join(heads, "list"), "mixed-lists")
    rows = marked.join(mixed, "list").join(label.withColumnsRenamed({"doc": "head", "root": "head_root"}), F.col("h.doc") == F.col("head"), "left")
    rows = rows.where("doc != h.doc OR size != h.size").select("list", "doc", "size", "pos", "root", "n", F.col("h.doc").alias("a"), F.col("h.size").alias("head_size"), (F.col("root") == F.coalesce("head_root", "h.doc")).alias("near"))
    rows = rows.join(known.withColumnRenamed("b", "doc"), ["a", "doc"], "left")
    most = F.coalesce("most", F.least("size", "head_size"))
    band = F.floor(F.log("size") / F.lit(np.log(100 / percent) / 2) + 1e-9) if percent < 100 else F.col("size")
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / BLOCK)).cast("int")
    block = F.when(F.col("n") > SHORT, F.xxhash64(band, F.floor(16 * F.col("pos") / F.col("size")), "near", part)).otherwise(0)
    rows = rows.select("list", "doc", "size", "pos", "root", most.alias("most"), (F.col("size") - F.coalesce("least", F.lit(0))).alias("outside"), block.alias("block"))
    rows = materialize(rows, "mixed")
    blocks = rows.groupBy("list", "block").agg(
        *(F.min(c).alias(f"min_{c}") for c in ("size", "root")), *(F.max(c).alias(f"max_{c}") for c in ("size", "root", "most", "outside")), F.max(F.col("size") - F.col("pos")).alias("left")
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    share = F.least("x.left", "y.left", F.least("x.max_most", "y.max_most") + F.least("x.max_outside", "y.max_outside"))
    fits = (F.col("x.min_size") * percent <= F.col("y.max_size") * 100) & (F.col("y.min_size") * percent <= F.col("x.max_size") * 100)
    fits &= share * (100 + percent) >= _needed(F.col("x.min_size"), F.col("y.min_size"), percent)
    several = (F.col("x.min_root") != F.col("y.max_root")) | (F.col("x.max_root") != F.col("y.min_root"))
    turns = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.block") <= F.col("y.block")) & fits & several)
    turns = turns.select(F.col("x.list").alias("list"), F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    p = rows.join(turns, ["list", "block"]).alias("p")
    q = rows.alias("q")
    share = F.least("p.most", "q.most") + F.least("p.outside", "q.outside")
    ok = (F.col("p.list") == F.col("q.list")) & (F.col("p.other") == F.col("q.block")) & (F.col("p.root") != F.col("q.root")) & ((F.col("p.block") != F.col("q.block")) | (F.col("p.doc") < F.col("q.doc")))
    ok &= _possible("p.size", "p.pos", "q.size", "q.pos", percent) & (share * (100 + percent) >= _needed(F.col("p.size"), F.col("q.size"), percent))
    return p.join(q, ok).select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).distinct()


def bounded_pairs(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) with what they share at most, by their bitmaps (doc_id, size, bitmap); ids with several sets keep the largest bound."""
    one = lambda c: maps.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("bitmap").alias(f"map_{c}"))
    rows = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "size_a", "size_b", "map_a", "map_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [c.to_numpy() for c in batch.columns[2:4]]
            bounds = [most_shared(x.as_py(), int(m), y.as_py(), int(n)) for x, y, m, n in zip(batch.column(4), batch.column(5), *sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bounds, pa.int64())], ["a", "b", "size_a", "size_b", "most"])
        give_back()

    return rows.mapInArrow(run, "a long, b long, size_a long, size_b long, most long")


def _open(bounded: DataFrame, percent: int) -> DataFrame:
    """Pairs that their bounds leave open."""
    return bounded.where(F.col("most") * (100 + percent) >= _needed(F.col("size_a"), F.col("size_b"), percent)).select("a", "b").distinct()


def compare(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, common, size_a, size_b, link) of the pairs, by comparing the whole sets of their ``rows`` (doc_id, text)."""
    wanted = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    sets = materialize(sets_of(rows.join(broadcast_if_small(wanted, 2_000_000), "doc_id", "left_semi"), n), "grams")
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int"))
    busy = materialize(busy.select("a", "parts"), "busy")
    spread = pairs.join(busy, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part")
    members = spread.join(sets.select(F.col("doc_id").alias("b"), "grams"), "b")
    heads = busy.join(sets.select(F.col("doc_id").alias("h"), F.col("grams").alias("head_grams")), F.col("a") == F.col("h"))
    heads = heads.select(F.col("h"), "head_grams", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("link", pa.bool_())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        # Rows that repeat the head's doc_id may have other texts: each distinct set is compared.
        heads = [h for h in (np.frombuffer(x, np.uint64) for x in {raw.as_py() for raw in right.column("head_grams")}) if len(h)]
        got = []
        for b, raw in zip(left.column("b").to_pylist(), left.column("grams"), strict=True):
            other = np.frombuffer(raw.as_py(), np.uint64)
            if not len(other):
                continue
            for head in heads:
                small, large = (head, other) if len(head) < len(other) else (other, head)
                spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
                got.append((b, int((large[spot] == small).sum()), len(head), len(other)))
        if not got:
            return out.empty_table()
        b, common, size_a, size_b = (np.array(x, np.int64) for x in zip(*got, strict=True))
        a = np.full(len(b), left.column("a")[0].as_py(), np.int64)
        if left.nbytes > LARGE:
            give_back()
        return pa.table({"a": a, "b": b, "common": common, "size_a": size_a, "size_b": size_b, "link": linked(common, size_a, size_b, percent)}, schema=out)

    return members.groupBy("a", "part").cogroup(heads.groupBy("h", "part")).applyInArrow(run, "a long, b long, common long, size_a long, size_b long, link boolean")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams): each row's sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches_of(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(data, offsets, n)], pa.binary())], ["doc_id", "grams"])

    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, "doc_id long, grams binary")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Null texts and texts without words have the empty set, which links with nothing: they are their own
    component. Rows with a null doc_id come back with a null component. Rows that repeat a doc_id are one
    node of the link graph: they share its component, whatever text links them.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, frequent = summarise(rows, n)
    classes = sets.where("size > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    # Copies of a set are few beside all rows, so they are what is taken out.
    copies = sets.where("size > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id").distinct()
    copies = materialize(copies, "copies")
    texts = rows.where("doc_id IS NOT NULL").join(broadcast_if_small(copies, 2_000_000), "doc_id", "left_anti")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    buckets = int(max(64, total // 150_000))
    lists = materialize(best_lists(texts, frequent, n, percent, buckets), "lists")
    maps = materialize(sets.where("size > 0").select("doc_id", "size", "bitmap").join(broadcast_if_small(copies, 2_000_000), "doc_id", "left_anti"), "bitmaps")
    heads = materialize(lists.groupBy("list").agg(F.min(F.struct("rank", "doc", "size", "pos")).alias("h")), "heads")
    first = materialize(bounded_pairs(head_pairs(lists, heads, percent), maps), "pairs-1")
    done = materialize(compare(materialize(_open(first, percent), "open-1"), rows, n, percent), "compared-1")
    links = done.where("link")
    roots = components(links)
    # Ids with several sets have several bounds: the widest holds for each.
    exact = done.groupBy("a", "b").agg(F.min("common").alias("low"), F.max("common").alias("high"))
    known = first.groupBy("a", "b").agg(F.max("most").alias("most")).join(exact, ["a", "b"], "left")
    known = known.select("a", "b", F.coalesce("low", F.lit(0)).alias("least"), F.coalesce("high", "most").alias("most"))
    second = materialize(bounded_pairs(open_pairs(lists, heads, roots, known, percent), maps), "pairs-2")
    more = materialize(compare(materialize(_open(second, percent), "open-2"), rows, n, percent), "compared-2").where("link")
    # Documents, linked through their class's representative; repeated ids link their classes.
    every = links.select("a", "b").union(more.select("a", "b"))
    own = sets.where("size > 0 AND doc_id IS NOT NULL").join(classes.where("copies > 1"), ["set_a", "set_b", "size"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = components(every.union(own))
    out = sets.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component (the smallest doc_id; one row of it); same columns.

    Rows with a null doc_id count as documents behind all others, one for each text. Of rows that repeat a
    doc_id the one with the least hash of its text stays. Documents with empty sets all stay.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    keyed = docs.withColumn("_key", key)
    found = materialize(near_duplicates(keyed, n=n, percent=percent, key="_key").select("doc_id", "component_id"), "found")
    gone = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = keyed.join(broadcast_if_small(gone, 2_000_000), F.col("_key") == F.col("_gone"), "left_anti")
    again = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    again = materialize(again, "again")
    if not again.isEmpty():
        again = broadcast_if_small(again, 2_000_000)
        order = Window.partitionBy("_key").orderBy(F.xxhash64("text"), F.length("text"))
        once = kept.join(again, F.col("_key") == F.col("_again"), "left_semi").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
        kept = kept.join(again, F.col("_key") == F.col("_again"), "left_anti").unionByName(once)
    return kept.drop("_key")
