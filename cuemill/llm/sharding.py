"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents are documents with equal texts. Each begins in a shard by hash. In every round a group
prefers the shard that holds most of it among those with room; its members elsewhere move there, each
with the probability (by hash) that keeps the shard's expected arrivals within its room. Rounds end when
nothing wants to move. Groups are hubs, so a group of n documents costs n rows, never n * n pairs, and
it may be larger than a shard: what does not fit prefers another shard in the next round.

At last shards are made even: documents keep their shard up to its quota, and the surplus, with all
unlinked documents, fills what is open. Places come from counts per cell (a few hundred to some
ten thousand rows, hot groups salted) and running sums over the cells, so no task sees a whole shard or
a whole group. The law is ``rows``: counts of two shards differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import materialize

LAW = "rows"
#: Rows of a cell: a 2048th of all rows within these bounds.
CELL_LEAST, CELL_MOST = 128, 1 << 16
ROUNDS = 12
#: Buckets of cells that are summed together.
STRIPE = 1 << 12
_UNIT = float(1 << 53)


def _share(*columns: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(_UNIT)


def _loads(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of every shard, empty ones too: ``shards`` rows."""
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = docs.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    return every.join(F.broadcast(held), "shard", "left").fillna(0, ["held"])


def propagate(linked: DataFrame, groups: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels of linked documents after balanced propagation.

    ``linked`` (doc columns, grp, salt) and ``groups`` (grp, salts): a group's rows are spread over ``salts`` keys,
    so that no join or count has a hot key.
    """
    state = linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "grp", F.lit("start")), F.lit(shards)).cast("int"))
    state = materialize(state, "labels-0")
    for turn in range(1, rounds + 1):
        loads = _loads(state, shards).withColumn("room", F.greatest(F.lit(capacity) - F.col("held"), F.lit(0)))
        cells = state.groupBy("grp", "salt", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("grp", "shard").agg(F.sum("n").alias("n"))
        cells = cells.join(F.broadcast(loads), "shard")
        # A shard that is almost full would only take a few and keep a large group from the next one.
        best = F.struct("n", -F.col("shard"))
        wish = cells.groupBy("grp").agg(F.max(F.when(F.col("room") >= max(1, capacity // 32), best)).alias("best"), F.sum("n").alias("all"))
        wish = wish.select("grp", (-F.col("best.col2")).alias("target"), F.col("best.n").alias("there"))
        # A cell follows its group's wish if fewer of the group are in it (or as many, in a later shard).
        moves = cells.join(wish, "grp").where("target IS NOT NULL AND shard != target AND (n < there OR (n = there AND shard > target))")
        asked = moves.groupBy(F.col("target").alias("shard")).agg(F.sum("n").alias("asked"))
        odds = asked.join(F.broadcast(loads), "shard").select(F.col("shard").alias("target"), F.least(F.lit(1.0), F.col("room") / F.col("asked")).alias("odds"))
        plan = moves.join(F.broadcast(odds), "target").join(groups, "grp").select("grp", "shard", "target", "odds", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        plan = materialize(plan, f"moves-{turn}")
        if plan.isEmpty():
            break
        goes = F.col("target").isNotNull() & (_share(F.col("doc_id"), F.col("grp"), F.lit(turn)) < F.col("odds"))
        state = state.join(plan, ["grp", "salt", "shard"], "left").withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target", "odds")
        state = materialize(state, f"labels-{turn}")
    return state


def _ranked(rows: DataFrame, cell: list[str], order: list[str], within: list[str]) -> DataFrame:
    """``rows`` with ``place``: a gapless number from 0 in each ``within``, following cells (``bucket`` among them), then ``order``."""
    own = Window.partitionBy(*within, *cell)
    numbered = rows.withColumn("nth", F.row_number().over(own.orderBy(*order)) - 1)
    # Running sums over cells, not over documents; in two levels, so that no task holds all cells.
    counts = rows.groupBy(*within, *cell).agg(F.count(F.lit(1)).alias("n")).withColumn("stripe", F.floor(F.col("bucket") / STRIPE))
    lead = [*cell[: cell.index("bucket")], "stripe"]
    stripes = counts.groupBy(*within, *lead).agg(F.sum("n").alias("all"))
    whole = Window.partitionBy(*within).orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.select(*within, *lead, F.coalesce(F.sum("all").over(whole), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*within, *lead).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(stripes, [*within, *lead])
    counts = counts.select(*within, *cell, (F.col("before") + F.col("earlier")).alias("before"))
    return numbered.join(counts, [*within, *cell]).withColumn("place", F.col("before") + F.col("nth")).drop("before", "nth")


def cut_edges(placed: DataFrame, *, group: str = "grp", shard: str = "shard") -> DataFrame:
    """One row (edges, cut): links between documents of a group, and those whose ends are in two shards.

    Counted from sizes: a group of n documents has n * (n - 1) / 2 links, its part in one shard likewise.
    """
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    parts = placed.where(F.col(group).isNotNull()).groupBy(group, shard).agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(group).agg(F.sum("n").alias("all"), F.sum(pairs("n")).alias("inside"))
    return whole.agg(F.coalesce(F.sum(pairs("all")), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(pairs("all") - F.col("inside")), F.lit(0.0)).alias("cut"))


def assign_shards(docs: DataFrame, *, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) for every row of ``docs``.

    A null text has no bytes (size 8, crc32 0) and is linked with nothing; empty texts are equal texts.
    Repeated rows are rows of their own, in slots next to each other; a null key is allowed. An empty
    table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    raw = F.col(text).cast("binary")
    base = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("grp"),
    )
    base = materialize(base, "rows")
    total = base.count()
    cell = min(max(CELL_LEAST, total // 2048), CELL_MOST)
    quota, extra = divmod(total, shards)
    sizes = base.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = materialize(sizes.withColumn("salts", F.ceil(F.col("members") / F.lit(cell)).cast("int")), "groups")
    tagged = base.join(groups, "grp", "left")
    tagged = tagged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", F.lit("salt")), F.coalesce("salts", F.lit(1))).cast("int"))
    tagged = materialize(tagged, "tagged")
    linked = tagged.where("members IS NOT NULL").select("doc_id", "size", "text_crc32", "grp", "salt")
    state = propagate(linked, groups.select("grp", "salts"), shards, quota + (extra > 0))
    # Linked documents rank in their shard by group, so that a quota cuts few groups.
    spread = F.pmod(F.xxhash64("grp"), F.lit(max(1, total // (cell * shards)))).cast("int")
    ranked = _ranked(state.withColumn("bucket", spread), ["bucket", "salt"], ["grp", "doc_id"], ["shard"])
    quotas = F.lit(quota) + (F.col("shard") < extra).cast("int")
    ranked = materialize(ranked.withColumn("quota", quotas), "ranked")
    stay = ranked.where("place < quota").select("doc_id", "size", "text_crc32", "shard", F.col("place").alias("slot"))
    names = ["doc_id", "size", "text_crc32", "grp"]
    pool = ranked.where("place >= quota").select(*names).withColumn("late", F.lit(0)).union(tagged.where("members IS NULL").select(*names).withColumn("late", F.lit(1)))
    # The surplus goes first and group by group; then the unlinked documents.
    spread = F.pmod(F.when(F.col("late") == 0, F.xxhash64("grp")).otherwise(F.xxhash64("doc_id", "text_crc32")), F.lit(max(1, total // cell))).cast("int")
    pool = pool.withColumn("bucket", spread).withColumn("salt", F.when(F.col("late") == 0, F.pmod(F.xxhash64("doc_id", F.lit("pool")), F.lit(8))).otherwise(0).cast("int"))
    pool = _ranked(pool, ["late", "bucket", "salt"], ["grp", "doc_id"], [])
    kept = _loads(stay, shards)
    gaps = kept.withColumn("open", F.lit(quota) + (F.col("shard") < extra).cast("int") - F.col("held")).where("open > 0")
    # At most ``shards`` rows.
    gaps = gaps.withColumn("from", F.coalesce(F.sum("open").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = gaps.select("shard", "held", "from", (F.col("from") + F.col("open")).alias("to"))
    filled = pool.join(F.broadcast(gaps), (F.col("place") >= F.col("from")) & (F.col("place") < F.col("to")))
    filled = filled.select("doc_id", "size", "text_crc32", "shard", (F.col("held") + F.col("place") - F.col("from")).alias("slot"))
    return stay.unionByName(filled).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
