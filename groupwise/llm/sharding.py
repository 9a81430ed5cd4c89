"""Sharding by balanced label propagation over linked documents.

Documents with equal texts are linked through their group (a hub, so no pair is listed). Each
round sums a group's bytes by shard, offers every linked document the shard that holds most of
its group, and accepts moves in hash order while the shard's quota lasts. Quotas and prefix sums
work on histograms of BUCKETS hash buckets a shard, a table of fixed size; only those are
broadcast, and only one number a shard reaches the driver. At the end linked documents beyond a
shard's even size are released, and free documents, large ones first, fill the shards to one
level, so the law `bytes` holds: sizes are near equal.

The only links of a document are its equal texts, so propagation runs on groups that are complete
in themselves; what it decides is the shard of each group and which part of a group too large for
its quota moves. Rows of groups with more than HOT documents are joined by broadcast (up to
HOT_GROUPS of them, the largest), all others by shuffling on the group, so no task holds a large one.

Defined results: null text has size 1, CRC 0 and is linked with other null or empty texts; null
or repeated ids are placed row by row; rows with equal ids and texts are told apart by their place
in the input, which also settles ties; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupwise.llm.common import discard, materialise

BUCKETS = 4096
#: Parts that a group's moves are accepted in, so that a huge group can move in part.
GROUP_PARTS = 16
#: Documents from which on a group is joined by broadcast, and the most groups that are.
HOT, HOT_GROUPS = 512, 50_000
#: Sizes at which free documents are split into classes, the largest placed first.
CLASSES = [1 << 14, 1 << 11, 1 << 8]


def _totals(df: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("size")).collect()}
    return [int(found.get(s) or 0) for s in range(shards)]


def _running(df: DataFrame, *by: str) -> DataFrame:
    """Bytes of each (by, bucket) and of the earlier buckets of the same `by`: a bounded table."""
    sums = df.groupBy(*by, "bucket").agg(F.sum("size").alias("here"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))


def level_quotas(held: list[int], free: int) -> list[float]:
    """What each shard takes of `free` bytes so that the least full ones rise to one level."""
    low = sorted(held)
    level, used = float(low[0]) if low else 0.0, 0.0
    for k in range(1, len(low) + 1):
        step = (low[k] - level) * k if k < len(low) else float("inf")
        if used + step >= free:
            level += (free - used) / k
            break
        used, level = used + step, float(low[k])
    return [max(0.0, level - h) for h in held]


def shard(docs: DataFrame, shards: int = 8, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("group"),
    )
    rows = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(BUCKETS)).cast("int")), "rows")
    groups = materialise(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    hot = groups.where(F.col("n") > HOT).orderBy(F.desc("n"), "group").limit(HOT_GROUPS)
    hot = materialise(hot.select("group", F.lit(True).alias("hot")), "hot")
    known = F.broadcast(hot)  # at most HOT_GROUPS rows
    start = F.pmod(F.xxhash64("doc_id", "uid", F.lit(1)), F.lit(shards)).cast("int")
    flagged = rows.join(known, "group", "left")
    calm = groups.join(known, "group", "left_anti").select("group", F.lit(True).alias("many"))
    calm = flagged.where("hot is null").join(calm, "group", "left").select(*rows.columns, F.lit(False).alias("hot"), F.coalesce("many", F.lit(False)).alias("linked"))
    marked = calm.unionByName(flagged.where("hot").withColumn("linked", F.lit(True)))
    marked = materialise(marked.withColumn("shard", start), "marked")
    discard(rows, groups, hot)
    even = sum(_totals(marked, shards)) / shards
    free = marked.where(~F.col("linked")).drop("linked", "hot")
    linked, first = marked.where("linked").drop("linked"), marked

    for _ in range(rounds):
        quota = F.array(*[F.lit(max(0.0, even - h)) for h in _totals(linked, shards)])  # free documents give way
        most = linked.groupBy("hot", "group", "shard").agg(F.sum("size").alias("bytes")).groupBy("hot", "group").agg(F.max(F.struct("bytes", (-F.col("shard")).alias("s"))).alias("m")).select("hot", "group", (-F.col("m.s")).alias("to"))
        part = F.pmod(F.xxhash64("group", F.pmod(F.xxhash64("uid"), F.lit(GROUP_PARTS))), F.lit(BUCKETS)).cast("int")
        to_hot = F.broadcast(most.where("hot").drop("hot"))  # at most HOT_GROUPS rows
        offered = linked.where("hot").join(to_hot, "group").unionByName(linked.where(~F.col("hot")).join(most.where(~F.col("hot")).drop("hot"), "group"))
        offered = offered.withColumns({"own": F.col("bucket"), "bucket": part})
        quotas = _running(offered.where("to <> shard").select("to", "bucket", "size"), "to").where(F.col("before") + F.col("here") <= F.get(quota, F.col("to")))
        taken = F.broadcast(quotas.select("to", "bucket", F.lit(True).alias("ok")))  # at most shards * BUCKETS rows
        moved = offered.join(taken, ["to", "bucket"], "left").withColumn("shard", F.when(F.col("ok"), F.col("to")).otherwise(F.col("shard")))
        after = materialise(moved.withColumn("bucket", F.col("own")).select(*linked.columns), "linked")
        discard(linked)
        linked = after

    limits = F.array(*[F.lit(even)] * shards)
    kept = _running(linked.select("shard", "bucket", "size"), "shard").where(F.col("before") + F.col("here") <= F.get(limits, F.col("shard")))
    kept = F.broadcast(kept.select("shard", "bucket", F.lit(True).alias("stay")))  # at most shards * BUCKETS rows
    settled = materialise(linked.join(kept, ["shard", "bucket"], "left").select(*free.columns, "stay"), "settled")
    placed = [settled.where("stay").drop("stay")]
    free = settled.where("stay is null").drop("stay").unionByName(free)
    held = _totals(placed[0], shards)
    bounds = [None, *CLASSES, None]
    waste = [linked, settled, first]
    for upper, lower in zip(bounds, bounds[1:], strict=False):
        some = free if upper is None else free.where(F.col("size") <= upper)
        some = some if lower is None else some.where(F.col("size") > lower)
        sums = some.agg(F.sum("size")).first()[0]
        if not sums:
            continue
        ends, at = [], 0.0
        for q in level_quotas(held, int(sums)):
            at += q
            ends.append(at)
        offsets = F.broadcast(_running(some.select(F.lit(0).alias("all"), "bucket", "size"), "all").select("bucket", "before"))  # BUCKETS rows
        within = Window.partitionBy("bucket").orderBy("doc_id", "uid")
        middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
        to = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("middle"))), F.lit(shards - 1))
        done = materialise(some.join(offsets, "bucket").withColumn("middle", middle).withColumn("shard", to.cast("int")).select(*free.columns), "placed")
        held = [a + b for a, b in zip(held, _totals(done, shards), strict=True)]
        placed.append(done)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    out = materialise(out, "shards")
    discard(*waste, *placed[1:])
    counted = out.groupBy("shard", "bucket").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(counted.select("shard", "bucket", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("base")))  # at most shards * BUCKETS rows
    slot = F.col("base") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "uid")) - 1
    return out.join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
