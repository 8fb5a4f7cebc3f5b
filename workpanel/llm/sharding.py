"""Balanced label propagation: documents with equal texts share a shard, shards stay even.

Documents of one text are linked.  A text with more copies than a shard holds
is split into units of at most that many; every other text is one unit.  Each
round is a set of Spark aggregates and joins: every unit wants the shard most
of its documents are in, shards admit the units with the largest gain while
their quota lasts, and admitted documents move.  Only tables of ``shards`` by
64 numbers (gains by power of two) reach the driver.  At the end documents
without a link fill the shards up, so that row counts differ by one at most;
linked ones are touched only where they alone exceed a shard.

Defined cases: null and empty texts are equal and have size 16; repeated rows
are documents of their own; null ids are allowed; extra columns are ignored;
an empty table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workpanel.llm.common import numbered, staged

ROUNDS = 8
OVERHEAD = 16  # bytes beside the text


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def admitted(wish: DataFrame, quota: list[int], turn: int) -> tuple[DataFrame, set[int]]:
    """The units of ``unit, target, all, gain`` that fit into the targets' quotas,
    largest gains first, and the targets that had to turn units away."""
    wish = wish.withColumn("level", F.floor(F.log2("gain")).cast("int"))
    # at most shards * 64 rows
    table = {(r["target"], r["level"]): r["n"] for r in
             wish.groupBy("target", "level").agg(F.sum("all").alias("n")).collect()}
    rows, full = [], set()
    for shard, left in enumerate(quota):
        for k in sorted((k for s, k in table if s == shard), reverse=True):
            n = table[shard, k]
            rows.append((shard, k, min(1.0, max(0.0, left / n))))
            left -= n
        if left < 0:
            full.add(shard)
    shares = wish.sparkSession.createDataFrame(rows, "target int, level int, share double")
    luck = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
    return wish.join(F.broadcast(shares), ["target", "level"]).filter(luck < F.col("share")).select("unit", "target"), full


def propagate(linked: DataFrame, capacity: list[int]) -> DataFrame:
    """``uid, unit, shard`` after rounds of moves; ``linked`` has the same columns.
    Units that lie in one shard stay; the others want the shard most of their
    documents are in, of those that have not turned units away yet."""
    full: set[int] = set()
    for turn in range(ROUNDS):
        tally = linked.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"))
        free = (~F.col("shard").isin(sorted(full))).cast("int") if full else F.lit(1)
        best = tally.groupBy("unit").agg(
            F.max(F.struct(free.alias("free"), "n", F.xxhash64("unit", "shard").alias("tie"), "shard")).alias("top"),
            F.sum("n").alias("all"), F.count(F.lit(1)).alias("pieces"))
        others = [s for s in range(len(capacity)) if s not in full] or list(range(len(capacity)))
        any_free = _lookup(others, F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(len(others))).cast("int"))
        wish = staged(best.select(
            "unit", "all", "pieces", F.col("top.n").alias("gain"),
            F.when((F.col("pieces") == 1) | (F.col("top.free") == 1), F.col("top.shard")).otherwise(any_free).alias("target")), "shard-wishes")
        stay = {r["target"]: r["n"] for r in wish.filter("pieces = 1").groupBy("target").agg(F.sum("all").alias("n")).collect()}
        split = wish.filter("pieces > 1")
        if split.isEmpty():
            break
        moves, refused = admitted(split, [c - stay.get(s, 0) for s, c in enumerate(capacity)], turn)
        linked = staged(linked.join(moves, "unit", "left")
                        .select("uid", "unit", F.coalesce("target", "shard").alias("shard")), "shard-linked")
        full |= refused
    return linked


def evened(placed: DataFrame, capacity: list[int], rows: int) -> DataFrame:
    """``uid, shard`` with exactly ``capacity`` rows in each shard: documents over
    it leave, those without links first, and fill the others in order."""
    ranked = staged(numbered(placed, ["shard", "linked"], "uid", rows), "shard-ranked")
    counts = {(r["shard"], r["linked"]): r["n"] for r in ranked.groupBy("shard", "linked").agg(F.count("*").alias("n")).collect()}
    singles = [counts.get((s, 0), 0) for s in range(len(capacity))]
    excess = [singles[s] + counts.get((s, 1), 0) - c for s, c in enumerate(capacity)]
    out_single = [min(singles[s], max(0, e)) for s, e in enumerate(excess)]
    out_linked = [max(0, e) - o for e, o in zip(excess, out_single)]
    first, at = {}, 0
    for s in range(len(capacity)):
        for kind, n in ((0, out_single[s]), (1, out_linked[s])):
            first[s, kind] = at
            at += n
    ends, total = [], 0
    for e in excess:
        total += max(0, -e)
        ends.append(total)
    shard, is_linked = F.col("shard"), F.col("linked") == 1
    both = lambda a, b: F.when(is_linked, _lookup(b, shard)).otherwise(_lookup(a, shard))
    leaves = F.col("rank") < both(out_single, out_linked)
    place = F.col("rank") + both([first[s, 0] for s in range(len(capacity))], [first[s, 1] for s in range(len(capacity))])
    to = sum((F.when(place >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    return ranked.select("uid", F.when(leaves, to).otherwise(shard).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, unit, shard, slot``: sizes in bytes, the link
    unit (null without a link), the shard and the place in it, gapless from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = staged(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")), "shard-nodes")
    rows = nodes.count()
    capacity = [rows // shards + (s < rows % shards) for s in range(shards)]
    key = ["h1", "h2", "size"]
    groups = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    members = nodes.select("uid", *key).join(groups, key)
    limit = max(1, capacity[-1])
    large = numbered(members.filter(F.col("copies") > limit), key, "uid", rows)
    parts = (members.filter(F.col("copies") <= limit).withColumn("part", F.lit(0).cast("long"))
             .unionByName(large.withColumn("part", F.floor(F.col("rank") / limit).cast("long")).drop("rank")))
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = staged(parts.select("uid", F.xxhash64(*key, "part").alias("unit"), start.alias("shard")), "shard-linked")
    linked = propagate(linked, capacity)
    placed = (nodes.select("uid").join(linked, "uid", "left")
              .select("uid", F.coalesce("shard", start).alias("shard"), F.col("unit").isNotNull().cast("int").alias("linked")))
    even = staged(evened(placed, capacity, rows), "shard-even")
    slots = numbered(even, ["shard"], "uid", rows, out="slot")
    return (nodes.join(slots, "uid").join(linked.select("uid", "unit"), "uid", "left")
            .select("doc_id", "size", "text_crc32", "unit", "shard", "slot"))
