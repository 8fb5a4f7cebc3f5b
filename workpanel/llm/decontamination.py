"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive tokens; tokens at its zeros are ignored, so a
changed word there does not hide the match.  Seeds of all positions of all
training texts are joined with those of the benchmark, and around each hit the
stretch that the two texts have in common is verified.

A document *leaks* an item of ``SPAN`` tokens or more if, at some alignment of the two, a
span of ``SPAN`` tokens with up to ``FLANK`` more on either side agrees, position by position,
to ``min_share`` or more, over at least min(``LEAST``, tokens of the item) tokens (a shorter
document, of ``SPAN`` tokens at least, has to be compared as a whole).  The masks miss none of these
stretches: one of them fits into what agrees, wherever the tolerated changes are (at a
``min_share`` of 0.8 or more; a test tries all placements).  Shorter items have to stand in the
document as a whole, unchanged and in order.

The benchmark's distinct texts are dealt into blocks of a bounded number of
seeds; each block is broadcast and the training texts stream past it, so a
large benchmark means more blocks, not a larger broadcast.

Defined cases: null and empty texts leak nothing, on either side, and texts of fewer than
``SPAN`` tokens only items that are shorter still; short items of fewer than
``least_tokens`` different tokens are not looked for; benchmark items with equal tokens count
as one, named by the smallest id; repeated training rows give one pair; extra columns
are ignored; an empty table on either side gives no pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workpanel.llm.common import broadcast_if_small, staged, unused

SPAN = 12
#: Tokens compared on either side of the span; the fewest compared in all.
FLANK, LEAST = 6, 16
#: Seeds that one broadcast holds, at about 300 bytes each.
BLOCK_SEEDS = 150_000
#: The masks, one character for each token: whatever stretch of SPAN to SPAN + 2 * FLANK tokens agrees to
#: 80 %, one of them fits into what agrees (four in a row, or twice three around a change).
MASKS = ("1111", "1110111")
#: The tokens that are looked at before a seed's position, and from there on.
BACK, AHEAD = SPAN + 2 * FLANK - 1, SPAN + 2 * FLANK


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; null gives an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.xxhash64(t))


def mask_seeds(df: DataFrame, at: str, masks: list[str]) -> DataFrame:
    """One row for each position and mask that fits of array ``toks``: position ``at``
    and ``seed``, the hash of the mask and the tokens at its ones."""
    df = (df.filter(F.size("toks") >= min(map(len, masks)))
          .withColumn(at, F.explode(F.sequence(F.lit(0), F.size("toks") - min(map(len, masks))))))
    hashes = [F.when(F.col(at) + len(mask) <= F.size("toks"),
                     F.xxhash64(F.lit(mask), *[F.get("toks", F.col(at) + o) for o, x in enumerate(mask) if x == "1"]))
              for mask in masks]
    return df.withColumn("seed", F.explode(F.array(*hashes))).filter("seed is not null")


def holds(min_share: float) -> tuple[Column, Column]:
    """The state ``a`` of a hit, and by it whether a placement of the span that has ``q`` in it or around it holds: of the
    tokens that both texts have there, ``min_share`` agree, and they are enough."""
    percent, p, q, n, m = round(100 * min_share), *map(F.col, "pqnm")
    start, end = -F.least(p, q), F.least(n - p, m - q)  # of the common stretch, from the seed on
    back, ahead = F.least(-start, F.lit(BACK)), F.least(end, F.lit(AHEAD))
    same = F.zip_with(F.slice("toks", p - back + 1, back + ahead), F.slice("other", F.least(q, F.lit(BACK)) - back + 1, back + ahead),
                      lambda x, y: x == y)
    needed = F.least(F.lit(LEAST), m, F.greatest(F.lit(SPAN), n))
    first, last = F.greatest(start, F.lit(FLANK + 1 - AHEAD)), F.least(end - SPAN, F.lit(FLANK))

    def placed(z: Column) -> Column:
        lo, hi = F.greatest(z - FLANK, start), F.least(z + SPAN + FLANK, end)
        equal = F.size(F.filter(F.slice(F.col("a.same"), lo + F.col("a.back") + 1, hi - lo), lambda x: x))
        return (hi - lo >= F.col("a.needed")) & (100 * equal >= percent * (hi - lo))

    return (F.struct(same.alias("same"), back.alias("back"), needed.alias("needed"), first.alias("first"), last.alias("last")),
            # few seeds that meet by chance have this many equal tokens around them
            F.when((F.size(F.filter("a.same", lambda x: x)) >= math.ceil(min_share * SPAN)) & (F.col("a.first") <= F.col("a.last")),
                   F.exists(F.sequence("a.first", "a.last"), placed)).otherwise(False))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", min_share: float = 0.8,
                 least_tokens: int = 1) -> DataFrame:
    """``doc_id, item_id`` for every training text and benchmark text that share a
    verified stretch, or of which the first holds the whole of the short second."""
    items = staged(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("toks"))
                   .groupBy("toks").agg(F.min("item_id").alias("item_id")), "benchmark-items")
    own = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks")).withColumn("n", F.size("toks"))
    around = F.slice("toks", F.col("q") - F.least("q", F.lit(BACK)) + 1, F.least("q", F.lit(BACK)) + AHEAD)
    index = (mask_seeds(items.filter(F.size("toks") >= SPAN), "q", MASKS)
             .select("seed", "item_id", "q", F.size("toks").alias("m"), around.alias("other")))
    state, held = holds(min_share)

    def blocked(part: DataFrame, *key: str) -> list[DataFrame]:
        blocks = max(1, math.ceil(part.count() / BLOCK_SEEDS))
        return [part if blocks == 1 else part.filter(F.pmod(F.xxhash64(*key), F.lit(blocks)) == k) for k in range(blocks)]

    found = []
    for part in blocked(index, "item_id", "q"):
        hits = mask_seeds(own.filter(F.col("n") >= SPAN), "p", MASKS).join(F.broadcast(part), "seed")
        # the explode keeps the check out of the join's condition, which stays a plain look-up
        hits = hits.withColumn("a", F.explode(F.array(state)))
        found.append(hits.filter(held).select("doc_id", "item_id"))
    short = items.filter(F.size("toks").between(1, SPAN - 1) & (F.size(F.array_distinct("toks")) >= least_tokens))
    lengths = sorted(r[0] for r in short.select(F.size("toks")).distinct().collect())
    if lengths:
        whole = ["1" * k for k in lengths]
        of_all = F.coalesce(*[F.when(F.size("toks") == k, F.xxhash64(F.lit("1" * k), *[F.get("toks", F.lit(o)) for o in range(k)])) for k in lengths])
        index = short.select("item_id", of_all.alias("seed"))
        for part in blocked(index, "seed"):
            found.append(mask_seeds(own.select("doc_id", "toks"), "p", whole).select("doc_id", "seed")
                         .join(F.broadcast(part), "seed").select("doc_id", "item_id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the rows whose text leaks a benchmark item (``contaminated``).
    Rows are told apart by content where ids repeat or are null: by id and a hash of the text."""
    row = unused(docs, "_row")
    key = F.xxhash64(F.col(id_col), F.col(kw.get("text_col", "text")))
    found = contaminated(docs.withColumn(row, key), benchmark, id_col=row, **kw).select(F.col("doc_id").alias(row))
    found = broadcast_if_small(staged(found.distinct(), "leaks"))
    return docs.withColumn(row, key).join(found, row, "left_anti").drop(row)
