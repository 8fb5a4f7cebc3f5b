r"""Hard negatives by Four-Russians scoring: exact integer inner products by table look-up.

Components become integers, and a vector is kept as bit planes: for each plane one
byte for every eight dimensions.  An anchor's table holds, for each group of
eight dimensions, the sums of all 256 subsets of its components.  The sum of a
plane is then one look-up a group, indexed with the candidate's byte, and the
score is the sum of the planes, shifted by their place (the highest plane is
the sign and counts negative).  Scores are the exact products.

1. All rows are packed once (``packed``), written, and dealt evenly.
2. Anchors come in blocks whose tables fit ``TABLE_BYTES``; a block's vectors go to
   the workers, which build the tables.  A larger table has more blocks, not larger ones.
3. For each block the rows stream past twice: against anchors of their own label for the
   best positives, and against those of other labels for negatives in the range
   that each positive sets.  A task keeps the best ``k`` of each anchor or
   positive; a window picks the best over all tasks.

Every row is scored against every anchor of a block; no candidate is left out
or capped.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; vectors of different lengths are compared as if the
shorter one ended in zeros; equal scores are ordered by the smaller id; rows
equal in id, label and integers count once; rows that share an id but differ are
rows of their own, though none is a positive of its own id, and one id with one
score counts once; anchors without
positives, and positives without negatives in range, give no rows; extra columns
are ignored; an empty table gives no rows.  Scores have 64 bits, as SQL's
BIGINT: where dimensions times the largest component squared pass 2^62, the
operator raises ArithmeticError, as SQL does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workpanel.llm.common import Scratch

#: Bytes of one block's tables in a worker: 8,192 anchors of 64 dimensions.
TABLE_BYTES = 64 << 20
#: Scores that a worker holds at a time.
SCORES = 1 << 21
GROUP = 8


def integers(vector: np.ndarray, dims: int, scale: int) -> np.ndarray:
    out = np.zeros(dims, "i8")
    out[:len(vector)] = np.floor(np.asarray(vector, "f8") * scale)
    return out


def planes_of(values: np.ndarray, planes: int) -> np.ndarray:
    """``(rows, planes, groups)`` bytes of integers ``(rows, dims)`` in two's complement."""
    rows, dims = values.shape
    groups = -(-dims // GROUP)
    full = np.zeros((rows, groups * GROUP), "i8")
    full[:, :dims] = values
    bits = (full[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype("u1").reshape(rows, planes, groups, GROUP), axis=3, bitorder="little")[..., 0]


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``(groups, 256, anchors)``: sums of the subsets of each group's components; bit i of the subset is dimension i."""
    rows, dims = anchors.shape
    groups = -(-dims // GROUP)
    full = np.zeros((rows, groups * GROUP), "i8")
    full[:, :dims] = anchors
    kind = "i4" if GROUP * int(np.abs(full).max(initial=0)) < 1 << 31 else "i8"
    own = full.reshape(rows, groups, GROUP).transpose(1, 2, 0).astype(kind)
    sums = np.zeros((groups, 1 << GROUP, rows), kind)
    for bit in range(GROUP):
        half = 1 << bit
        sums[:, half:2 * half] = sums[:, :half] + own[:, bit, None]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray, kind: str = "i8") -> np.ndarray:
    """Exact products ``(candidates, anchors)``; ``kind`` holds every one of them."""
    rows, n_planes, groups = planes.shape
    total = np.zeros((rows, sums.shape[2]), kind)
    for plane in range(n_planes - 1, -1, -1):
        total <<= 1
        for group in range(groups):
            part = sums[group].take(planes[:, plane, group], axis=0)
            if plane == n_planes - 1:
                total -= part
            else:
                total += part
    return total


class Best:
    """The ``k`` best of each slot: highest score, then smallest id; an id and score count once."""

    def __init__(self, slots: int, k: int, low: np.ndarray):
        self.k, self.low = k, low.copy()  # what a score has to reach
        self.slot = self.score = self.id = np.zeros(0, "i8")
        self.slots = slots

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        start = np.searchsorted(slot, np.arange(self.slots))
        rank = np.arange(len(slot)) - start[slot]
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.low[self.slot[full]] = self.score[full]  # an equal score may still win by its id


def blocks_of_rows(batches: Iterator[pd.DataFrame], planes: int, groups: int, rows: int) -> Iterator[tuple]:
    for frame in batches:
        for at in range(0, len(frame), rows):
            part = frame.iloc[at:at + rows]
            own = np.frombuffer(b"".join(part["planes"].tolist()), "u1").reshape(len(part), planes, groups)
            yield part["vec_id"].to_numpy("i8"), part["label"].to_numpy("i8"), own


def positives_in(shared, planes: int, groups: int, k: int, kind: str):
    """Per task: the best ``k`` rows of each anchor's own label."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors = shared.value
        by_label = {int(l): np.flatnonzero(labels == l) for l in np.unique(labels)}
        sums = subset_sums(vectors)
        sums = {l: np.ascontiguousarray(sums[:, :, own]) for l, own in by_label.items()}
        best = Best(len(ids), k, np.full(len(ids), np.iinfo("i8").min))
        rows = max(64, min(4096, SCORES // max(1, max(map(len, by_label.values())))))
        for vec_id, label, own in blocks_of_rows(batches, planes, groups, rows):
            for l in np.unique(label).tolist():
                if l not in by_label:
                    continue
                here, slots = label == l, by_label[l]
                s = scores(sums[l], own[here], kind)
                row, col = np.nonzero((s >= best.low[slots]) & (vec_id[here][:, None] != ids[slots]))
                best.add(slots[col], s[row, col].astype("i8"), vec_id[here][row])
        yield pd.DataFrame({"slot": best.slot, "id": best.id, "score": best.score})

    return run


def negatives_in(shared, planes: int, groups: int, k: int, kind: str):
    """Per task: for each anchor's positives the best ``k`` rows of other labels in the positive's range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, vectors, anchor, low, high = shared.value
        sums = subset_sums(vectors)
        best = Best(len(anchor), k, low)
        rows = max(64, min(4096, SCORES // max(1, len(labels))))
        # the n-th positives of all anchors together: one look at the scores each
        starts = np.concatenate(([True], anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, bool)
        nth = np.arange(len(anchor)) - np.maximum.accumulate(np.where(starts, np.arange(len(anchor)), 0))
        for vec_id, label, own in blocks_of_rows(batches, planes, groups, rows):
            s = scores(sums, own, kind)
            other = label[:, None] != labels
            for n in np.unique(nth):
                slots = np.flatnonzero(nth == n)
                cols = anchor[slots]
                mine = s[:, cols]
                row, col = np.nonzero((mine >= best.low[slots]) & (mine <= high[slots]) & other[:, cols])
                best.add(slots[col], mine[row, col].astype("i8"), vec_id[row])
        yield pd.DataFrame({"slot": best.slot, "id": best.id, "score": best.score})

    return run


def best_over_tasks(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pack(dims: int, planes: int, scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            values = np.stack([integers(v, dims, scale) for v in frame["vector"]]) if len(frame) else np.zeros((0, dims), "i8")
            own = planes_of(values, planes)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "planes": [p.tobytes() for p in own],
                                "anchor": frame["anchor"]})

    return run


def unpacked(rows: list[bytes], planes: int, groups: int) -> np.ndarray:
    """The integers ``(rows, groups * 8)`` that ``planes_of`` packed."""
    own = np.frombuffer(b"".join(rows), "u1").reshape(len(rows), planes, groups)
    bits = np.unpackbits(own[..., None], axis=3, bitorder="little").reshape(len(rows), planes, groups * GROUP).astype("i8")
    weight = np.left_shift(np.int64(1), np.arange(planes, dtype="i8"))
    weight[-1] = -weight[-1]
    return (bits * weight[None, :, None]).sum(axis=1)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                   table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label``: a column of ``vectors``; ``is_anchor``: which rows are anchors.  A
    negative's score lies from ``low`` to ``high`` percent of its positive's.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "hard-negatives")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                            F.col(vector_col).cast("array<double>").alias("vector"),
                            F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    usable = usable.filter("vec_id is not null and label is not null and vector is not null").filter(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = usable.agg(F.max(F.size("vector")), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if most[0] is None:
        return spark.createDataFrame([], schema)
    dims, largest, least = max(1, most[0]), math.floor((most[1] or 0) * scale), math.floor((most[2] or 0) * scale)
    top = max(largest, -least - 1, 0)
    if dims * (top + 1) ** 2 > 1 << 62:
        raise ArithmeticError("inner products of these vectors do not fit 64 bits")
    planes, groups = top.bit_length() + 1, -(-dims // GROUP)
    kind = "i4" if dims * (top + 1) ** 2 < 1 << 30 else "i8"

    packed = usable.mapInPandas(pack(dims, planes, scale), "vec_id long, label long, planes binary, anchor boolean")
    # equal rows count once; the shuffle also deals the rows evenly for the scoring
    rows = scratch.write(packed.groupBy("vec_id", "label", "planes").agg(F.max("anchor").alias("anchor")), "packed")
    anchors = scratch.write(rows.filter("anchor").select("vec_id", "label", "planes"), "anchors")
    rows = rows.select("vec_id", "label", "planes")
    block = max(1, table_bytes // (groups * (1 << GROUP) * (4 if GROUP * (top + 1) < 1 << 31 else 8)))
    names, done, after, n = ("vec_id", "label", "planes"), [], None, 0
    while True:
        # the next anchors by id, at most a block
        own = anchors if after is None else anchors.filter(F.struct(*names) > F.struct(*(F.lit(v).alias(c) for c, v in zip(names, after))))
        own = own.orderBy(*names).limit(block).collect()
        if not own:
            break
        after = (own[-1]["vec_id"], own[-1]["label"], bytes(own[-1]["planes"]))
        ids, labels = np.array([r["vec_id"] for r in own], "i8"), np.array([r["label"] for r in own], "i8")
        values = unpacked([bytes(r["planes"]) for r in own], planes, groups)
        first = spark.sparkContext.broadcast((ids, labels, values))
        near = best_over_tasks(rows.mapInPandas(positives_in(first, planes, groups, positives, kind), "slot long, id long, score long"), positives)
        # at most `positives` rows for each anchor of the block
        found = sorted((r["slot"], r["rank"], r["id"], r["score"]) for r in near.collect())
        first.unpersist()
        if found:
            slot, _, positive, score = (np.array(c, "i8") for c in zip(*found))
            # the least and largest scores in range; none where the positive's is negative
            least = np.array([-(-low * s // 100) for s in score.tolist()], "i8")
            largest = np.array([high * s // 100 for s in score.tolist()], "i8")
            second = spark.sparkContext.broadcast((labels, values, slot, least, largest))
            far = best_over_tasks(rows.mapInPandas(negatives_in(second, planes, groups, negatives, kind), "slot long, id long, score long"), negatives)
            named = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": positive,
                                                        "positive_score": score}))
            far = far.join(F.broadcast(named), "slot")
            done.append(scratch.write(far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                                 F.col("score").alias("negative_score")), f"block-{n}"))
            second.unpersist()
        n += 1
        if len(own) < block:
            break
    out = spark.createDataFrame([], schema)
    for part in done:
        out = out.unionAll(part)
    return scratch.keep(out)
