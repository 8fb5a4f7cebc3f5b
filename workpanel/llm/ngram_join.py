r"""Exact Jaccard self-join of word n-gram sets, by universe partitioning.

Two sets of sizes r and s reach the threshold only if their symmetric
difference is at most H, which the sizes give.  Hash the universe of n-grams
into m segments by size band: fewer than H / 2 + 1 segments hold two differing n-grams or
more, so of any floor(H / 2) + 1 segments one is equal in both sets up to one n-gram.  Keys
that such a segment has in common with its like are indexed:

* small sets: the segment, and its *one-deletion neighbourhood*, the segment without
  each of its n-grams;
* larger sets: the *subsets* of its ``PARTS`` parts that leave one part out, one of which
  does without the differing n-gram.

1. Sets are grouped by a 64-bit hash of their n-grams: copies are one *class*
   from here on (the odds of two different sets meeting are below n^2 / 2^65).
2. Every class emits its segments' keys for the size band it lies in and for
   the bands whose sets it can link with as the smaller one.
3. *Cost-based allocation*: a class has more segments than the bound needs, and
   keys that nobody else has cost nothing.  A class with enough segments of its
   own links with nothing and leaves the index.
4. Each key's most connected member is its *hub*, and is compared with the key's others;
   links give first components.  Two linked classes have a key in common, hence a hub.
5. What is left are pairs of a hub's star in different components, of which there may be
   many that nearly link.  They are found by what tells them apart (``across``): of each
   class only its *differences* from the star's consensus are kept, and classes that are
   not near the consensus can link only if they share a number of differences.  A class
   looks up its rarest ones, so texts that differ in ways of their own meet nobody.

All pairs are checked on the n-gram sets themselves, after a parity sketch that never
loses a pair.  A set with too few usable segments (*weak*) cannot rely on the bound: it
has the keys of all its segments, where stronger sets look, and weak sets meet each other
on single n-grams.  No group is capped or sampled.

Defined cases: null, empty and blank texts have the empty set, size 0, and
link with nothing; texts with fewer words than n have one n-gram, the whole
sequence; repeated rows and ids give one result row each; rows of different
texts under one id each go by their own text, and so do rows without an id
(a component of such rows only is named null); extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workpanel.llm.common import Scratch, components, shuffled

#: Sets up to this size use one-deletion neighbourhoods: as many keys as n-grams, but longer ones.
SMALL = 64
#: Parts of a segment of larger sets; a key leaves one out.
PARTS = 3
SCHEMES = 110  # size bands, enough for 2^24 n-grams; single n-grams of weak sets use SCHEMES + band
PARITY = ("p0", "p1", "p2", "p3")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the usual shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and each band's largest symmetric difference of linked sets.

    2 * shared >= 2 * percent / (100 + percent) * (r + s) bounds the difference
    by (100 - percent) / (100 + percent) of both sizes together.
    """
    lows, most, lo = [], [], 1
    while len(lows) < SCHEMES:
        hi = max(lo, lo * 100 // percent)
        lows.append(lo)
        most.append((100 - percent) * 2 * hi // (100 + percent))
        lo = hi + 1
    return np.array(lows, "int64"), np.array(most, "int64")


def shingle_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, each text's sorted and distinct, one after another; and each text's number."""
    from xxhash import xxh3_64_intdigest

    # bytes.lower and bytes.split know A-Z and the six ASCII blanks only
    split = [t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts]
    sizes = np.array([len(w) for w in split], "int64")
    total = int(sizes.sum())
    h = np.fromiter((xxh3_64_intdigest(w) for own in split for w in own), "u8", total)
    odd = mix(np.arange(1, n + 1, dtype="u8")) | U(1)
    grams = np.zeros(max(0, total - n + 1), "u8")
    for k in range(n):
        grams += h[k:k + len(grams)] * odd[k]
    grams = mix(grams)
    ends = np.cumsum(sizes)
    parts, counts = [], np.zeros(len(split), "int64")
    for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        if size >= n:
            own = np.sort(grams[end - size:end - n + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif size:
            own = mix((h[end - size:end] * odd[:size]).sum(dtype="u8", keepdims=True) + U(size))
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, "u8")), counts


def class_ids(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    ends = np.cumsum(counts).tolist()
    return np.array([xxh3_64_intdigest(flat[e - c:e].tobytes()) if c else 0 for e, c in zip(ends, counts.tolist())],
                    "u8").view("int64")


def parities(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """256 bits for each set: two sets differ in at least as many n-grams as bits."""
    cell = np.repeat(np.arange(len(counts)), counts) * 256 + (flat & U(255)).astype("int64")
    bits = (np.bincount(cell, minlength=256 * len(counts)) & 1).astype("u1")
    return np.packbits(bits.reshape(-1, 256), axis=1).view("int64").reshape(-1, 4)


def by_parts(batches: Iterator[pd.DataFrame], rows: int = 400) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]


def sets_of(n: int, id_col: str, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_parts(batches):
            flat, counts = shingle_sets(part[text_col].tolist(), n)
            out = pd.DataFrame({"doc_id": part[id_col].to_numpy(), "n_shingles": counts, "cls": class_ids(flat, counts),
                                "mark": part["mark"].to_numpy()})
            for name, column in zip(PARITY, parities(flat, counts).T):
                out[name] = column
            yield out

    return run


def keys_of(n: int, percent: int, text_col: str):
    """Rows ``key, cls, part``; ``part`` packs the scheme (from bit 52), 1 + the
    segments beyond those needed, or 0 for a weak set (from bit 26), the segment
    (from bit 1), and whether the bound may count on it (bit 0)."""
    lows, most = bands(percent)

    def scheme_keys(scheme: int, x: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        h = int(most[scheme])
        small = lows[scheme] <= SMALL
        need = h // 2 + 1
        m = need + 1 if small else need + need // 6 + 1
        doc = np.repeat(np.arange(len(counts)), counts)
        spread = mix(x + U(scheme))
        seg = ((spread >> U(20)) % U(m)).astype("int64")
        cell = doc * m + seg
        size = np.bincount(cell, minlength=m * len(counts))
        value = mix(x ^ U(0x9E3779B97F4A7C15))
        total = np.zeros(m * len(counts), "u8")
        np.add.at(total, cell, value)
        salt = np.tile(mix(np.arange(m, dtype="u8") + U((scheme + 1) << 32)), len(counts))
        if not small:
            piece = cell * PARTS + ((spread & U(0xFFFF)) % U(PARTS)).astype("int64")
            in_piece = np.bincount(piece, minlength=PARTS * m * len(counts)).reshape(-1, PARTS)
            of_piece = np.zeros(PARTS * m * len(counts), "u8")
            np.add.at(of_piece, piece, value)
            rest, n_rest = total[:, None] - of_piece.reshape(-1, PARTS), size[:, None] - in_piece
        # whatever differs, something is left to make a key of
        usable = size >= 2 if small else (in_piece > 0).sum(axis=1) >= 2
        strong = usable.reshape(-1, m).sum(axis=1)
        spare = np.maximum(strong - need, -1) + 1

        def part(cells: np.ndarray) -> np.ndarray:
            return (scheme << 52) | (spare[cells // m] << 26) | ((cells % m) << 1) | usable[cells]

        if small:
            at = np.flatnonzero(size)
            yield mix(total[at] + salt[at]), ids[at // m], part(at)
            near = usable[cell]
            c = cell[near]
            yield mix(total[c] - value[near] + salt[c]), ids[c // m], part(c)
        else:
            at, out = np.nonzero(n_rest)
            yield mix(rest[at, out] + salt[at] * U(2) + out.astype("u8")), ids[at // m], part(at)
        for i in np.flatnonzero(spare == 0):
            own = value[doc == i]
            k = np.arange(len(own))
            yield (mix(own + mix(np.array([scheme + SCHEMES], "u8"))), np.repeat(ids[i], len(own)),
                   ((scheme + SCHEMES) << 52) | (max(0, len(own) - h) << 26) | (k << 1) | 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for rows in by_parts(batches):
            flat, counts = shingle_sets(rows[text_col].tolist(), n)
            ids = class_ids(flat, counts)
            first = np.array([c > 0 and not (i in seen or seen.add(i)) for i, c in zip(ids.tolist(), counts.tolist())], bool)
            own = np.searchsorted(lows, counts, "right") - 1
            last = np.searchsorted(lows, counts * 100 // percent, "right") - 1
            member = np.repeat(np.arange(len(counts)), counts)
            for scheme in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(own[first], last[first])])) if first.any() else []:
                if most[scheme] == 0:
                    continue  # only equal sets link
                here = first & (own <= scheme) & (scheme <= last)
                for key, cls, part in scheme_keys(int(scheme), flat[here[member]], counts[here], ids[here]):
                    yield pd.DataFrame({"key": key.view("int64"), "cls": cls, "part": part})

    return run


def sets_for(n: int, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_parts(batches):
            flat, counts = shingle_sets(part[text_col].tolist(), n)
            own = np.split(flat.view("int64"), np.cumsum(counts)[:-1])
            yield pd.DataFrame({"cls": part["cls"].to_numpy(), "grams": own})

    return run


# what ``part`` packs
SCHEME, SPARE, STRONG = "shiftright(part, 52)", "(shiftright(part, 26) & 67108863) - 1", "part & 1 = 1"


def shared(keys: DataFrame) -> DataFrame:
    """The rows whose key more than one class has, with ``df``, its number of rows."""
    same = Window.partitionBy("key")
    return (keys.withColumn("df", F.count(F.lit(1)).over(same))
            .withColumn("_lo", F.min("cls").over(same)).withColumn("_hi", F.max("cls").over(same))
            .filter("_lo < _hi").drop("_lo", "_hi"))


def thinned(keys: DataFrame) -> DataFrame:
    """Without classes that have, in a scheme, as many unshared segments as the
    bound needs: they link with nothing there."""
    touched = (keys.groupBy("cls", F.expr(SCHEME).alias("scheme"), F.expr(SPARE).alias("spare"))
               .agg(F.count_distinct(F.when(F.expr(STRONG), F.col("part"))).alias("touched")))
    left = touched.filter("spare < 0 or touched > spare").select("cls", "scheme")
    return keys.withColumn("scheme", F.expr(SCHEME)).join(left, ["cls", "scheme"], "left_semi").drop("scheme")


def row_mark(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(id_col, F.lit(0), text_col)


def can_link(percent: int, a: str, b: str) -> Column:
    """What sizes and parities allow; never false for a linked pair."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    small, large = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    bits = sum((F.bit_count(x(p).bitwiseXOR(y(p))) for p in PARITY), F.lit(0))
    return (100 * small >= percent * large) & ((100 + percent) * bits <= (100 - percent) * (small + large))


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the threshold."""
    left = pairs.join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    shared_n = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared_n
    return both.filter(100 * shared_n >= percent * union).select("a", "b")


def differing(x: str, y: str) -> Column:
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def across(stars: DataFrame, place: DataFrame, grams: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` of classes of one star (``hub, cls``, the hub among them) and of
    different components (``place``: ``cls, n, comp``) that may link, every one that does among them.

    Of a class x let D(x) be its differences from the star's consensus, the n-grams that
    most of the star has, and let its *distance* be s(x) = |D(x)| - r |x|, where two sets a, b link
    if and only if |D(a) ^ D(b)| <= r (|a| + |b|), r = (100 - percent) / (100 + percent).
    If s(a) + s(b) <= 0 they do link, and so does each with the star's nearest class.
    Otherwise they share at least (s(a) + s(b)) / 2 differences: if s(b) >= s(a), at least
    max(1, s(a)), so one of the ``|D(a)| - max(1, s(a)) + 1`` rarest of a is one of b's.
    Differences that only one component has are never shared, and are not looked up.
    """
    own = stars.join(place.select("cls", "n", "comp"), "cls")
    open_ = (own.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("members >= 3 and lo < hi").select("hub", "members"))  # a pair has been compared
    own = scratch.write(own.join(scratch.write(open_, "open-hubs"), "hub"), "open")
    x = grams.withColumnRenamed("grams", "x")
    hubs = grams.withColumnsRenamed({"cls": "hub", "grams": "center"})
    first = own.select("hub", "cls", "members").join(x, "cls").join(hubs, "hub")
    flips = (first.select("hub", "members", F.explode(differing("x", "center")).alias("e")).groupBy("hub", "members", "e").count()
             .filter("2 * count > members").groupBy("hub").agg(F.collect_list("e").alias("flips")))  # at most twice a set's n-grams
    centers = own.select("hub").distinct().join(hubs, "hub").join(flips, "hub", "left")
    centers = scratch.write(centers.select("hub", F.when(F.col("flips").isNull(), F.col("center"))
                                           .otherwise(differing("center", "flips")).alias("center")), "centers")
    # s in units of 1 / (100 + percent)
    near = scratch.write(own.join(x, "cls").join(centers, "hub").withColumn("d", differing("x", "center"))
                         .withColumn("s", (100 + percent) * F.size("d").cast("long") - (100 - percent) * F.col("n"))
                         .select("hub", "cls", "comp", "s", "d"), "differences")
    nearest = scratch.write(near.groupBy("hub").agg(F.min(F.struct("s", "cls", "comp")).alias("m")), "nearest")
    sure = (near.select("hub", "cls", "comp", "s").join(nearest, "hub").filter("comp <> m.comp and s + m.s <= 0")
            .select(F.col("m.cls").alias("a"), F.col("cls").alias("b")))
    each = near.select("hub", "cls", "comp", "s", F.explode("d").alias("e"))
    met = (each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
           .filter("lo < hi").select("hub", "e", "c"))
    met = scratch.write(each.join(scratch.write(met, "met"), ["hub", "e"]), "shared-differences")
    least = F.greatest(F.lit(1), F.ceil(F.col("s") / (100 + percent)))
    of_class = Window.partitionBy("hub", "cls")
    met = (met.withColumn("k", F.row_number().over(of_class.orderBy("c", "e"))).withColumn("all", F.count(F.lit(1)).over(of_class)))
    i, j = met.filter(F.col("k") <= F.col("all") - least + 1).alias("i"), met.filter("s > 0").alias("j")
    # no pair shares more differences than either has in common with others
    enough = 2 * (100 + percent) * F.least("i.all", "j.all") >= F.col("i.s") + F.col("j.s")
    pairs = i.join(j, (F.col("i.hub") == F.col("j.hub")) & (F.col("i.e") == F.col("j.e")) & (F.col("i.comp") != F.col("j.comp"))
                   & (F.col("j.s") >= F.col("i.s")) & (F.col("i.s") + F.col("j.s") > 0) & enough)
    pairs = pairs.select(F.col("i.cls").alias("a"), F.col("j.cls").alias("b")).unionAll(sure)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, mark, group``: each document's set size, the
    smallest id it reaches by links of at least ``percent`` Jaccard similarity,
    the hash of its set (equal for documents with equal sets), the row's mark (a hash of
    its id and text), and a number that tells components apart, null for empty sets."""
    id_type = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "ngrams")
    # ids may repeat or be null; a row's mark is the hash of its id and text
    marked = docs.select(id_col, text_col, row_mark(id_col, text_col).alias("mark"))
    sets = scratch.write(marked.mapInPandas(
        sets_of(n, id_col, text_col), f"doc_id {id_type}, n_shingles long, cls long, mark long, " + ", ".join(f"{p} long" for p in PARITY)), "sets")
    classes = (sets.filter("n_shingles > 0").groupBy("cls")
               .agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), *[F.first(p).alias(p) for p in PARITY]))
    keys = docs.select(text_col).mapInPandas(keys_of(n, percent, text_col), "key long, cls long, part long").repartition("key")
    keys = scratch.write(shared(keys), "keys")
    keys = scratch.write(thinned(keys).distinct(), "index")  # copies from different tasks are one row from here on
    keys = scratch.write(thinned(shared(keys.drop("df"))), "index")  # what left no longer shares keys

    members = keys.select("cls").distinct()
    info = scratch.write(members.join(classes, "cls"), "classes")
    rows = marked.select("mark", text_col).join(shuffled(info.select("cls", "mark")), "mark")
    grams = scratch.write(rows.mapInPandas(sets_for(n, text_col), "cls long, grams array<long>").dropDuplicates(["cls"]), "grams")

    score = keys.groupBy("cls").agg(F.sum(F.log("df")).alias("score"))
    best = (keys.join(scratch.write(score, "scores"), "cls").groupBy("key").agg(F.max(F.struct("score", "cls")).alias("top"))
            .select("key", F.col("top.cls").alias("hub")))
    # per-key and per-group tables are written, so that a join with them can split a hot key
    stars = scratch.write(keys.join(scratch.write(best, "hubs"), "key").select("hub", "cls").distinct(), "stars")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = (pairs.join(info.alias("x"), F.col("a") == F.col("x.cls")).join(info.alias("y"), F.col("b") == F.col("y.cls"))
                 .filter(can_link(percent, "x", "y")).select("a", "b"))
        return scratch.write(verified(pairs, grams, percent), name)

    first = checked(stars.filter("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b")), "links")
    found = components(first, scratch, "first").withColumnRenamed("node", "cls")
    place = scratch.write(info.join(found, "cls", "left").select("cls", "n", F.coalesce("component", "cls").alias("comp")), "place")
    links = first.unionAll(checked(across(stars, place, grams, percent, scratch), "more-links"))

    named = components(links, scratch, "final").withColumnRenamed("node", "cls")
    lowest = scratch.write(classes.join(named, "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("group")), "groups")
    top = scratch.write(lowest.groupBy("group").agg(F.min("rep").alias("component_id")), "names")
    ends = lowest.join(top, "group").select("cls", "component_id", "group")
    return scratch.keep(sets.join(ends, "cls", "left")
                        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id"))
                                .otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_id"), "mark", "group"))
