r"""Collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle, one shard a step.
All lengths are counted in the same scans, each phrase over one full cycle from
the step in which it is activated, and the scans end when no phrase is under way.

A phrase that occurs ``threshold`` times has, in one of the ``shards`` shards, its
*share* of them, ceil(threshold / shards).  So a phrase counts as having got there
after the first shard that holds its share, which is no later than its count so
far reaches the threshold, and no sums over steps have to be kept.

* Words are counted from the first step on.
* A longer phrase is activated after the step in which the later of its two
  subphrases (without its last word, without its first) got there.
* Longer phrases, most of which are rare, are first *tallied* by a 64-bit hash, and are
  spelled out and counted from the step after their own tally reached the share.  Phrases
  that share a hash get there together, which costs time only: what is counted goes by
  the phrase itself.

A phrase below the threshold makes every longer one infrequent, so what is never
activated is no candidate, and what completes its cycle has its exact count.

Texts are taken apart once, into slices of bounded size: a slice's different words, and
the words' numbers in order.  Each step is one Spark job.  Workers sum a slice up and hand
its hashes and counts on as arrays, in order, a row for each *block* of hashes and not for
each phrase; a task adds up a block of one length, and blocks grow in number with the corpus.

What workers know of the phrases that got there is a table of slots a length, a bit each; a
phrase has two slots, and goes by the later.  With the table that the shard's last step went
by, that tells which phrases' cycles are under way.  Tables grow with the corpus, to
``2 ** slot_bits`` slots.  A full one makes workers tally or count phrases that need it not,
from a step that is too early but over a full cycle all the same, so it costs time and
never changes a result.

Defined cases: null and empty texts have no words; a null ``lang`` is ``und``;
repeated rows count each time; equal scores are ordered by count, then by
the phrase's UTF-8 bytes; extra columns are ignored; texts of any length are
counted whole, slice by slice; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workpanel.llm.common import Scratch
from workpanel.llm.ngram_join import mix

#: Slots of the largest table of phrases that got there: a bit each, 32 MB.
SLOT_BITS = 28
SLOTS_A_BLOCK = 1 << 18
#: Words of the corpus for each slot of a length's table, 16 for lengths that are not named.
WORDS_A_SLOT = {1: 64, 2: 8}
#: Words of the corpus for each block of hashes that a task adds up, and the most such blocks.
WORDS_A_BLOCK = 1 << 23
MOST_BLOCKS = 4096
#: Bytes of text that a worker counts at a time.
SLICE = 6_000_000
NEVER = 255
U = np.uint64

#: The end of a piece, a byte that no text in UTF-8 has.
BREAK = b"\xff"
#: A-Z in lower case; what ends a piece becomes ``BREAK``, a tab a blank.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0B\x0C\x0D\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")


def odd_numbers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="u8")) | U(1)


def lang_seed(lang: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(lang.encode())


def tokens_of(plain: bytes) -> list[bytes]:
    """Words and piece ends of a text whose characters are mapped."""
    return plain.replace(BREAK, b" \xff ").split()  # blanks are all the white space that is left


def slices(texts: Iterator[tuple[str, str | None]]) -> Iterator[tuple[str, list[bytes], int]]:
    """``lang, tokens, seen``: tokens to count, of which the first ``seen`` were counted before.

    Short texts of a language are put together, with a piece end between them; a
    text longer than a slice comes in parts that overlap by as many words as a
    phrase can reach back.
    """
    held: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, text in texts:
        if not text:
            continue
        plain = text.encode("utf-8", "surrogatepass").translate(PLAIN)
        if len(plain) > SLICE:
            before: list[bytes] = []
            at = 0
            while at < len(plain):
                end = plain.find(b" ", at + SLICE)
                part = tokens_of(plain[at:end if end >= 0 else len(plain)])
                yield lang, before + part, len(before)
                before = (before + part)[-15:]
                at = end if end >= 0 else len(plain)
            continue
        tokens, size = held.setdefault(lang, ([], [0]))
        tokens += tokens_of(plain)
        tokens.append(BREAK)
        size[0] += len(plain)
        if sum(s[0] for _, s in held.values()) > SLICE:
            for name, (full, _) in held.items():
                yield name, full, 0
            held.clear()
    for name, (full, _) in held.items():
        yield name, full, 0


class Numbers(dict):
    """Each new word gets the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def coded(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words of a slice, the piece end first, and each token's number among them."""
    number = Numbers({BREAK: 0})
    ids = np.fromiter(map(number.__getitem__, tokens), "i4", len(tokens))
    return list(number), ids


def slots_of(key: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's two slots in a table of ``slots``, both in the block of its hash's highest bits."""
    bits = max(0, slots.bit_length() - SLOTS_A_BLOCK.bit_length())
    mask, block = U((slots >> bits) - 1), U(0)
    if bits:
        block = (key >> U(64 - bits)) << U(slots.bit_length() - 1 - bits)
    return block | (key & mask), block | ((key >> U(32)) & mask)


def bits_of(key: np.ndarray, slots: int, block: int, blocks: int) -> tuple[int, bytes]:
    """The first slot that hashes of ``block`` can have in a table of ``slots``, and from there
    on a bit a slot for those that these hashes have."""
    wide = max(slots // blocks, min(slots, SLOTS_A_BLOCK))
    begin = block * slots // blocks // wide * wide
    on = np.zeros(wide, "u1")
    for slot in slots_of(key, slots):
        on[slot - U(begin)] = 1
    return begin, np.packbits(on, bitorder="little").tobytes()


class Table:
    """A length's table of slots as ``step`` needs it: when a phrase of a slot got there, which
    is NEVER, a step so old that its cycle is over, or one whose cycle is under way.

    ``got``, ``old``: a bit a slot; there before ``step``, and before this shard's last step.
    """

    def __init__(self, slots: int, got: np.ndarray, old: np.ndarray | None, step: int, shards: int):
        self.slots, self.got, self.old, self.step, self.shards = slots, got, old, step, shards

    def __len__(self) -> int:
        return self.slots

    def __getitem__(self, slot: np.ndarray) -> np.ndarray:
        byte, bit = (slot >> U(3)).view("i8"), np.left_shift(1, slot & U(7), dtype="u1", casting="unsafe")
        out = np.where(self.got[byte] & bit, np.int16(self.step - 1), np.int16(NEVER))
        if self.old is not None:
            out[(self.old[byte] & bit) != 0] = self.step - self.shards - 1
        return out


def tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and how often each is there."""
    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.diff(np.append(at, len(key)))


def counted(key: np.ndarray, ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, positions and counts of the phrases that begin ``at``, told apart by their words.
    (One whose hash another phrase shares may come in parts.)"""
    order = np.argsort(key)
    key, at = key[order], at[order]
    other = key[1:] != key[:-1]
    for k in range(size):
        word = ids[at + k]
        other |= word[1:] != word[:-1]
    first = np.flatnonzero(np.append(True, other))
    return key[first], at[first], np.diff(np.append(first, len(at)))


def looked_in(words: list[bytes], ids: np.ndarray, seen: int, seed: int, step: int, shards: int, sizes: int,
              first) -> Iterator[tuple[int, list[bytes] | None, np.ndarray, np.ndarray]]:
    """``size, phrases, hashes, counts`` that ``step`` has to count in a slice, and
    ``size, None, hashes, counts`` of those that it has to tally; hashes in order.

    ``first[k - 1][slot]``: for each slot the first step in which a phrase of k words got
    there; of the lengths that have a table, those from 2 on are tallied.
    """
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter((xxh3_64_intdigest(w, seed) for w in words), "u8", len(words))
    odd = odd_numbers(sizes)

    def there(size, key, low):
        a, b = slots_of(key, len(first[size - 1]))
        found = np.maximum(first[size - 1][a], first[size - 1][b]).astype("i2")
        # a slot may be older than the phrase's own parts
        return np.where(found != NEVER, np.maximum(found, low), np.int16(NEVER))

    if step < shards:  # words are active from the start
        n = np.bincount(ids[seen:], minlength=len(words))
        n[0] = 0
        at = np.flatnonzero(n)
        key = mix(hashes[at] * odd[0])
        order = np.argsort(key)
        if len(at):
            yield 1, [words[k] for k in at[order].tolist()], key[order], n[at[order]]
    if sizes == 1:
        return
    by_word = there(1, mix(hashes * odd[0]), np.int16(-1))
    by_word[0] = NEVER
    when = by_word[ids]
    at = np.flatnonzero(when != NEVER)
    when, rolled = when[at], (hashes * odd[0])[ids[at]]
    for size in range(2, sizes + 1):
        # both subphrases got there; active from the later step on
        both = np.flatnonzero((at[1:] == at[:-1] + 1) & (when[1:] != NEVER) & (when[:-1] != NEVER))
        if not len(both):
            return
        at, low = at[both], np.maximum(when[both], when[both + 1])
        rolled = rolled[both] + (hashes * odd[size - 1])[ids[at + (size - 1)]]
        key, begin = mix(rolled), low
        if size <= len(first):
            begin = when = there(size, key, low)
            due = np.flatnonzero((when == NEVER) & (low < step) & (step <= low + shards) & (at + size > seen))
            if len(due):
                yield size, None, *tally(key[due])
        now = np.flatnonzero((begin < step) & (step <= begin + shards) & (at + size > seen))
        if len(now):
            hashed, where, n = counted(key[now], ids, at[now], size)
            parts = ([words[w] for w in ids[where + k].tolist()] for k in range(size))
            yield size, [b" ".join(p) for p in zip(*parts)], hashed, n
        if size > len(first):
            return


def looked_at(tokens: list[bytes], seen: int, seed: int, step: int, shards: int, sizes: int, first) -> Iterator:
    """``looked_in`` for tokens as they are."""
    words, ids = coded(tokens)
    return looked_in(words, ids, seen, seed, step, shards, sizes, first)


#: Columns by name: a slice, with its different words, joined by blanks, each token's number among them and the number of its new words.
SLICES = {"shard": "int", "lang": "string", "seen": "int", "words": "binary", "ids": "binary", "n": "long"}
#: Hashes (u8) of a block in order, their counts (i8) and, unless they are tallied, their phrases, joined by line ends.
FOUND = {"size": "int", "block": "int", "lang": "string", "h": "binary", "n": "binary", "phrases": "binary"}
#: The same, added up, or ``bits`` for the slots from ``slot`` on whose phrases got there.
ADDED = FOUND | {"slot": "long", "bits": "binary"}
COUNTS = {"lang": "string", "size": "int", "phrase": "string", "f": "long"}


def as_ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def batch_of(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.record_batch([pa.array([row[k] for row in rows], kinds[kind]) for k, kind in enumerate(columns.values())], list(columns))


def dealer(shards: int):
    """Texts to slices, each language's in turn to the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), {}
        texts = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for lang, tokens, seen in slices(texts):
            shard = turn[lang] = turn.get(lang, part + len(turn)) + 1
            words, ids = coded(tokens)
            yield batch_of(SLICES, [(shard % shards, lang, seen, b" ".join(words[1:]), ids.tobytes(), np.count_nonzero(ids[seen:]))])

    return run


def counter(step: int, shards: int, sizes: int, blocks: int, slots: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [Table(m, got, old, step, shards) for m, (got, old) in zip(slots, shared.value)]
        for batch in batches:
            for k in range(batch.num_rows):
                lang, seen, words = (batch.column(name)[k].as_py() for name in ("lang", "seen", "words"))
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "i4")
                for size, phrases, h, n in looked_in([BREAK, *words.split()], ids, seen, lang_seed(lang), step, shards, sizes, first):
                    block, cuts = np.unique(h >> U(65 - blocks.bit_length()), return_index=True)
                    n, ends = n.astype("i8"), [*cuts.tolist(), len(h)]
                    yield batch_of(FOUND, [(size, at, lang, h[a:b].tobytes(), n[a:b].tobytes(), None if phrases is None else b"\n".join(phrases[a:b]))
                                           for at, a, b in zip(block.tolist(), ends, ends[1:])])

    return run


def numbers(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def added(part: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """``lang, hashes, counts, phrases`` of a block's rows, each phrase once."""
    by_lang: dict[str, list[tuple]] = {}
    for lang, *row in zip(*(part.column(name).to_pylist() for name in ("lang", "h", "n", "phrases"))):
        by_lang.setdefault(lang, []).append(row)
    for lang, rows in by_lang.items():
        h, n = numbers([row[0] for row in rows], "u8"), numbers([row[1] for row in rows], "i8")
        phrases = np.array([p for row in rows for p in row[2].split(b"\n")], dtype=object)
        order = np.argsort(h)
        h, n, phrases = h[order], n[order], phrases[order]
        other = phrases[1:] != phrases[:-1]
        if (other & (h[1:] == h[:-1])).any():  # phrases that share a hash: side by side by what they are
            order = np.array(sorted(range(len(h)), key=lambda k: (h[k], phrases[k])))
            h, n, phrases = h[order], n[order], phrases[order]
            other = phrases[1:] != phrases[:-1]
        first = np.flatnonzero(np.append(True, other))
        yield lang, h[first], np.add.reduceat(n, first), phrases[first]


def adder(share: int, slots: list[int], blocks: int):
    """Adds a block's rows of one length up, spelled or tallied."""
    def run(key: tuple, part: pa.Table) -> pa.Table:
        size, block, spelled = (k.as_py() for k in key)
        out, there = [], []
        if spelled:
            for lang, h, n, phrases in added(part):
                out.append((size, block, lang, h.tobytes(), n.tobytes(), b"\n".join(phrases), None, None))
                there.append(h[n >= share])
        else:
            h, n = (numbers(part.column(name).to_pylist(), kind) for name, kind in (("h", "u8"), ("n", "i8")))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            there.append(h[first][np.add.reduceat(n, first) >= share])
        there = np.concatenate(there)
        if len(there) and size <= len(slots) and (size == 1 or not spelled):
            out.append((size, block, None, None, None, None, *bits_of(there, slots[size - 1], block, blocks)))
        return pa.Table.from_batches([batch_of(ADDED, out)])

    return run


def frequent(threshold: int):
    """The phrases of a block's rows that are found ``threshold`` times or more."""
    def run(key: tuple, part: pa.Table) -> pa.Table:
        size = key[0].as_py()
        return pa.Table.from_batches([batch_of(COUNTS, [
            (lang, size, p.decode("utf-8", "replace"), f) for lang, _, n, phrases in added(part)
            for p, f in zip(phrases[n >= threshold], n[n >= threshold].tolist())])])

    return run


def power_of_two(n: int) -> int:
    """The least that is not below ``n``."""
    return 1 << max(0, n - 1).bit_length()


def table_sizes(n_words: int, max_words: int, slot_bits: int) -> list[int]:
    """Slots of each length's table: with the corpus, up to a fixed size."""
    sizes = (power_of_two(n_words // WORDS_A_SLOT.get(k, 16)) for k in range(1, max_words + 1))
    return [max(SLOTS_A_BLOCK, min(m, 1 << slot_bits)) for m in sizes]


def phrase_counts(docs: DataFrame, scratch: Scratch, max_words: int = 3, threshold: int = 10, shards: int = 4,
                  lang_col: str = "lang", text_col: str = "text", slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all phrases of up to ``max_words`` words found
    ``threshold`` times or more, and ``lang, n``, each language's words."""
    if not 1 <= max_words <= 15 or (max_words + 2) * shards >= NEVER or slot_bits > 31:
        raise ValueError("max_words from 1 to 15, fewer than 255 steps in all, and at most 2^31 slots")
    spark, share = docs.sparkSession, -(-threshold // shards)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    # any even deal will do; written once, so that every step sees the same one, as words and numbers
    rows = scratch.write(rows.filter("text <> ''").mapInArrow(dealer(shards), as_ddl(SLICES)), "shards", by="shard")
    n_words = rows.agg(F.sum("n")).first()[0] or 0
    slots = table_sizes(n_words, max_words, slot_bits) if max_words > 1 else []
    blocks = min(MOST_BLOCKS, power_of_two(max(8, n_words // WORDS_A_BLOCK)))
    got, old = ([np.zeros(-(-m // 8), "u1") for m in slots] for _ in range(2))
    steps, step, until = [], 0, shards - 1

    def there(found: DataFrame, tables: list[np.ndarray]) -> bool:
        """Set what got there in a step; whether that changes a table."""
        new = False
        # a bit a slot comes to the driver, however many phrases there are
        for size, slot, bits in found.filter("bits is not null").select("size", "slot", "bits").collect():
            part, bits = tables[size - 1][slot // 8:slot // 8 + len(bits)], np.frombuffer(bits, "u1")
            if (bits & ~part).any():
                part |= bits
                new = True
        return new

    while step <= until:
        if step > shards:  # read again: tables kept in the cluster for a cycle took more memory
            there(steps[step - shards - 1], old)
        shared = spark.sparkContext.broadcast([(a, b if step > shards else None) for a, b in zip(got, old)])
        found = (rows.filter(F.col("shard") == step % shards).select("lang", "seen", "words", "ids")
                 .mapInArrow(counter(step, shards, max_words, blocks, slots, shared), as_ddl(FOUND))
                 .groupBy("size", "block", F.col("phrases").isNotNull().alias("spelled"))
                 .applyInArrow(adder(share, slots, blocks), as_ddl(ADDED)))
        steps.append(scratch.write(found, f"step-{step}"))
        shared.destroy()
        if there(steps[step], got):
            until = step + shards
        step += 1
    every = steps[0]
    for more in steps[1:]:
        every = every.unionAll(more)
    counts = (every.filter("phrases is not null").select("size", "block", "lang", "h", "n", "phrases").groupBy("size", "block")
              .applyInArrow(frequent(threshold), as_ddl(COUNTS)))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")
    return scratch.write(counts, "counts"), scratch.write(sizes, "words")


def collocations(docs: DataFrame, max_words: int = 3, threshold: int = 10, top: int = 2000, shards: int = 4,
                 percent: int = 50, lang_col: str = "lang", text_col: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by
    the weakest of their cuts, floor(10^6 a^2 / (l r)); phrases of which a
    longer candidate makes up ``percent`` or more are left out."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts, sizes = phrase_counts(docs, scratch, max_words, threshold, shards, lang_col, text_col, slot_bits)
    part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    candidates = (counts.filter("size >= 2")
                  .select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")))
    cut = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
           .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"),
                   part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail")))
    f = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cut = (cut.join(f.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
           .join(f.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"]))
    big = lambda c: F.col(c).cast("decimal(15,0)")
    product = (big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    cut = cut.withColumn("share", product).withColumn("most", (big("l") * big("r")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("share div most"))
    scored = (cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
              .select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"))
    # what lies inside a longer candidate
    inner = (candidates.filter("size >= 3")
             .withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
             .select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (scored.join(inner, ["lang", "phrase"], "left")
            .filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer"))
    # a language's phrases are ranked in parts first, so that no task holds them all
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = Window.partitionBy("lang", "bucket").orderBy(*best)
    ranked = (left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
              .withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top).drop("bucket"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return scratch.keep(ranked.join(sizes, "lang")
                        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
