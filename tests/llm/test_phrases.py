"""Collocations against a count of everything, and on odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from workpanel.llm import phrases
from workpanel.llm.common import Scratch
from workpanel.llm.phrases import collocations

R = random.Random(11)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_counting(rows, max_words=3, threshold=10, top=2000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) >= 2 and a >= threshold}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        found = []
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= percent * a:
                continue
            score, k = min((10 ** 6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def prose(words, n):
    return "".join(R.choice(words) + R.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", " "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    words = "The the OF of Ä ä new york city a b é́ x1 x2 x3".split()
    rare = [f"w{k}" for k in range(300)]
    out = [(R.choice(["en", "de", None]), prose(words + rare, R.randrange(0, 60))) for _ in range(120)]
    out += [("en", None), ("en", ""), (None, " \n\t "), ("en", "..!!"), ("fr", "one word " * 40), ("fr", "so so so so " * 9)]
    out += [("en", "new york city limits, ")] * 25  # copies count each time
    # late: reach the threshold in the last shard only, long after their words
    out += [("en", f"x1 late {k}") for k in range(12)]
    return out


SCHEMA = "lang string, text string, phrase int, shard int, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("shards,max_words", [(4, 3), (1, 3), (3, 4), (4, 2), (2, 1)])
def test_equals_counting(spark, rows, shards, max_words):
    df = collocations(frame(spark, rows), max_words=max_words, shards=shards)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(df) == by_counting(rows, max_words)


@pytest.mark.parametrize("bits", [1, 5])
def test_shared_slots_change_nothing(spark, rows, monkeypatch, bits):
    """Tables of 2 and of 32 slots: nearly every phrase shares one."""
    monkeypatch.setattr(phrases, "SLOTS_A_BLOCK", 2)
    assert got(collocations(frame(spark, rows), slot_bits=bits)) == by_counting(rows)


def test_top_and_ties(spark, rows):
    assert got(collocations(frame(spark, rows), top=5, threshold=3)) == by_counting(rows, threshold=3, top=5)


def test_longer_phrases_wait_for_their_parts():
    """Words, then a tally of pairs, then their count and longer phrases, each for one cycle."""
    tokens = phrases.tokens_of(b"a b c\xffa b")
    first = np.full((2, 1 << 18), phrases.NEVER, "u1")

    def sizes(step):
        out = list(phrases.looked_at(tokens, 0, 5, step, 4, 3, first))
        return [s for s, p, _, _ in out if p is not None], [s for s, p, _, _ in out if p is None]

    assert sizes(0) == ([1], []) and sizes(4) == ([], [])
    first[0] = 1  # all words got there in step 1
    assert [sizes(k) for k in (1, 2, 5, 6)] == [([1], []), ([1], [2]), ([], [2]), ([], [])]
    first[1] = 3  # and all pairs in step 3
    assert [sizes(k) for k in (3, 4, 7, 8)] == [([1], []), ([2, 3], []), ([2, 3], []), ([], [])]
    first[1] = 0  # slots older than the words: from the words' step on
    assert [sizes(k) for k in (2, 5, 6)] == [([1, 2, 3], []), ([2, 3], []), ([], [])]
    counts = {s: dict(zip(p, n.tolist())) for s, p, _, n in phrases.looked_at(tokens, 0, 5, 5, 4, 3, first)}
    assert counts == {2: {b"a b": 2, b"b c": 1}, 3: {b"a b c": 1}}


def test_long_text_in_slices(spark, monkeypatch):
    text = " ".join(R.choice("a b c d e".split()) + R.choice(["", "", "."]) for _ in range(4000))
    whole = list(phrases.slices(iter([("en", text)])))
    monkeypatch.setattr(phrases, "SLICE", 500)
    parts = list(phrases.slices(iter([("en", text)])))
    assert len(parts) > 10 and len(whole) == 1
    joined = [t for _, tokens, seen in parts for t in tokens[seen:]]
    assert joined == whole[0][1][:-1]
    first = np.zeros((2, 1 << 18), "u1")
    count = Counter()
    for _, tokens, seen in parts:
        for _, found, _, n in phrases.looked_at(tokens, seen, 1, 1, 4, 3, first):
            count.update(dict(zip(found, n.tolist())))
    want = Counter()
    for piece in text.split("."):
        w = piece.split()
        want.update(" ".join(w[i:i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert count == want


def test_rows_of_a_step_do_not_grow_with_phrases(spark):
    """What tasks hand on is a row for each block of hashes, however many phrases it has."""
    many = [("en", " ".join(f"w{R.randrange(3000)}" for _ in range(1500))) for _ in range(60)]
    scratch = Scratch(spark, "phrases-test")
    counts, _ = phrases.phrase_counts(frame(spark, many), scratch)
    want = Counter(w for _, text in many for w in text.split())
    assert {r.phrase: r.f for r in counts.filter("size = 1").collect()} == {w: n for w, n in want.items() if n >= 10}
    rows = [spark.read.parquet(f"{scratch.root}/*-step-{step}").count() for step in range(4)]
    assert 0 < max(rows) <= 8 * 6  # of each length spelled ones and bits, for 8 blocks


def test_phrases_that_share_a_hash_are_counted_apart():
    h = np.array([7, 7, 9], "u8").tobytes()
    rows = [(2, 0, "en", h, np.array([1, 2, 3]).tobytes(), b"a b\nc d\ne f"),
            (2, 0, "en", h, np.array([10, 20, 30]).tobytes(), b"c d\na b\ne f"),
            (2, 0, "de", h, np.array([4, 5, 6]).tobytes(), b"a b\nc d\ne f")]
    part = phrases.pa.Table.from_batches([phrases.batch_of(phrases.FOUND, rows)])
    got = {(lang, p): int(f) for lang, _, n, found in phrases.added(part) for p, f in zip(found, n)}
    assert got == {("en", b"a b"): 21, ("en", b"c d"): 12, ("en", b"e f"): 33,
                   ("de", b"a b"): 4, ("de", b"c d"): 5, ("de", b"e f"): 6}


@pytest.mark.parametrize("slots", [2, 32, 1 << 18, 1 << 20, 1 << 22])
@pytest.mark.parametrize("blocks", [8, 64])
def test_blocks_set_the_slots_that_are_looked_at(slots, blocks):
    key = phrases.mix(np.arange(3000, dtype="u8"))
    table = np.zeros(-(-slots // 8), "u1")
    for block in range(blocks):
        own = key[key >> np.uint64(65 - blocks.bit_length()) == block]
        begin, bits = phrases.bits_of(own[:len(own) // 2], slots, block, blocks)
        table[begin // 8:begin // 8 + len(bits)] |= np.frombuffer(bits, "u1")
    there = [key[key >> np.uint64(65 - blocks.bit_length()) == b] for b in range(blocks)]
    there = np.concatenate([own[:len(own) // 2] for own in there])
    look = phrases.Table(slots, table, None, 3, 4)
    a, b = phrases.slots_of(there, len(look))
    assert (look[a] == 2).all() and (look[b] == 2).all()
    a, b = phrases.slots_of(key, slots)
    if slots > 1 << 18:  # nearly empty
        assert (np.maximum(look[a], look[b]) == 2).sum() < 1.02 * len(there)
    # with what was there a cycle ago, their cycle is over
    assert (phrases.Table(slots, table, table, 9, 4)[a][look[a] == 2] == 4).all()


def test_tables_grow_with_the_corpus():
    """At 6 GB (1.6 billion words) about 25 million pairs get there: a table of 2^24 slots is full."""
    words, pairs, triples = phrases.table_sizes(1_600_000_000, 3, phrases.SLOT_BITS)
    assert pairs >= 5 * 2 * 25_000_000 and min(words, triples) >= 1 << 24
    assert pairs == 1 << phrases.SLOT_BITS == phrases.table_sizes(10 ** 13, 3, phrases.SLOT_BITS)[2]


def test_empty(spark):
    assert collocations(frame(spark, [("en", "a")]).limit(0)).count() == 0
    assert collocations(frame(spark, [("en", None)])).count() == 0


def test_products_beyond_64_bits(spark):
    """The score's arithmetic, at counts whose squares pass 64 bits."""
    a, l, r = 9 * 10 ** 12, 10 ** 13, 9 * 10 ** 12 + 7
    big = "cast({} as decimal(15,0))"
    row = spark.sql(f"select cast({big.format(a)} * {big.format(a)} * cast(1000000 as decimal(7,0)) as decimal(38,0)) "
                    f"div cast({big.format(l)} * {big.format(r)} as decimal(38,0)) as s").first()
    assert row["s"] == 10 ** 6 * a * a // (l * r)
