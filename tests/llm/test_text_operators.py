"""The text operators against brute force, and on nulls, empty and long texts, ties, empty tables and odd columns."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from workpanel.llm.common import Scratch, components, numbered
from workpanel.llm.decontamination import MASKS, contaminated, decontaminate
from workpanel.llm.ngram_join import across, ngram_components
from workpanel.llm.packing import pack_documents, pack_lengths, text_words, word_ids
from workpanel.llm.pii import pseudonymise
from workpanel.llm.quality_classifier import class_prior, quality_scores
from workpanel.llm.quality_rules import clean_lines
from workpanel.llm.queries import tokenizer_file
from workpanel.llm.quotations import chat_messages
from workpanel.llm.sharding import shard_documents
from workpanel.llm.token_counts import Lengths, token_counts
from workpanel.llm.toxicity import NAMES, Voters, toxicity_scores, words_of

R = random.Random(7)
VOCAB = [f"w{k}" for k in range(400)] + "the of and to in that is for on with".split()


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def edited(text, k):
    w = text.split()
    for _ in range(k):
        w[R.randrange(len(w))] = f"x{R.randrange(10 ** 6)}"
    return " ".join(w)


BASE = prose(120)
TEXTS = ([None, "", " \n\t ", "one", "two words", "Two WORDS", "a b c d", BASE, BASE, BASE.upper(), prose(30_000)]
         + [edited(BASE, R.randrange(1, 9)) for _ in range(60)] + [prose(R.randrange(1, 60)) for _ in range(60)]
         + [prose(5) + " " + prose(4) for _ in range(10)])
# small neighbours: one word more or less at the end
TEXTS += [" ".join(f"s{k}" for k in range(n)) for n in range(4, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), k) for k, t in enumerate(TEXTS)]
    # names that operators use inside, as extra columns of the input
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard long").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(t):
    w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate({a: a + 32 for a in range(65, 91)}))
    return frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_ngram_components(spark, docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs).collect()}
    assert got == brute_components(list(enumerate(TEXTS)))
    assert ngram_components(empty).count() == 0
    # repeated and null ids
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_components(twice).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_ngram_components_large_near_copy_group(spark):
    base = prose(150)
    rows = [(k, edited(base, R.randrange(0, 14))) for k in range(500)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def star_of(hub, family, edits, size, percent, foreign=0):
    """Classes of one star: near copies of a base set, each with changes of its own."""
    base = [1000 * hub + k for k in range(size)]
    sets = {hub * 1000: base}
    for k in range(1, family):
        gone = set(R.sample(range(size), R.randrange(edits + 1)))
        own = [x for j, x in enumerate(base) if j not in gone] + [10 ** 6 * hub + 10 ** 3 * k + j for j in range(R.randrange(edits + 1))]
        sets[hub * 1000 + k] = own + R.sample(range(50), foreign)
    return {c: sorted(set(x)) for c, x in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_across_finds_every_link_between_components(spark, percent):
    stars, sets = [], {}
    for hub, (family, edits, size, foreign) in enumerate([(40, 12, 60, 0), (30, 4, 20, 3), (30, 30, 90, 10), (3, 2, 9, 0), (2, 5, 30, 0)], 1):
        own = star_of(hub, family, edits, size, percent, foreign)
        sets |= own
        stars += [(hub * 1000, c) for c in own]
    stars += [(1000, c) for c in sets if 3000 <= c < 3010]  # a class in two stars
    comp = {c: R.randrange(6) if c % 3 else c for c in sets}
    jaccard = lambda a, b: (lambda x, y: 100 * len(x & y) >= percent * len(x | y))(set(sets[a]), set(sets[b]))
    place = spark.createDataFrame([(c, len(x), comp[c]) for c, x in sets.items()], "cls long, n long, comp long")
    grams = spark.createDataFrame(list(sets.items()), "cls long, grams array<long>")
    found = {(r["a"], r["b"]) for r in across(spark.createDataFrame(stars, "hub long, cls long"), place, grams, percent,
                                              Scratch(spark, "test")).collect()}
    by_hub = {}
    for hub, c in stars:
        by_hub.setdefault(hub, []).append(c)
    pairs = {tuple(sorted(p)) for m in by_hub.values() if len(m) > 2 for p in combinations(m, 2) if comp[p[0]] != comp[p[1]]}
    assert found <= pairs
    linked = {p for p in pairs if jaccard(*p)}
    # a link is found, or both its ends link with the star's nearest class
    parent = {c: c for c in sets}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    first = {}
    for c, own in comp.items():
        parent[root(c)] = root(first.setdefault(own, c))
    for a, b in (p for p in found if jaccard(*p)):
        parent[root(a)] = root(b)
    assert len(linked) >= 20 and all(root(a) == root(b) for a, b in linked)


def test_near_links_do_not_meet(spark):
    """A family of texts that nearly link: pairs looked at do not grow with its square."""
    sets = star_of(1, 300, 0, 100, 80)
    for k, c in enumerate(sets):
        sets[c] = sorted(set(sets[c][18:]) | {10 ** 7 + 100 * k + j for j in range(18)} if k % 2 else
                         set(sets[c][:-18]) | {10 ** 7 + 100 * k + j for j in range(18)})
    place = spark.createDataFrame([(c, len(x), c) for c, x in sets.items()], "cls long, n long, comp long")
    grams = spark.createDataFrame(list(sets.items()), "cls long, grams array<long>")
    stars = spark.createDataFrame([(1000, c) for c in sets], "hub long, cls long")
    assert across(stars, place, grams, 80, Scratch(spark, "test")).count() <= 2 * len(sets)


def test_ngram_components_of_short_near_copies(spark):
    rows = []
    for group in range(60):
        base = [f"g{group}w{k}" for k in range(R.randrange(12, 26))]
        for _ in range(12):
            w = list(base)
            for _ in range(R.randrange(0, 2)):
                w[R.choice((0, 1, -1, -2, R.randrange(len(w))))] = f"x{R.randrange(40)}"
            rows.append((len(rows), " ".join(w[R.randrange(2):len(w) - R.randrange(2)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_components_of_two_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (5, a + " tail"), (6, b + " tail"), (None, c), (None, c + " tail"), (None, a + " other"), (1, c[:-4] + " end")]
    got = {(r["doc_id"], r["n_shingles"], r["class_id"]): r["component_id"]
           for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and set(got.values()) == {1}  # every row has a near copy under id 1
    rows = [(9, a), (9, b), (2, a + " tail"), (3, b + " tail"), (None, c), (None, c + " tail"), (4, c + " end of it")]
    got = sorted((r["doc_id"] or 0, r["component_id"])
                 for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 4), (0, 4), (2, 2), (3, 3), (4, 4), (9, 2), (9, 3)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 900: 900, 901: 900}


def test_numbered_is_gapless(spark):
    df = spark.range(5000).select(F.col("id").alias("uid"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    ranks = numbered(df, ["k"], "uid", 500_000).groupBy("k").agg(F.min("rank").alias("a"), F.max("rank").alias("b"),
                                                                 F.count_distinct("rank").alias("d"), F.count("*").alias("n"))
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["d"] == r["n"] for r in ranks.collect())


def test_packing_round_trip(docs, empty):
    path, limit = tokenizer_file("word_bpe_49k.json"), 256
    tokenizer = word_ids(path).tokenizer
    rows = pack_documents(docs, path, max_tokens=limit).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= limit
        by_doc.setdefault(r["doc_id"], {})[r["start"]] = ids
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in enumerate(TEXTS):
        joined = [x for _, ids in sorted(by_doc[k].items()) for x in ids]
        assert joined == tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    filled = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        filled.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(n <= limit // 2 for n in filled) <= 1  # a pack opens only when no other has room
    assert pack_documents(empty, path).count() == 0


def test_pack_lengths_places_everything_once():
    histogram = {R.randrange(1, 65): R.randrange(1, 50) for _ in range(40)}
    seen = {}
    for count, lengths in pack_lengths(histogram, 64):
        assert sum(lengths) <= 64
        for n in lengths:
            seen[n] = seen.get(n, 0) + count
    assert seen == histogram


ODD = ["Ça ÀÉ ß ẞ İ I'm don't <|endoftext|> a<|endoftext|>b", "a  b\n\n  d \n e\t\tf \xa0 g\x85 h\x1c i", "日本語 テスト a1b2\nfoo\n\nbar",
       "Привет мир foo\n x\ny.\nz", "ªb aºb µm ²½", "áb 'S 'LL we'll", "Ω ΑΣ <|startoftext|>"]
ALPHABET = "ab é'\n\t .,1²日Я\x1c\xa0sA!"
ODD += ["".join(R.choice(ALPHABET) for _ in range(R.randrange(30))) for _ in range(800)]


def test_token_units_match_the_library():
    counts, ids = Lengths(tokenizer_file("byte_bpe_50k.json")), word_ids(tokenizer_file("word_bpe_49k.json"))
    for t in ODD:
        assert counts.count(t) == len(counts.tokenizer.encode(t, add_special_tokens=False)), t
        assert np.frombuffer(b"".join(map(ids.__getitem__, text_words(t))), "<u4").tolist() == ids.tokenizer.encode(
            t, add_special_tokens=False).ids, t


def test_token_counts(docs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Lengths(path).tokenizer
    for r in token_counts(docs, path).collect():
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False))
    assert token_counts(empty, path).count() == 0


def test_pseudonyms(spark):
    rows = ["card 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112", "mail a.b@c.de and A.B@c.de, ip 10.0.0.1, not 999.1.1.1",
            "born 1980-02-29, not 1981-02-29; 31/12/1999 and 12/31/1999 and 31.12.1999", "+1 (743) 555-3824, 123-45-6789, not 000-12-3456",
            'DE89370400440532013000 not DE89370400440532013001 token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "", None,
            "plain 12 34", "4111111111111111", "x" * 50_000]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(rows)], "doc_id long, text string, n_pseudonyms int")
    out = {r["doc_id"]: (r["text"], r["n_pseudonyms"]) for r in pseudonymise(df, "key").collect()}
    assert out[5] == ("", 0) and out[6] == (None, 0) and out[7] == (rows[7], 0) and out[9] == (rows[9], 0)
    first, second = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", out[0][0])[:2]
    assert first == second.replace(" ", "") == out[8][0] != rows[8]  # linked across documents and forms
    digits = [int(c) for c in reversed(first)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert "4111111111111112" in out[0][0] and "4111111111111111" not in out[0][0]
    a, b = re.findall(r"user\d{19}@mail\.invalid", out[1][0])
    assert a == b and "999.1.1.1" in out[1][0] and "10.0.0.1" not in out[1][0]
    assert "1981-02-29" in out[2][0] and not re.search(r"1980-02-29|31/12/1999", out[2][0])
    moved = re.findall(r"\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}", out[2][0])
    assert moved[0][:2] == moved[1][3:5] == moved[2][:2] and out[2][1] == 4
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d\d-\d{4}, not 000-12-3456", out[3][0])
    account = re.search(r"DE\d{20}", out[4][0])[0]
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and "DE89370400440532013001" in out[4][0]
    assert re.search(r'token = "[0-9a-f]{40}"$', out[4][0]) and "f3ef4d6b" not in out[4][0]


def test_pseudonyms_are_one_to_one(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ip 10.0."), F.floor(F.col("id") / 256).cast("string"), F.lit("."),
                                                                        (F.col("id") % 256).cast("string")).alias("text"))
    assert pseudonymise(df, "k").select("text").distinct().count() == 3000
    assert pseudonymise(df.limit(0), "k").count() == 0


def test_decontamination(spark, empty):
    item = prose(40)
    w = item.split()
    swapped = " ".join("zz" if k % 9 == 4 else x for k, x in enumerate(w))
    bench = spark.createDataFrame([(7, item), (9, item.upper()), (8, None), (6, ""), (5, "too short"), (4, prose(30))], "item_id long, text string")
    rows = [(1, f"{prose(30)} {item} {prose(10)}"), (2, f"{prose(5)}, {swapped.replace(' ', ', ')}"), (3, prose(3000)), (4, None), (5, ""),
            (6, " ".join(w[:20]) + " " + prose(50)), (7, " ".join(w[:9]) + " " + prose(50)), (None, item), (1, prose(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (6, 7), (None, 7)}
    kept = decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7] and kept.columns == docs.columns
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    items = {n: prose(n) for n in (1, 5, 11, 12, 15, 40)}
    items[1] = "zyx"
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(n, f"{prose(20)} {t.upper()} {prose(20)}") for n, t in items.items()] + [(100 + n, t) for n, t in items.items()]
    rows += [(200 + n, f"{prose(20)} {' '.join(t.split()[:-1])} q q {prose(20)}") for n, t in items.items() if n in (5, 11)]
    rows += [(300, " ".join(items[40].split()[10:23])), (301, " ".join(items[40].split()[10:21])), (302, None), (303, prose(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(k + n, n) for n in items for k in (0, 100)} | {(300, 40)}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == whole
    assert {r["doc_id"] for r in decontaminate(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in whole}


def test_short_items_of_few_tokens_can_be_left_out(spark):
    bench = spark.createDataFrame([(1, "The"), (2, "no no no no"), (3, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "no no no no no"), (3, "one two three four"), (4, "the one two")],
                                 "doc_id long, text string").withColumn("_row", F.lit(1))
    pairs = lambda **kw: {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, **kw).collect()}
    assert pairs() == {(1, 1), (4, 1), (2, 2), (3, 3)} and pairs(least_tokens=3) == {(3, 3)}
    kept = decontaminate(docs, bench, least_tokens=3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 4}


def test_stage_masks_fit_every_placement_of_tolerated_changes():
    for n in range(12, 25):
        for changed in combinations(range(n), n - -(-80 * n // 100)):
            same = "".join("0" if k in changed else "1" for k in range(n))
            assert any(re.search(f"(?={m.replace('0', '.')})", same) for m in MASKS), same


def test_decontamination_with_spread_changes(spark):
    items, rows = {}, []
    for n, k in ((12, 2), (15, 3), (16, 3), (20, 4), (24, 4)):
        for _ in range(40):
            own = prose(n).split()
            items[len(items)] = " ".join(own)
            for c in R.sample(range(n), k):
                own[c] = f"y{R.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(own)))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == {(k, k) for k in items}


def brute_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + o for at in grams.values() if len(at) > 1 for k in at for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, docs, empty):
    good = ". ".join(prose(12) for _ in range(8)) + "."
    extra = ["a b c a b c a b c", "a a a a a a", "x y z w x y z", "line\nline\n\nline\nother", "#tag *b* $5 %6 &c |d| <e>", good,
             good + "\n" + " | ".join(["Home", "News", "About", "Contact"]), "\n".join([" | ".join(VOCAB[:20])] * 30),
             "\n".join("WORDS IN CAPITALS AND MORE OF THEM %d" % k for k in range(30)), "é" * 10 + " x 日本"]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in clean_lines(df.withColumn("kept", F.lit("clash"))).collect()}
    for k, t in [*enumerate(TEXTS), *((1000 + k, t) for k, t in enumerate(extra))]:
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t), k
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert got[1005]["kept"] and got[1006]["kept"] and got[1006]["clean_text"] == good
    assert not got[1007]["kept"] and not got[1008]["kept"]
    assert clean_lines(empty).count() == 0


def test_sharding(spark, docs, empty):
    rows = [(k, "same text") for k in range(40)] + [(100 + k, f"pair {k // 2}") for k in range(40)] + [(None, None), (None, "")]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = shard_documents(df, shards=7).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] >= 16
    assert len(got) == len(TEXTS) + len(rows) and set(sizes) == set(range(7))
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    pairs = {}
    for r in got:
        if r["unit"] is not None:
            pairs.setdefault(r["unit"], set()).add(r["shard"])
    assert sum(len(s) == 1 for s in pairs.values()) >= 0.9 * len(pairs)
    assert shard_documents(empty).count() == 0
    assert sorted(r["slot"] for r in shard_documents(df.limit(3)).collect()) == [0, 0, 0]


def test_quotations(spark):
    rows = [(1, 0, "user", "Where is the key?\nI lost it."), (1, 1, "assistant", "> where is  the KEY?\nUnder the mat."),
            (1, 2, "user", "> > Where is the key?\n> Under the mat.\nThanks."), (1, 3, "user", "> I lost it.\nStill lost."),
            (2, 0, "user", "> Under the mat.\n> never written\nFound elsewhere."), (2, 1, "assistant", None), (3, 5, None, ""),
            (None, 1, "user", "> Thanks."), (4, 0, "user", "same"), (4, 0, "user", "same")]
    out = chat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit(1)))
    got = {}
    for r in out.collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    one = lambda c, t: got[c, t][0]
    assert one(1, 1)["content"] == "Under the mat." and (one(1, 1)["reply_to_conv"], one(1, 1)["reply_to"]) == (1, 0)
    assert (one(1, 2)["n_quoted"], one(1, 2)["n_linked"], one(1, 2)["reply_to"]) == (2, 2, 1) and one(1, 2)["content"] == "Thanks."
    assert (one(1, 3)["reply_to"], one(1, 3)["thread"], one(1, 3)["depth"]) == (0, 3, 1) and one(1, 2)["thread"] == 0 and one(1, 2)["depth"] == 2
    assert (one(2, 0)["reply_to_conv"], one(2, 0)["reply_to"], one(2, 0)["n_quoted"], one(2, 0)["n_linked"]) == (1, 1, 2, 1)
    assert one(2, 1)["content"] == "" and one(3, 5)["chat"] == "<|user|>\n\n" and len(got[4, 0]) == 2
    assert len(out.collect()) == len(rows) and chat_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotations_of_passages_sentences_and_other_conversations(spark):
    rows = [(1, 0, "user", "> The key is lost.\nNo."), (1, 3, "user", "The key is lost."), (2, 4, "user", "The key is lost."),
            (5, 0, "user", "First of all. Then the bell\nrang twice. At last nothing.\n\nAnother paragraph here"), (5, 2, "user", "so"),
            (5, 5, "assistant", "> then the bell rang twice.\nyes"), (5, 2000, "assistant", "> Another\n> paragraph\n> here\nno"),
            (5, 2001, "user", "> Another\n>\n> paragraph\nwhat"), (6, 0, "user", "a"), (6, 2, "user", "b"), (6, 5, "user", "c"), (6, 3000, "user", "d"),
            (None, 1, "user", "rang twice."), (7, 1, "user", "> nothing like it. at last\n> nothing.")]
    make = lambda x: spark.createDataFrame(x, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat_messages(make(rows)).collect()}
    source = lambda c, t: (got[c, t]["reply_to_conv"], got[c, t]["reply_to"], got[c, t]["n_quoted"], got[c, t]["n_linked"])
    assert source(1, 0) == (2, 4, 1, 1)  # not its own later line
    assert source(5, 5) == (5, 0, 1, 1) and source(5, 2000) == (5, 0, 3, 3) and source(5, 2001) == (None, None, 2, 0)
    assert source(7, 1) == (5, 0, 2, 2)
    place = lambda c, t: (got[c, t]["thread"], got[c, t]["depth"])
    assert [place(6, t) for t in (0, 2, 5, 3000)] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert [place(5, t) for t in (0, 2, 5, 2000, 2001)] == [(0, 0), (0, 1), (5, 1), (2000, 1), (2000, 2)]
    assert len(got) == len(rows)
    alone = {r["turn"]: (r["thread"], r["depth"]) for r in chat_messages(make([r for r in rows if r[0] == 6])).collect()}
    assert alone == {0: (0, 0), 2: (0, 1), 5: (0, 2), 3000: (0, 3)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k in range(600):
        t = prose(R.randrange(20, 80)) + "."
        toxic, good = int(k % 6 == 0), int(k % 5 != 0)
        if toxic:
            w = t.split()
            for x in R.sample("idiot moron stupid trash zorblax".split(), 2):
                w.insert(R.randrange(len(w)), x)
            t = " ".join(w)
        if not good:
            t = "!! ".join(t.upper().split()) + " ### $$$"
        rows.append((k, t, good, toxic))
    return spark.createDataFrame(rows + [(None, None, None, None), (9000, "", None, None)], "doc_id long, text string, quality int, toxic int")


def held(n, rest):
    return lambda k: k is not None and zlib.crc32(str(k).encode()) % n == rest


def test_toxicity(spark, labelled, empty):
    mine = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))
    out = toxicity_scores(labelled, mine, labelled.filter(mine).select("doc_id", "toxic")).collect()
    test = [r for r in out if held(5, 0)(r["doc_id"]) and r["toxic"] is not None]
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in test) >= 0.95 * len(test) and len(out) == 602
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity_scores(empty, F.lit(True), labelled.select("doc_id", "toxic")).count() == 0


def test_every_pattern_is_tried():
    voters = Voters({})
    phrases = {"dismiss": ["shut up", "go to hell", "drop dead", "kill yourself", "get lost", "go die", "screw you", "piss off", "hate you",
                           "nobody likes you"],
               "masked": ["id1ot", "id!ot", "m0ron", "mor0n", "stup1d", "f*ck", "f@ck", "f#ck", "sh1t", "sh!t", "sh*t", "b1tch",
                          "b!tch", "b*tch", "l0ser", "tr@sh", "tr4sh", "4sshole"],
               "you_are": ["you are an idiot", "you're a complete fool", "you r trash"]}
    for name, texts in phrases.items():
        for t in texts:
            for text in (t, t.upper(), f"Well, {t}."):
                assert voters.votes(text, words_of(text)) >> NAMES.index(name) & 1, text


def test_quality(spark, labelled, empty):
    mine = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))
    out = quality_scores(labelled.select("doc_id", "text"), labelled.filter(mine).select("doc_id", "quality"), mine)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    test = [r for r in labelled.collect() if held(4, 2)(r["doc_id"]) and r["quality"] is not None]
    good, bad = ([got[r["doc_id"]] for r in test if r["quality"] == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98 and all(0 <= s <= 1 for s in got.values())
    assert quality_scores(empty.select("doc_id", "text"), labelled.select("doc_id", "quality"), F.lit(True)).count() == 0


def test_class_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000)
    assert abs(class_prior(good[:2000], np.concatenate([good[2000:3400], bad[:600]])) - 0.7) < 0.05


def test_quality_sample_is_bounded_by_rows(spark):
    """Two thirds of the rows under one id: the sample does not grow with them."""
    from workpanel.llm.quality_classifier import sampled

    rows = spark.range(30_000).select(F.when(F.col("id") < 20_000, 1).otherwise(F.col("id")).alias("_id"),
                                      F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("_text"))
    got = [r["_text"] for r in sampled(rows, 2000).collect()]
    assert 800 < len(got) <= 2000 and len(set(got)) == len(got)
    assert set(got) == {r["_text"] for r in sampled(rows.repartition(7), 2000).collect()}
    assert sampled(rows.limit(0), 10).count() == 0
