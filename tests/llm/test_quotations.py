"""Quotation links against brute force, on long passages, hot quotes and turns that are times."""

import random
import re

from pyspark.sql import functions as F

from workpanel.llm.quotations import chat_messages, message_units, parsed_lines, previous, quotation_links, sentences

SCHEMA = "conv_id long, turn long, role string, text string"


def norm(line):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")


def split(text):
    return [x for x in (re.sub("^ | $", "", p) for p in re.split(r"(?<=[.!?…]) |(?<=[。！？])", text)) if x]


def runs_of(text):
    """``(level, [lines])`` of a text, by reading it line by line."""
    out = []
    for line in (text or "").split("\n"):
        m = re.match(r"[ \t]{0,3}((?:>\s?)+)", line)
        level, bare = (m[1].count(">"), norm(line[m.end():])) if m else (0, norm(line))
        if not bare:
            out.append((None, []))
        elif out and out[-1][0] == level:
            out[-1][1].append(bare)
        else:
            out.append((level, [bare]))
    return [r for r in out if r[0] is not None]


def brute(rows):
    """``(conv, turn, level, line) -> source`` by looking at all messages for every try."""
    written = []
    for c, t, _, text in rows:
        if c is None or t is None:
            continue
        units = set()
        for level, run in runs_of(text):
            if level == 0:
                whole = " ".join(run)
                units |= set(run) | {whole} | set(split(whole))
        written.append((c, t, units))
    best = {}
    for c, t, _, text in rows:
        for level, run in runs_of(text):
            if level == 0 or c is None or t is None:
                continue
            whole, at, spans = " ".join(run), 0, []
            for x in run:
                spans.append((at, at + len(x)))
                at += len(x) + 1
            found, at = [], 0
            for x in split(whole):
                at = whole.index(x, at)
                found.append((x, at, at + len(x)))
                at += len(x)
            for x, (a, b) in zip(run, spans):
                # the line, its passage, then the sentences that it is of, by their place in the passage
                tries = [(0, x), (1, whole)] + [(2 + k, s) for k, (s, p, q) in enumerate(found) if p < b and a < q]
                for nth, unit in tries:
                    same = [(c2, t2) for c2, t2, u in written if unit in u and c2 == c and t2 < t]
                    far = [(c2, t2) for c2, t2, u in written if unit in u and c2 != c]
                    source = min(same or far, default=None)
                    if source:
                        key = (c, t, level, x)
                        best[key] = min(best.get(key, (10 ** 9,)), (nth, source))
    return best


def test_links_equal_brute_force(spark):
    R = random.Random(5)
    some = ["The bell rang.", "Then it rang twice. At last", "nothing", "was heard? Yes", "a key。Une clé! ok", "so it goes", "No.", "x…  y"]
    rows = []
    for c in range(25):
        for t in range(8):
            text = []
            for _ in range(R.randrange(0, 6)):
                marks = R.choice(["", "", "> ", "> > ", ">>", "  > "])
                text.append(marks + R.choice(some + ["", " ".join(R.sample(some, 2))]))
            rows.append((R.choice([c, c, c, None]) if c % 9 == 0 else c, R.choice([t, None]) if c % 11 == 0 else t * 7, "user", "\n".join(text)))
    rows += rows[:9] + [(30, 0, None, None), (30, 1, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = quotation_links(parsed_lines(df)).filter("src_turn is not null").collect()
    count = lambda keys: {k: sum(x[:3] == k for x in set(keys)) for k in {x[:3] for x in keys}}
    assert count([(r.conv_id, r.turn, r.level, bytes(r.line)) for r in got]) == count(list(want))
    sources = lambda triples: sorted(triples, key=repr)
    assert (sources([(r.conv_id, r.turn, r.level, (r.src_conv, r.src_turn)) for r in got])
            == sources([(*k[:3], s) for k, (_, s) in want.items()]))
    assert len(want) > 150


def test_sentences_know_their_lines():
    run = ["one. two", "goes on", "here. three。four", "five!", "six"]
    assert sentences(run) == [("one.", 0, 0), ("two goes on here.", 0, 2), ("three。", 2, 2), ("four five!", 2, 3), ("six", 4, 4)]
    assert sentences(["a.", "b."]) == [("a.", 0, 0), ("b.", 1, 1)] and sentences(["。"]) == [("。", 0, 0)]


def test_units_of_a_passage_grow_with_its_lines():
    for n in (800, 3200, 12800):
        norms = [f"line {k} ends. and" for k in range(n)]
        assert len(list(message_units([1] * n, norms, False))) <= 5 * n
        assert len(list(message_units([0] * n, norms, True))) <= 3 * n and not list(message_units([0] * n, norms, False))
    # one line of many sentences, and one sentence of many lines
    assert len(list(message_units([1], [" ".join(f"s{k}." for k in range(5000))], False))) <= 5002
    assert len(list(message_units([2] * 5000, [f"w{k}" for k in range(5000)], False))) == 10000


def test_turns_that_are_times_and_far_apart(spark):
    rows = [(7, 1_700_000_000_000 + k * k * 977, "user", f"m{k}") for k in range(4000)] + [(8, 2 ** 62, "user", "a"), (8, -2 ** 62, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.turn): (r.last, r.place) for r in previous(df.select("conv_id", "turn")).collect()}
    assert all(got[7, rows[k][1]] == (rows[k - 1][1] if k else None, k) for k in range(4000))
    assert got[8, 2 ** 62] == (-2 ** 62, 1) and got[8, -2 ** 62] == (None, 0)
    out = chat_messages(df).filter("conv_id = 7").agg(F.max("depth"), F.countDistinct("thread")).first()
    assert tuple(out) == (3999, 1)


def test_a_hot_quote_and_a_hot_conversation_are_split(spark):
    """Two thirds of the messages quote one line, and stand in one conversation."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    rows = [(0, 0, "user", "the rule")] + [(k % 3 and 1 or k, k, "user", "> the rule\n> the rule") for k in range(1, 9000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def splits(out):
            got = out.collect()
            return len(got), out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("skew=true")

        links = quotation_links(parsed_lines(df))
        n, split_joins = splits(links)
        assert n == 8999 and split_joins >= 1
        assert links.filter("src_conv = 0 and src_turn = 0").count() == 8999
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
