"""Conversations without quotes: quoted passages are linked to the messages they come from.

Lines that begin with one or more ``>`` are quotes; the number of marks is the
level.  A run of lines of one level, without blank ones, is a passage.  Lines are
normalised (lower case, single blanks); a quoted line's source is looked for by
the line, by its passage as one text, however wrapped, and by the passage's
sentences that the line is of, in this order, among the lines, passages and
sentences that messages wrote themselves: in the same conversation first, else
in another.  The message a reply answers is the source of its outermost quote,
else the message before it, which need not have the turn before; following these links gives each message's thread and depth, and
conversations are ordered thread by thread.

The output has one row for each message, so no conversation is gathered in one
place; its text is the concatenation of ``chat`` by ``thread``, ``turn``.

Defined cases: null and empty texts are messages without lines; a quote found
nowhere has a null source; the earliest own line wins ties; repeated (conv_id,
turn) rows each give their row and share links; a message of any length is
read once, and its rows grow with its text; null conv_id or turn gives a row
of its own without links; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workpanel.llm.common import staged

MARKS = r"^\s{0,3}((?:>\s?)+)"
#: Rounds of following replies; each doubles the distance, so threads of 2^40 messages end.
ROUNDS = 40
# Lines are trimmed and single-blanked, so a sentence ends before a blank or line end, or at once.
SENTENCE_END = re.compile(r"(?<=[.!?…])[ \n]+|(?<=[。！？])")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def parsed_lines(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``lines``: structs of quote ``level`` (0: own), bare ``line``, and ``norm``, its normal form."""
    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        bare = F.regexp_replace(line, MARKS, "")
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).cast("int").alias("level"),
                        F.when(marks == "", line).otherwise(bare).alias("line"), normal(bare).alias("norm"))

    return messages.withColumn("lines", F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), one))


def digest(text: str) -> bytes:
    """What a unit is known by: 128 bits, so that no text is shuffled."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def passages(levels: list[int], norms: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of lines of one level without blank ones."""
    run: list[str] = []
    for k, (level, norm) in enumerate(zip(levels, norms)):
        if norm:
            run.append(norm)
            if k + 1 == len(norms) or levels[k + 1] != level or not norms[k + 1]:
                yield level, run
                run = []


def sentences(run: list[str]) -> list[tuple[str, int, int]]:
    """The passage's sentences, each with the first and the last line that it is of."""
    text, out, at, line = "\n".join(run), [], 0, 0
    for begin, end in [(m.start(), m.end()) for m in SENTENCE_END.finditer(text)] + [(len(text), len(text))]:
        part = text[at:begin]
        lead = len(part) - len(part.lstrip("\n "))
        first = line + part.count("\n", 0, lead)
        line += part.count("\n")
        if lead < len(part):
            out.append((part[lead:].replace("\n", " "), first, line))
        line += text.count("\n", begin, end)
        at = end
    return out


def message_units(levels: list[int], norms: list[str], own: bool) -> Iterator[tuple[int, bytes | None, int | None, bytes]]:
    """``level, line, nth, unit`` of one message: with ``own`` what it wrote itself (lines, passages
    and sentences; level 0, neither line nor ``nth``), else for every quoted line its tries in
    their order: the line, its passage, the sentences that it is of.  A passage is
    taken apart once, so the work and the rows grow with the text."""
    written: set[bytes] = set()
    tries: dict[tuple[int, bytes, bytes], int] = {}
    for level, run in passages(levels, norms):
        if own != (level == 0):
            continue
        parts, whole, lines = sentences(run), digest(" ".join(run)), [digest(x) for x in run]
        if own:
            written.update(lines, [whole], (digest(x) for x, _, _ in parts))
            continue
        units = [[(0, h), (1, whole)] for h in lines]
        for k, (text, first, last) in enumerate(parts):
            h = digest(text)
            for at in range(first, last + 1):
                units[at].append((2 + k, h))
        for h, found in zip(lines, units):
            for nth, unit in found:
                tries[level, h, unit] = min(nth, tries.get((level, h, unit), nth))
    yield from ((0, None, None, h) for h in written)
    yield from ((level, line, nth, unit) for (level, line, unit), nth in tries.items())


UNITS = "conv_id {conv}, turn {turn}, level int, line binary, nth int, unit binary"
#: Rows that one batch of units returns, about.
BATCH = 50_000


def units_of(lines: DataFrame, own: bool) -> DataFrame:
    """``conv_id, turn, level, line, nth, unit`` of all messages (``message_units``)."""
    kept = F.exists("lines", lambda x: ((x["level"] == 0) if own else (x["level"] > 0)) & (x["norm"] != ""))
    kind = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = UNITS.format(conv=kind["conv_id"], turn=kind["turn"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            where: list[int] = []

            def made() -> pa.RecordBatch:
                back = pa.array(where, pa.int64())
                cols = [batch.column(0).take(back), batch.column(1).take(back)]
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary())
                cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "level", "line", "nth", "unit"])

            for i in range(batch.num_rows):
                for row in message_units(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), own):
                    rows.append(row)
                    where.append(i)
                    if len(rows) >= BATCH:
                        yield made()
                        rows, where = [], []
            if rows:
                yield made()

    parts = lines.filter(kept).select("conv_id", "turn", F.transform("lines", lambda x: x["level"]).alias("levels"),
                         F.transform("lines", lambda x: x["norm"]).alias("norms"))
    return parts.mapInArrow(taken, schema)


def previous(nodes: DataFrame) -> DataFrame:
    """``conv_id, turn, last, place`` for distinct ``nodes``: the turn before it in the conversation,
    if there is one, and how many there are.  The nodes are put in ranges of (conversation, turn)
    of like sizes, so no task sorts a whole conversation, whatever its turns are (numbers, times);
    a conversation's ranges are as many as tasks at most."""
    ranged = nodes.repartitionByRange("conv_id", "turn").withColumn("block", F.spark_partition_id())
    blocks = staged(ranged, "chat-ranges")  # ranges come from a sample: fixed from here on
    before = Window.partitionBy("conv_id").orderBy("block")
    ends = staged(blocks.groupBy("conv_id", "block").agg(F.max("turn").alias("end"), F.count(F.lit(1)).alias("n"))
                  .select("conv_id", "block", F.lag("end").over(before).alias("end"), (F.sum("n").over(before) - F.col("n")).alias("base")),
                  "chat-range-ends")
    inner = Window.partitionBy("conv_id", "block").orderBy("turn")
    ranked = blocks.withColumn("own", F.lag("turn").over(inner)).withColumn("k", F.row_number().over(inner) - 1)
    return ranked.join(ends, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("own", "end").alias("last"),
                                                          (F.col("base") + F.col("k")).alias("place"))


def quotation_links(lines: DataFrame) -> DataFrame:
    """``conv_id, turn, level, line, src_conv, src_turn``: each quoted line's source; ``line`` is its digest.

    Sources are written tables of one row a unit (and conversation), so the joins shuffle both
    sides and Spark can split a quote that a large part of all messages has."""
    known = lines.filter("conv_id is not null and turn is not null")
    quoted = staged(units_of(known, own=False).groupBy("conv_id", "turn", "level", "line", "unit").agg(F.min("nth").alias("nth")), "chat-quoted")
    wanted = staged(quoted.select("unit").distinct(), "chat-wanted")
    own = units_of(known, own=True).select("unit", "conv_id", "turn")
    # one row for each unit and conversation, and for each unit
    here = staged(own.join(wanted, "unit", "left_semi").groupBy("unit", "conv_id").agg(F.min("turn").alias("own_turn")), "chat-sources")
    # the second conversation is for quotes in the first; both are the least of aggregates
    first = F.min(F.struct("conv_id", F.col("own_turn").alias("turn"))).alias("first")
    lowest = staged(here.groupBy("unit").agg(first), "chat-first")
    second = (here.join(lowest, "unit").filter("conv_id <> first.conv_id").drop("first")
              .groupBy("unit").agg(first).withColumnRenamed("first", "second"))
    anywhere = staged(lowest.join(second, "unit", "left"), "chat-anywhere")
    found = quoted.join(here, ["unit", "conv_id"], "left").join(anywhere, "unit", "left")
    earlier = F.col("own_turn") < F.col("turn")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(F.col("conv_id").isNotNull(), F.col("second"))
    found = found.withColumn("src", F.when(earlier, F.struct("conv_id", F.col("own_turn").alias("turn"))).otherwise(other))
    return (found.groupBy("conv_id", "turn", "level", "line")
            .agg(F.min(F.when(F.col("src.turn").isNotNull(), F.struct("nth", "src"))).alias("best"))
            .select("conv_id", "turn", "level", "line", F.col("best.src.conv_id").alias("src_conv"), F.col("best.src.turn").alias("src_turn")))


def reply_threads(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` from the links ``conv_id, turn, parent``
    of earlier turns: the turn that
    opens the thread, and the steps to the start of the conversation."""
    nodes = messages.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    own = staged(previous(nodes).join(answers, ["conv_id", "turn"], "left")
                 .select("conv_id", "turn", F.coalesce("parent", "last", "turn").alias("at"),
                         F.coalesce("parent", "last").isNotNull().cast("long").alias("depth"), "place",
                         # a quote of an older message opens a thread of its own
                         F.coalesce(F.col("parent") < F.col("last"), F.lit(False)).alias("opens")), "chat-links")
    if own.filter("opens").isEmpty():  # every message answers the one before it
        # written, so that the join can split a hot conversation
        first = staged(nodes.groupBy("conv_id").agg(F.min("turn").alias("thread")), "chat-openers")
        return own.join(first, "conv_id").select("conv_id", "turn", "thread", F.col("place").cast("long").alias("depth"))
    root = staged(own.select("conv_id", "turn", F.when(F.col("opens"), F.col("turn")).otherwise(F.col("at")).alias("thread"),
                             "at", "depth"), "chat-threads")
    for _ in range(ROUNDS):
        up = root.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("more"))
        over = root.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("thread2"))
        new = staged(root.join(up, ["conv_id", "at"], "left").join(over, ["conv_id", "thread"], "left")
                     .select("conv_id", "turn", F.coalesce("thread2", "thread").alias("thread"),
                             F.coalesce("at2", "at").alias("at"),
                             (F.col("depth") + F.when(F.col("at") != F.col("turn"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("depth"),
                             ((F.coalesce("at2", "at") != F.col("at")) | (F.coalesce("thread2", "thread") != F.col("thread"))).alias("moved")),
                     "chat-threads")
        root = new.drop("moved")
        if new.filter("moved").isEmpty():
            return root.select("conv_id", "turn", "thread", "depth")
    raise RuntimeError(f"reply_threads: no end after {ROUNDS} rounds")


def chat_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, thread, depth, content, n_quoted, n_linked,
    reply_to_conv, reply_to, chat``: every message without its quotes, where it
    stands, what it answers, and its formatted piece of the conversation."""
    lines = parsed_lines(messages.select("conv_id", "turn", "role", "text"))
    links = staged(quotation_links(lines), "chat-quotes")
    by_message = links.groupBy("conv_id", "turn").agg(
        F.count("src_turn").alias("n_linked"),
        # the outermost quote's source; of several the latest
        F.min(F.when(F.col("src_turn").isNotNull(), F.struct("level", (-F.col("src_turn")).alias("late"), "src_conv"))).alias("top"))
    answers = by_message.filter("top.src_conv = conv_id").select("conv_id", "turn", (-F.col("top.late")).alias("parent"))
    threads = reply_threads(messages, answers)
    own = F.filter("lines", lambda x: x["level"] == 0)
    content = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n"))
    rows = lines.select("conv_id", "turn", "role", content.alias("content"),
                        F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))).cast("long").alias("n_quoted"))
    rows = rows.join(threads, ["conv_id", "turn"], "left").join(by_message, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("user"))
    return rows.select("conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
                       "content", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                       F.col("top.src_conv").alias("reply_to_conv"), (-F.col("top.late")).alias("reply_to"),
                       F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("content"), F.lit("\n")).alias("chat"))
