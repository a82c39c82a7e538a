"""Chat conversations cut into budgeted, turn-aligned training windows."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, slots, stash
from .tokens import VOCABULARY, encoder
from .worker import arrow

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers of a conversation that one block holds, and times as many rows from which a block is cut; longer conversations go to several tasks.
BLOCK, HEAVY = 512, 8
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
SCHEMA = "conv_id long, block long, part int, window int, formatted string, loss array<struct<start:int,end:int>>, n_repeated int, n_turns int, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    """Put one backslash more between < and |, so that no marker can occur; :func:`unescape` takes it out."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends in it."""
    head = f"{START}{escape(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a window."""
    return [(unescape(m[1]).replace("%0A", "\n").replace("%25", "%"), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _windows(budget: int, history: int, tokenizer: str):
    """Greedy spans over prefix sums of turn tokens; rows come in order, and what is held is bounded by the budget and one turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: object = work  # no group yet
        out: list[tuple] = []
        system, past, fresh, total, number = None, deque(), [], 0, 0  # total: prefix sum at the end of the last turn

        def close() -> None:
            nonlocal fresh, number
            if not fresh:
                return
            lead = ([system] if system and fresh[0][3] != "first" else []) + repeat
            parts, loss, at = [], [], 0
            for k, (role, text, _, _, _) in enumerate(lead + fresh):
                s, i, j = render(role, text)
                if k >= len(lead) and role == "assistant":
                    loss.append({"start": at + i, "end": at + j})
                parts.append(s)
                at += len(s)
            n = sum(x[2] for x in lead + fresh)
            out.append((*group, number, "".join(parts), loss, len(lead), len(lead) + len(fresh), n, n > budget))
            number += 1
            for x in fresh:
                past.append(x)
                while sum(y[2] for y in past) > history:
                    past.popleft()
                    if not past:
                        break
            fresh = []

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            names = ["conv_id", "block", "part", "window", "formatted", "loss", "n_repeated", "n_turns", "n_tokens", "over_budget"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        repeat: list[tuple] = []
        begun = 0
        encode = encoder(tokenizer)
        for batch in batches:
            rows = batch.to_pylist()
            # Each distinct turn is counted as it is rendered; no token crosses from one rendered turn to the next.
            said = list(dict.fromkeys((x["role"], x["text"]) for x in rows))
            size = dict(zip(said, map(len, encode(pa.array([render(*x)[0] for x in said], pa.string()))), strict=True))
            for row in rows:
                key = (row["conv_id"], row["block"], row["part"])
                new = key != group
                if new:
                    close()
                    group, system, past, repeat, total, begun, number = key, None, deque(), [], 0, 0, 0
                n = size[row["role"], row["text"]]
                if row["kind"] == LEAD:
                    system = (row["role"], row["text"], n, "system", 0)
                    continue
                leads = row["first"] and row["role"] == "system" and (new or row["kind"] == OLD)
                turn = (row["role"], row["text"], n, "first" if leads else "turn", total)
                total += n
                if row["kind"] == OLD:
                    past.append(turn)
                    while past and sum(y[2] for y in past) > history:
                        past.popleft()
                    continue
                base = system[2] if system and not (fresh and fresh[0][3] == "first") else 0
                if fresh and base + sum(y[2] for y in repeat) + total - begun > budget:
                    close()
                if not fresh:
                    begun = turn[4]
                    repeat = [x for x in past if x[3] != "first" or not system]
                    while repeat and base + sum(y[2] for y in repeat) + turn[2] > budget:
                        repeat = repeat[1:]
                if leads:
                    system = (row["role"], row["text"], n, "system", 0)
                fresh.append(turn)
                if len(out) >= 256:
                    yield ready()
        close()
        if out:
            yield ready()

    return work


#: What a row is to a block: the conversation's system turn, a turn of the history before, or a turn of its own.
LEAD, OLD, NEW = 0, 1, 2
_ORDER = ("turn", "role", "text")
_ROWS = ("conv_id", "block", "part", "kind", "first", *_ORDER)


def _same(*columns: str) -> Column:
    """Equality of columns with their namesakes that begin with an underscore; null equals null."""
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}") for c in columns))


def _split(turns: DataFrame, history: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that are one block, and of those of several, each with the rows that the block before hands on.

    A block is 512 turn numbers; one with far more rows, by repeated or null
    numbers, is cut by ranges of its rows' order. Only the conversations'
    names are counted; texts are moved for conversations of several blocks.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))).withColumn("part", F.lit(0))
    counts = stash(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    heavy = _named(counts.where(F.col("n") > HEAVY * BLOCK), "conv_id", "block")
    several = counts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("n")).where((F.col("blocks") > 1) | (F.col("n") > HEAVY * BLOCK))
    several = stash(_named(several, "conv_id"), "several")
    if several.isEmpty():
        drop(counts, several)
        return rows.withColumn("kind", F.lit(NEW)).withColumn("first", F.lit(True)).select(*_ROWS), None
    single = rows.join(several, _same("conv_id"), "left_anti")
    many = rows.join(several, _same("conv_id"), "left_semi")
    if not heavy.isEmpty():
        cuts = min(4 * slots(rows.sparkSession), 1 + counts.where(F.col("n") > HEAVY * BLOCK).agg(F.sum("n")).first()[0] // (HEAVY * BLOCK))
        large = many.join(heavy, _same("conv_id", "block"), "left_semi").withColumn("tie", F.monotonically_increasing_id())
        large = large.repartitionByRange(max(cuts, 2), "conv_id", "block", *_ORDER, "tie").withColumn("part", F.spark_partition_id())
        many = stash(many.join(heavy, _same("conv_id", "block"), "left_anti").union(large.select(*many.columns)), "turns")
    parts = many.groupBy("conv_id", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("conv_id").orderBy("block", "part")
    parts = stash(parts.select("conv_id", "block", "part", "n", F.row_number().over(along).alias("place"), F.lead("block").over(along).alias("next"), F.lead("part").over(along).alias("next_part")), "parts")
    own = many.join(_named(parts, "conv_id", "block", "part", "place"), _same("conv_id", "block", "part")).select(*many.columns, (F.col("_place") == 1).alias("first"))
    handing = _named(parts.where("next is not null"), "conv_id", "block", "part", "next", "next_part", "n", "place")
    ends = Window.partitionBy("conv_id", "block", "part").orderBy(*(F.desc(c) for c in _ORDER))
    # A turn has a token at least, so the history is among as many turns; what is over it is dropped where tokens are counted.
    old = many.withColumn("at", F.row_number().over(ends)).where(F.col("at") <= history).join(handing, _same("conv_id", "block", "part"))
    old = old.select("conv_id", F.col("_next").alias("block"), F.col("_next_part").alias("part"), F.lit(OLD).alias("kind"), ((F.col("_place") == 1) & (F.col("at") == F.col("_n"))).alias("first"), *_ORDER)
    lead = own.where("first").groupBy("conv_id").agg(F.min(F.struct(*_ORDER)).alias("lead")).where("lead.role = 'system'")
    lead = parts.where("place > 1").join(lead.select(F.col("conv_id").alias("_conv_id"), "lead"), _same("conv_id"))
    lead = lead.select("conv_id", "block", "part", F.lit(LEAD).alias("kind"), F.lit(False).alias("first"), "lead.*")
    return single.withColumn("kind", F.lit(NEW)).withColumn("first", F.lit(True)).select(*_ROWS), own.withColumn("kind", F.lit(NEW)).select(*_ROWS).union(old).union(lead)


def _format(rows: DataFrame, budget: int, history: int, tokenizer: str) -> DataFrame:
    """Windows; those of a block come together and in order."""
    dealt = rows.repartition("conv_id", "block", "part").sortWithinPartitions("conv_id", "block", "part", "kind", *_ORDER)
    return dealt.transform(arrow(_windows(budget, history, tokenizer), SCHEMA))


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, tokenizer: str = VOCABULARY) -> DataFrame:
    """Windows of whole turns of at most ``budget`` tokens.

    Tokens are those of the vocabulary file ``tokenizer`` in the rendered
    turns, so marks, roles and escapes count; ``n_tokens`` is what the
    vocabulary makes of ``formatted``.

    A window holds the conversation's leading system turn, up to ``history``
    tokens of the turns before, and new turns chosen greedily on prefix sums.
    Every turn is new in exactly one window. ``loss`` lists the code point
    spans of new assistant texts; repeated turns are never in it. A single
    turn that does not fit with the system turn is a window of its own, marked
    ``over_budget``. A conversation is formatted in blocks of 512 turn numbers
    (and parts of blocks, where repeated or null numbers make one large) that
    start with the history of the one before, so a long one does not have to
    fit in one task.

    Null role and text: empty. Null turn: before all others. Null conv_id: one
    conversation. Equal turns: ordered by role and text; repeated rows are
    turns of their own. Empty table: no rows. A text of any length is one
    turn. Other columns are not read.
    """
    single, many = _split(turns, history)
    out = _format(single, budget, history, tokenizer)
    return out if many is None else out.union(_format(many, budget, history, tokenizer))


def format_and_read(turns: DataFrame, budget: int = 2048, history: int = 256, tokenizer: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, read back from its windows: where they are made, if the conversation is one block, else by :func:`read_back`."""
    single, many = _split(turns, history)
    out = _format(single, budget, history, tokenizer).transform(arrow(_digest, DIGESTS))
    return out if many is None else out.union(read_back(_format(many, budget, history, tokenizer)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now: object = _digest
    n, turns, loss, chars, size, windows = 0, None, None, 0, 0, 0

    def done(rows: list) -> None:
        if turns is not None:
            rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows))

    rows: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != now:
                done(rows)
                now, n, turns, loss, chars, size, windows = row["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in parse(row["formatted"])[row["n_repeated"] :]:
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in row["loss"]:
                text = unescape(row["formatted"][span["start"] : span["end"]])
                loss.update(text.encode())
                chars += len(text)
            size += len(row["formatted"])
            windows += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    done(rows)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows alone. A digest is sequential, so one task streams a conversation; it holds one window at a time."""
    dealt = windows.select("conv_id", "block", "part", "window", "formatted", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part", "window")
    return dealt.transform(arrow(_digest, DIGESTS))
