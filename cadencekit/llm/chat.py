"""Conversations as training texts: budgeted windows of whole turns, reversible markers and a loss mask.

A turn is written ``### role: text</turn>`` and a line end; backslashes, ``###`` and ``</turn>`` inside a text (also the
colon inside a role) get a backslash before them, so reading back gives every role and text exactly.

Prefix sums of the turns' tokens choose the windows: ``room`` tokens a window are new (the budget less the system
turn and the history), the sums are cut into cells of that size, and the turns that lie inside one cell are a window.  The
turn across a cell's end joins them where it fits, else it is a window of its own; only a turn that is itself longer than
the room makes a window exceed the budget.  Each later window begins with the system turn (a first turn with
that role) and the last turns before it, of at most ``history`` tokens and not from further back than the cell before;
repeated turns are masked, so each target text is under the loss mask once.  Nothing depends on the window before, so
a conversation of any length is cut by many tasks at once.

Null texts and roles are empty, a null conversation id is a conversation, repeated turn numbers are ordered by role and
hash of the text, very long texts stay whole, an empty table gives no rows.  Columns are taken by name, others don't count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.llm.common import WORD, record_batches
from cadencekit.session import materialise

BEGIN, COLON, END, LINE = "### ", ": ", "</turn>", "\n"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
WINDOW = "conv_id {}, window long, first_index long, n_repeated int, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def escaped(text: Column, *more: str) -> Column:
    """The text with a backslash before each control string (and each of ``more``); null as empty."""
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in (BEGIN.strip(), END, *more):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    found, at = [], 0
    while at < len(text):
        turn = TURN.match(text, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


def windows(turns: DataFrame, budget: int = 512, history: int = 128, targets: Sequence[str] = ("assistant",),
            conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted windows: ``conv_id``, ``window`` (any rising numbers), ``first_index`` (place of the first new turn),
    ``n_repeated`` (turns at the front that came before), ``n_tokens``, ``text`` and ``loss``, the spans of
    code points (end exclusive) under the loss mask.  A token is a word of the formatted turn."""
    kind = dict(turns.dtypes)[conv]
    spoken = F.coalesce(F.col(role).cast("string"), F.lit(""))
    head = F.concat(F.lit(BEGIN), escaped(spoken, ":"), F.lit(COLON))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spoken.alias("role"), head.alias("head"), escaped(F.col(text)).alias("body"))
    words = F.regexp_count(F.concat("head", "body", F.lit(END)), F.lit(WORD)).cast("long")
    placed = _placed(rows.withColumn("tokens", words), budget - history)
    named = ["conv", "cell", "index", "start", "tokens", "role", "head", "body", "new", "whole", "system", "system_tokens", "room"]
    own = placed.withColumn("new", F.lit(True)).select(*named)
    near = placed.where((F.col("index") > 0) | (F.col("system_tokens") == 0)).where(F.col("start") >= (F.col("cell") + 1) * F.col("room") - history)
    before = near.withColumn("cell", F.col("cell") + 1).withColumns({"new": F.lit(False), "system": F.lit(None).cast("string")}).select(*named)
    met = own.unionByName(before).repartition("conv", "cell").sortWithinPartitions("conv", "cell", "index")
    schema = WINDOW.format(kind)
    fields = pa.schema([("conv_id", pa.string()), ("window", pa.int64()), ("first_index", pa.int64()), ("n_repeated", pa.int32()),
                        ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        kinds, rows = _rows(batches)
        out = (window for (conv_id, cell), part in groupby(rows, lambda r: (r["conv"], r["cell"]))
               for window in assembled(conv_id, cell, list(part), history, targets))
        if kinds is not None:
            yield from record_batches(out, fields.set(0, pa.field("conv_id", kinds.field("conv").type)), 1000)

    return met.mapInArrow(run, schema)


def _rows(batches) -> tuple[pa.Schema | None, Iterator[dict]]:
    """The schema of the batches and their rows one by one."""
    batches = iter(batches)
    first = next(batches, None)

    def rows():
        batch = first
        while batch is not None:
            for at in range(0, batch.num_rows, 1000):
                yield from batch.slice(at, 1000).to_pylist()
            batch = next(batches, None)

    return (first.schema if first is not None else None), rows()


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """Turns with their ``index`` in the conversation, ``start`` (tokens before them, without the system turn), ``room``,
    ``cell``, ``whole`` (inside one cell) and, on the first row of a later cell, the ``system`` turn to repeat.

    Turns are dealt out by range; one row for each range and conversation gives the sums before it.
    """
    # A written table, so the last sort column is the same on every attempt.
    rows = materialise(rows).withColumn("tie", F.monotonically_increasing_id())
    by = ["conv", "turn", "role", "hash", "tie"]
    dealt = rows.withColumn("hash", F.xxhash64("body")).repartitionByRange(*by).sortWithinPartitions(*by).drop("hash", "tie")
    at = F.monotonically_increasing_id()
    dealt = materialise(dealt.withColumn("at", at).withColumn("part", F.shiftright("at", 33)))
    inside = Window.partitionBy("part", "conv").orderBy("at")
    leads = F.when(F.col("role") == "system", F.struct("tokens", F.concat("head", "body").alias("text")))
    sums = dealt.groupBy("part", "conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"), F.min_by(leads, "at").alias("lead"))
    along = Window.partitionBy("conv").orderBy("part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("part").alias("_part"), F.col("conv").alias("_conv"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_sum"), F.first("lead").over(along).alias("_lead"))
    joined = dealt.join(sums, (F.col("part") == F.col("_part")) & F.col("conv").eqNullSafe(F.col("_conv")))
    joined = joined.withColumn("index", F.col("at") + F.col("_shift")).withColumn("system_tokens", F.coalesce("_lead.tokens", F.lit(0)))
    before = F.sum("tokens").over(inside) - F.col("tokens") + F.col("_sum") - F.col("system_tokens")
    joined = joined.withColumn("start", F.greatest(before, F.lit(0))).withColumn("room", F.greatest(F.lit(most) - F.col("system_tokens"), F.lit(1)))
    led = (F.col("index") == 0) & (F.col("system_tokens") > 0)
    last = F.floor((F.col("start") + F.col("tokens") - 1) / F.col("room"))
    joined = joined.withColumn("cell", F.when(led, 0).otherwise(F.floor(F.col("start") / F.col("room"))))
    joined = joined.withColumn("whole", led | (last == F.col("cell")))
    opens = (F.col("cell") > 0) & ~F.coalesce(F.lag("cell").over(inside) == F.col("cell"), F.lit(False))
    # A cell's last turn can begin a window of its own, also in the first cell.
    again = opens | ~F.col("whole")
    return joined.withColumn("system", F.when(again & (F.col("index") > 0), F.col("_lead.text")))


def assembled(conv_id, cell: int, rows: list[dict], history: int, targets: Sequence[str]) -> Iterator[tuple]:
    """The one or two windows of a cell from its turns and those before them, in order."""
    new = [r for r in rows if r["new"]]
    if not new:
        return
    system = next((r["system"] for r in rows if r["system"]), None)
    led = new[0] if new[0]["index"] == 0 and new[0]["system_tokens"] else None
    lasts = [r for r in new if not r["whole"]]
    inner = [r for r in new if r["whole"]]
    fits = sum(r["tokens"] for r in new if r is not led) <= new[0]["room"]
    for number, part in enumerate([new] if fits or not lasts or not [r for r in inner if r is not led] else [inner, lasts]):
        start = next((r["start"] for r in part if r is not led), 0)
        past = [r for r in rows if r["index"] < part[0]["index"] and r is not led and start - r["start"] <= history]
        begins = cell == number == 0
        shown = [(r["head"] + r["body"], r["tokens"]) for r in past]
        if system and not begins:
            shown.insert(0, (system, new[0]["system_tokens"]))
        text = "".join(x + END + LINE for x, _ in shown)
        tokens, loss, pieces, at = sum(n for _, n in shown), [], [text], len(text)
        for r in part:
            pieces.append(r["head"] + r["body"] + END + LINE)
            if r["role"] in targets:
                loss.append({"start": at + len(r["head"]), "end": at + len(r["head"]) + len(r["body"])})
            at, tokens = at + len(pieces[-1]), tokens + r["tokens"]
        yield conv_id, 2 * cell + number, part[0]["index"], len(shown), tokens, "".join(pieces), loss


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: ``n_turns``, ``turns_sha256`` of all roles and texts, ``loss_chars`` and
    ``loss_sha256`` of the text under the mask, and ``formatted_chars``.

    A digest of a whole conversation has to take its windows one after the other: they pass by in a sorted stream, and
    only the digest's state is held.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches):
        kinds, rows = _rows(batches)
        if kinds is None:
            return
        fields = [pa.field("conv_id", kinds.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
        yield from record_batches((read(conv_id, part) for conv_id, part in groupby(rows, lambda r: r["conv_id"])), pa.schema(fields))

    chosen = formatted.select("conv_id", "window", "n_repeated", "text", "loss")
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)


def read(conv_id, parts: Iterator[dict]) -> tuple:
    """One conversation's digests from its windows in order."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = formatted_chars = n_windows = 0
    for window in parts:
        for role, text in parsed(window["text"])[window["n_repeated"]:]:
            turns.update(f"{role}\n{text}\n".encode())
            n_turns += 1
        for span in window["loss"]:
            under = unescaped(window["text"][span["start"]:span["end"]])
            loss.update(under.encode())
            loss_chars += len(under)
        formatted_chars, n_windows = formatted_chars + len(window["text"]), n_windows + 1
    return conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars, n_windows
