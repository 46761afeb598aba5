"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Control strings of this and other common chat templates (fixed values); none survives inside a text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_SPLIT = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes, then puts ``\\-`` behind the first character of every control string."""
    return _SPLIT.sub(lambda m: m.group() + "\\-", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: {"-": "", "n": "\n"}.get(m.group(1), m.group(1)), text)


def render(turns: list[tuple[str, str]], train_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it under the loss mask (escaped texts of ``train_roles``)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role in train_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, f"{CLOSE}\n")
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from a formatted conversation."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def fold(log: list[tuple]) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of the final messages of one conversation's sorted log of
    (turn, seq, is_delta, role, text)."""
    out: list[tuple[int | None, str, str]] = []
    opened = False  # whether the last message may still be changed
    for turn, seq, delta, role, text in log:
        if seq is None:
            out.append((turn, role or "", text or ""))
            opened = False
        elif opened and out[-1][0] == turn:
            _, last, before = out[-1]
            out[-1] = (turn, last if role is None else role, before + (text or "") if delta else text or "")
        else:
            out.append((turn, role or "", text or ""))
            opened = True
    return out


def _logs(events: DataFrame) -> DataFrame:
    """(conv_id, log): each conversation's events in one row, in one shuffle."""
    e = events.select("conv_id", "turn", "seq", F.coalesce(F.col("kind") == "delta", F.lit(False)).alias("d"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return e.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "seq", "d", "role", "text"))).alias("log"))


def _messages(log) -> list[tuple[int | None, str, str]]:
    return fold([(e["turn"], e["seq"], e["d"], e["role"], e["text"]) for e in log])


def _mapped(rows: DataFrame, run, fields: str) -> DataFrame:
    """``mapInPandas`` that carries conv_id as text, as pandas would turn ids beside a null into floats."""
    kind = rows.schema["conv_id"].dataType
    out = rows.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, f"conv_id string, {fields}")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) from a log of events (conv_id, seq, kind, turn, role, text).

    Within a turn the last ``message``, ``edit`` or ``regenerate`` by seq starts the text anew
    and the ``delta`` rows after it are appended in order; the role is the last one given.  A
    turn with deltas alone is their concatenation.  An event without a seq is a message of its
    own.  Rows of equal seq fold in the order kind (resets first), role, text, so a rerun gives
    the same text.  Null text is empty; an unknown or null kind counts as ``message``.
    """

    def run(batches):
        for part in batches:
            rows = [(conv, *m) for conv, log in zip(part["conv_id"], part["log"]) for m in _messages(log)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"], dtype=object)

    return _mapped(_logs(events), run, "turn long, role string, text string")


def message_events(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as events without a seq: rows that repeat a
    (conv_id, turn) stay apart, in the order of role and text."""
    return rows.select("conv_id", F.lit(None).cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text")


#: Code points of one streamed delta.
DELTA = 512


def event_log(rows: DataFrame, streamed_roles=("assistant",)) -> DataFrame:
    """The log that a chat server writes while the conversations of ``rows`` (conv_id, turn, role, text)
    take place, to be folded back into them.

    Messages are numbered within their conversation by turn (null first), role and text, so rows
    that repeat a turn stay messages of their own.  A streamed message starts empty and grows by
    deltas of DELTA code points; every other one of them was cut off after its first delta and
    regenerated.  Any other message was first sent as its first half, where it has one, and edited.
    ``seq`` runs through the conversation.  Null text is empty; a null role is a role of its own.
    """
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    numbered = numbered.withColumn("n", F.row_number().over(w).cast("long") - 1)

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    size = F.length("text")
    pieces = F.ceil(size / DELTA).cast("int")
    deltas = F.when(size > 0, F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: event("delta", F.substr("text", i * DELTA + 1, F.lit(DELTA))))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    begun = F.array(event("message", F.lit("")))
    again = F.concat(begun, F.slice(deltas, 1, 1), F.array(event("regenerate", F.lit(""))), deltas)
    streamed = F.when(F.col("n") % 4 == 3, again).otherwise(F.concat(begun, deltas))
    edited = F.array(event("message", F.substr("text", F.lit(1), F.floor(size / 2).cast("int"))), event("edit", F.col("text")))
    events = F.when(F.col("role").isin(*streamed_roles), streamed).otherwise(F.when(size > 1, edited).otherwise(F.array(event("message", F.col("text")))))
    each = numbered.select("conv_id", "n", "role", F.posexplode(events).alias("i", "e"))
    seq = F.col("n") * F.lit(1 << 31) + F.col("i")  # a message has fewer events than a string has code points
    return each.select("conv_id", seq.alias("seq"), F.col("e.kind").alias("kind"), F.col("n").alias("turn"), "role", F.col("e.text").alias("text"))


def format_conversations(events: DataFrame, train_roles=("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    Turns run by turn number (null first).  A conversation's text has to meet in one row, as its
    result is one text; nothing larger than one conversation does, and the log is shuffled once.
    An empty log gives no rows; repeated rows of a log repeat what they say; other columns, of any
    name, are ignored; texts are kept whole at any length.
    """

    def run(batches):
        for part in batches:
            made = [render([m[1:] for m in _messages(log)], train_roles) for log in part["log"]]
            yield pd.DataFrame({"conv_id": part["conv_id"], "formatted": [m[0] for m in made], "loss_spans": [[{"start": a, "end": b} for a, b in m[1]] for m in made]})

    return _mapped(_logs(events), run, "formatted string, loss_spans array<struct<start:long,end:long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted texts alone: turns, loss mask and lengths."""

    def run(batches):
        for part in batches:
            rows = []
            for conv, text, spans in zip(part["conv_id"], part["formatted"], part["loss_spans"]):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return _mapped(formatted, run, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
