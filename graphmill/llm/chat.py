"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events, ordered by `seq`, each of one message:

    message     a whole message                           (role, text)
    start       opens message `message_id`                (role)
    delta       adds text to it
    edit        puts a text in place of what it has, and a role if one is given
    regenerate  empties it; later deltas fill it again
    delete      takes it out; later events open it anew

`fold` deals the events by conversation and message and puts those of a message in
order of seq.  What follows its last delete counts: of that, the last event that sets
the whole text (message, edit, regenerate) and the deltas after it make the text, and
the first event gives the message its place.  Events of kind `message` without a
message_id are messages of their own.  `render` writes a message as one segment

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and a conversation is its segments in order.  In texts and roles a backslash is
doubled and `<|` becomes `<\\|`, and in roles a line end becomes `\\n`, so the control
strings stand only where the template puts them and the text can be read back.  The
loss mask is the escaped text of each assistant message.

A conversation is never gathered: events are dealt by conversation and message, so a
task holds the events of a message at most, which are its text; segments are sorted
within partitions by conversation and position, and `read_back` passes over them as a
stream with one running digest for a conversation.

Defined cases
    A null text is empty, a null role is an empty role.  Events with equal seq have
    the order of kind, role and text; messages with equal seq that of role and text.
    A message with no text is rendered empty; a deleted one isn't rendered.  Unknown
    kinds are ignored.  Rows with a null conversation id are one conversation of
    their own; so are events with a null message_id, whole messages aside, one
    message.  Deltas before any start open the message.  Repeated rows are events
    each.  Columns besides those named aren't read.  No events, no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.textarrays import tidy


KINDS = ("message", "start", "delta", "edit", "regenerate", "delete")
OPEN, CLOSE, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def fold(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of the final messages of events (conv_id, seq, kind, message_id, role, text)."""
    events = events.select("conv_id", "seq", "kind", "message_id", "role", F.coalesce("text", F.lit("")).alias("text")).where(F.col("kind").isin(*KINDS))
    own = (F.col("kind") == "message") & F.col("message_id").isNull()
    whole = events.where(own).select("conv_id", "seq", "role", "text")
    log = events.where(~own).groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    last = lambda name, *kinds: F.coalesce(F.array_max(F.transform(name, lambda e, i: F.when(e["kind"].isin(*kinds), i + 1))), F.lit(0))
    after = lambda name, at: F.slice(name, at + 1, F.size(name))
    log = log.withColumn("log", after("log", last("log", "delete"))).where(F.size("log") > 0)
    log = log.withColumn("_set", last("log", "message", "edit", "regenerate"))
    base = F.when(F.col("_set") > 0, F.element_at("log", F.greatest("_set", F.lit(1))))
    deltas = F.filter(after("log", F.col("_set")), lambda e: e["kind"] == "delta")
    text = F.concat(F.when(base["kind"].isin("message", "edit"), base["text"]).otherwise(""), F.array_join(F.transform(deltas, lambda e: e["text"]), ""))
    roles = F.filter("log", lambda e: e["role"].isNotNull() & e["kind"].isin("message", "start", "edit"))
    role = F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"])
    return whole.unionByName(log.select("conv_id", F.element_at("log", 1)["seq"].alias("seq"), role.alias("role"), text.alias("text")))


def streamed(rows: DataFrame) -> DataFrame:
    """The log of a chat service in which the messages of rows (conv_id, turn, role, text) came to be, for fold().

    A hash of each row's conversation, turn and text chooses how: in two deltas; with a first answer thrown away and
    regenerated; with a text that was edited; deleted and written again.  seq is (turn, step).  Equal rows are messages
    each: they are counted before they are dealt out, and then have a number.
    """
    rows = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text").count()
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    event = lambda kind, role=None, body=None: F.struct(F.lit(kind).alias("kind"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), (F.lit(None).cast("string") if body is None else body).alias("text"))
    start, first, second = event("start", True), event("delta", None, F.substring(text, 1, half)), event("delta", None, F.substring(text, half + 1, F.length(text)))
    ways = [
        F.array(start, first, second),
        F.array(start, second, event("regenerate"), first, second),
        F.array(start, first, event("edit", None, text)),
        F.array(start, second, event("delete"), start, first, second),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(len(ways)))
    chosen = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    named = rows.withColumn("_copy", copy).withColumn("message_id", F.concat_ws("-", "turn", F.xxhash64("role", "text"), "_copy"))
    steps = named.select("conv_id", "turn", "message_id", F.posexplode(chosen).alias("step", "event"))
    return steps.select("conv_id", F.struct("turn", "step").alias("seq"), "event.kind", "message_id", "event.role", "event.text")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def render(messages: DataFrame) -> DataFrame:
    """Segments of the messages: conv_id, seq, segment, loss_start, loss_length (code points within the segment; null without loss).

    Rows of a conversation are in one partition, in order.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = escape(F.coalesce("text", F.lit("")))
    own = messages.select("conv_id", "seq", role.alias("_role"), text.alias("_text"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "_role", "_text")
    loss = F.col("_role") == LOSS_ROLE
    start = F.length("_role") + F.lit(len(OPEN) + 1)
    return own.select("conv_id", "seq", F.concat(F.lit(OPEN), "_role", F.lit("\n"), "_text", F.lit(CLOSE)).alias("segment"), F.when(loss, start).alias("loss_start"), F.when(loss, F.length("_text")).alias("loss_length"))


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id, formatted: whole conversations as one string, for callers whose conversations fit in one."""
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "segment"))), lambda s: s["segment"]), "").alias("formatted"))


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, segment: str, loss_start, loss_length) -> None:
        body = segment.removeprefix(OPEN).removesuffix(CLOSE)
        role, _, text = body.partition("\n")
        role = _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)
        self.turns.update(f"{role}\n{unescape(text)}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(segment)
        if loss_start is not None:
            learned = unescape(segment[loss_start : loss_start + loss_length])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text holds when it is parsed again; segments as render() gives them."""

    kind = segments.schema["conv_id"].dataType.simpleString()
    rest = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches):
        own, out, schema = None, [], None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *rest])
            for conv_id, segment, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length"))):
                if own is None or own.conv_id != conv_id:
                    if own is not None:
                        out.append(own.row())
                    own = _Digest(conv_id)
                own.add(segment, start, length)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS, r)) for r in out], schema)
                out = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS, own.row()))], schema)

    return segments.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_log(events: DataFrame) -> DataFrame:
    return render(fold(events))
