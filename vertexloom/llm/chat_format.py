"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log holds events of conversations. `reconstruct` gathers each conversation's
events (map tasks pre-aggregate into arrays, so one row a task and conversation
is shuffled), sorts them by sequence and folds them into final messages:

* ``message``     starts a message with its text, or restates it
* ``delta``       appends a streamed piece
* ``edit``        replaces the text so far; later deltas append to it
* ``regenerate``  throws the text so far away and starts again with its own

Events of one message share ``message_key``; a null key is a message of its own.
The fold is linear: sorted events are cut where the key changes, and each message's
text is joined from its last reset on. Messages stand in the order of their first
event. `render` writes the template ``<|im_start|>role\\ntext<|im_end|>\\n`` as
segments with a loss flag; `loss_mask` gives the runs under the loss as places in
the formatted text, and `masked` reads them back from it. Control strings inside
roles and texts are escaped with a backslash, reversibly; `parse` reads the
turns back.

Defined cases: null role and null text count as empty; a null conversation id is
a conversation of its own; a null sequence number comes first; events of one message
with equal sequence numbers are ordered by column ``part`` where there is one, then role
and text, and messages by role, then text; a message's role is the last that is not empty;
repeated rows without a key stay as turns; an empty log gives no rows; other columns are
ignored. One conversation is one output row, as its digest needs its whole text,
so a single conversation must stay below Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds whose text replaces what the message held before.
RESETS = ("message", "edit", "regenerate")
#: Code points of the blocks that masked text is read from, and segments whose places are summed together.
BLOCK, RUN = 4096, 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of `escape`: each backslash starts a pair, read from the left."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.when(F.contains(role, F.lit("\\")), F.array_join(plain, "\\")).otherwise(role)


def _fold(events: Column) -> Column:
    """Events sorted by (key, seq, part) to messages, sorted by their first event."""
    n = F.size(events)

    def starts_one(i: Column) -> Column:
        key = F.get(events, i)["key"]
        return key.isNull() | ~F.coalesce(key == F.get(events, i - 1)["key"], F.lit(False))

    def message(part: Column) -> Column:
        resets = F.filter(F.sequence(F.lit(0), F.size(part) - 1), lambda k: F.get(part, k)["kind"].isin(*RESETS))
        said = F.slice(part, F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.size(part))
        roles = F.filter(F.transform(part, lambda e: e["role"]), lambda r: r != "")
        return F.struct(
            F.get(part, 0)["seq"].alias("first"),
            F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
            F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
        )

    def cut(starts: Column) -> Column:
        each = F.transform(starts, lambda s, j: F.slice(events, s + 1, F.coalesce(F.get(starts, j + 1), n) - s))
        return F.transform(each, message)

    return F.array_sort(let(F.filter(F.sequence(F.lit(0), n - 1), starts_one), cut))


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, seq, message_key, kind, role, text, and part if there is one) to one row a conversation: conv_id, messages array<role, text>."""
    event = F.struct(
        F.col("message_key").cast("string").alias("key"),
        F.col("seq").cast("bigint").alias("seq"),
        (F.col("part").cast("bigint") if "part" in log.columns else F.lit(0).cast("bigint")).alias("part"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
    )
    gathered = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    folded = F.transform(_fold(F.col("events")), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return gathered.select("conv_id", folded.alias("messages"))


def render(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds segments array<text, loss>; joined, their texts are the formatted conversation."""

    def turn(m: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), F.lit(False)),
            part(escape(m["text"]), m["role"].isin(*loss_roles)),
            part(F.lit(END + "\n"), F.lit(False)),
        )

    return conversations.withColumn("segments", F.flatten(F.transform("messages", turn)))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_mask(segments: Column) -> Column:
    """array<start, end>: places, in code points of the formatted text, of the segments under the loss."""

    def places(sizes: Column) -> Column:
        # sums within blocks, then of blocks: a growing array would be copied for every segment
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda b: F.slice(sizes, b * RUN + 1, F.lit(RUN)))
        whole = F.transform(blocks, _sum)
        return F.flatten(F.transform(blocks, lambda block, b: let(_sum(F.slice(whole, F.lit(1), b)), lambda before: F.transform(block, lambda _, i: before + _sum(F.slice(block, F.lit(1), i))))))

    def marked(starts: Column) -> Column:
        both = F.zip_with(segments, starts, lambda s, at: F.struct(at.alias("start"), (at + F.char_length(s["text"])).alias("end"), s["loss"].alias("loss")))
        return F.transform(F.filter(both, lambda m: m["loss"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    sizes = F.transform(segments, lambda s: F.char_length(s["text"]).cast("bigint"))
    return F.when(F.size(segments) > 0, let(let(sizes, places), marked)).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def masked(text: Column, mask: Column) -> Column:
    """The text under the mask, unescaped run by run. It is read in blocks, so that a run costs its own length and a block."""

    def read(blocks: Column) -> Column:
        def run(m: Column) -> Column:
            first = F.floor(m["start"] / BLOCK)
            some = F.slice(blocks, (first + 1).cast("int"), (F.floor((m["end"] - 1) / BLOCK) - first + 1).cast("int"))
            return unescape(F.substring(F.array_join(some, ""), (m["start"] - first * BLOCK + 1).cast("int"), (m["end"] - m["start"]).cast("int")))

        return F.array_join(F.transform(F.filter(mask, lambda m: m["end"] > m["start"]), run), "")

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), read)


def parse(text: Column) -> Column:
    """A formatted conversation to its turns, array<role, text>: no start mark can stand inside a turn."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)
