"""Chat formatting from an event log: fold messages, deltas, edits and regenerations, then render with a loss mask."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values of the template
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

#: kinds of events: a message opens a turn with its role and text; a delta adds text; an edit puts other text in its place;
#: a regeneration empties the turn for new deltas. An edit or a regeneration also ends what was logged before for later turns.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def log_of(turns: DataFrame) -> DataFrame:
    """The event log (conv_id, seq, turn, kind, role, text) of finished conversations (conv_id, turn, role, text).

    Every row is a message of its own, opened empty and filled by a delta; null texts are empty. Rows with equal turns come in
    the order of role and text, so repeated rows are repeated messages.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    both = F.array(
        F.struct((2 * F.col("n")).alias("seq"), F.lit(MESSAGE).alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct((2 * F.col("n") + 1).alias("seq"), F.lit(DELTA).alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
    )
    return rows.select("conv_id", F.col("n").alias("turn"), F.inline(both)).select("conv_id", "seq", "turn", "kind", "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log.

    Events are ordered by seq, equal seqs by kind, role and text. A turn begins at its last message, edit or regeneration and
    takes the deltas after it; one that has only deltas starts empty. What was logged for a turn before an edit or
    regeneration of an earlier turn is void, and a turn without any event left is gone. Null texts are empty, a null or missing
    role is an empty string; a null conv_id is a conversation like others.
    Only a conversation's marks pass through a window, whose running frame spills; texts are gathered per message.
    """
    branch = F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("seq"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("void_to", F.max(branch).over(earlier)).filter("void_to is null or seq > void_to")
    event = F.struct("seq", (F.col("kind") == DELTA).alias("adds"), "kind", "role", F.when(F.col("kind") == REGENERATE, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    turns = marked.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"), F.max(F.when(F.col("kind") != DELTA, F.col("seq"))).alias("begin"))
    used = F.filter("log", lambda e: F.col("begin").isNull() | (e["seq"] >= F.col("begin")))
    # of several beginnings with the same seq the last one counts
    last = F.aggregate(used, F.lit(""), lambda text, e: F.when(e["adds"], F.concat(text, e["text"])).otherwise(e["text"]))
    roles = F.filter(F.transform(F.filter("log", lambda e: e["kind"] == MESSAGE), lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), last.alias("text"))


def escaped(text: Column) -> Column:
    """No control string is left: every `<`, backslashes and `|` in a row gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _one_line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _lines_again(role: Column) -> Column:
    # a backslash pair first becomes a character that the role cannot hold in escaped form
    return F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("\\\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\\n"), F.lit("\\"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to): the rendered message and the code points of it under the loss mask.

    The rows of a conversation in the order of turn are its training text; a row at a time, so that no conversation has to fit
    in memory. The mask covers the text of assistant messages, neither marks nor roles.
    """
    head = F.concat(F.lit(START), escaped(_one_line(F.col("role"))), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    trained = F.col("role") == TRAINED_ROLE
    begin = F.length("head").cast("long")
    return rows.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(END + "\n")).alias("formatted"), F.when(trained, begin).otherwise(F.lit(0)).alias("loss_from"),
        F.when(trained, begin + F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_to"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """Messages again, from `render`: (conv_id, turn, role, text, loss_text, formatted_chars)."""
    whole = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    return rendered.select(
        "conv_id", "turn", _lines_again(unescaped(F.regexp_extract("formatted", whole, 1))).alias("role"), unescaped(F.regexp_extract("formatted", whole, 2)).alias("text"),
        unescaped(F.substring(F.col("formatted"), (F.col("loss_from") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int"))).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation over its messages in order; each task keeps only two running hashes.

    A hash of ordered texts is a chain, so one conversation is read by one task, but never held by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv: int | None = None
        state: list | None = None

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, length = state
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for key, role, text, loss_text, length in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if state is None or key != conv:
                    close()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss_text)
                state[3].update(loss_text.encode())
                state[4] += length
            if rows:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.select("conv_id", "role", "text", "loss_text", "formatted_chars").mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in DIGESTS.split(", ")])
