"""Preference formatting of paired conversations, in DataFrame operations.

The chosen and the rejected conversation of a pair agree up to a first turn where they
differ. The common turns are rendered once as the prompt, the rest of either side as its
completion. Every message is a rendered row of its own, with the characters on which a loss
is taken, so that neither a conversation nor a turn has to fit in one row or task: a trainer
reads prompt + chosen and prompt + rejected in the order of turn, message and copy.

Defined results: turns go by their number, turns without one come last; the messages of a
turn go by role and text, and ``message`` is that place among the different messages of
either side; repeated messages stay, told apart by ``copy``; sides differ in a turn where
they have a message not equally often; a null role or text is empty; a pair of which one
side is missing has no common turns and ``complete`` is false; rows without pair_id are a
pair of their own each: one that both sides have is a prompt, others are a completion of
their side; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import stored
from fotolake.operators.ranking import number_rows

# Turns without number stand after all others.
LAST_TURN = (1 << 63) - 1
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
# Repeated rows are written so many at a time.
_REPEATS = 1 << 16


def preference_rows(
    chosen: DataFrame, rejected: DataFrame, train_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Rendered messages of pairs, from two tables of ``pair_id, turn, role, text``.

    Returns pair_id, part (prompt, chosen or rejected), turn, message, copy, text, n_chars,
    loss_start, loss_end (the span of ``text`` that is trained on, empty where masked),
    complete. A message of a completion is trained on if it has a train role: from the end
    of its header to its end.
    """
    every = _side(chosen, 0).unionByName(_side(rejected, 1))
    # Read for where the sides part, and for the texts.
    messages = stored(_counted(every.where("pair_id is not null")), "messages")
    pairs = messages.groupBy(F.col("pair_id").alias("_pair")).agg(
        F.min(F.when(F.col("n0") != F.col("n1"), F.col("turn"))).alias("fork"),
        (F.max(F.col("n0") > 0) & F.max(F.col("n1") > 0)).alias("complete"),
    )
    pairs = stored(pairs, "pairs")
    placed = number_rows(messages, ["pair_id", "turn"], ["role", "text"], "message")
    joined = placed.join(pairs, F.col("pair_id") == F.col("_pair")).drop("_pair")
    prompt = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    none = F.lit(0).cast("long")
    found = joined.select(
        "pair_id", "turn", "message", "role", "text", "complete",
        F.inline(
            _parts(
                F.when(prompt, F.col("n0")).otherwise(none),
                F.when(prompt, none).otherwise(F.col("n0")),
                F.when(prompt, none).otherwise(F.col("n1")),
            )
        ),
    )
    own = _counted(every.where("pair_id is null"))
    both = F.least("n0", "n1")
    own = own.select(
        "pair_id", "turn", F.lit(1).cast("long").alias("message"), "role", "text",
        F.inline(_parts(both, F.col("n0") - both, F.col("n1") - both)),
    ).withColumn("complete", F.col("part") == "prompt")
    alone = _copies(own).withColumn("copy", F.lit(1).cast("long"))
    return _rendered(_copies(found), train_roles).unionByName(_rendered(alone, train_roles))


def _counted(sides: DataFrame) -> DataFrame:
    """Different messages with their number on either side, combined before the shuffle."""
    return sides.groupBy("pair_id", "turn", "role", "text").agg(
        *(F.count(F.when(F.col("side") == i, F.lit(1))).alias(f"n{i}") for i in (0, 1))
    )


def _parts(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """The parts of a message with the number of its copies in each."""
    numbers = (("prompt", prompt), ("chosen", chosen), ("rejected", rejected))
    return F.array(*(F.struct(F.lit(part).alias("part"), n.alias("n")) for part, n in numbers))


def _copies(rows: DataFrame) -> DataFrame:
    """Every row ``n`` times, with its number as ``copy``."""
    step = F.lit(_REPEATS).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step))
    runs = rows.where("n > 0").withColumn("_start", starts)
    last = F.least(F.col("n") - F.col("_start"), step)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), last))
    return runs.withColumn("_i", copies).withColumn("copy", F.col("_start") + F.col("_i"))


def _rendered(rows: DataFrame, train_roles: tuple[str, ...]) -> DataFrame:
    """The result rows of ``pair_id, turn, message, copy, complete, part, role, text``."""
    header = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & F.col("role").isin(*train_roles)
    size = F.char_length("text")
    return (
        rows.withColumn("_header", F.length(header))
        .withColumn("text", F.concat(header, F.col("text"), F.lit(END)))
        .select(
            "pair_id",
            "part",
            F.when(F.col("turn") != LAST_TURN, F.col("turn")).alias("turn"),
            "message",
            "copy",
            "text",
            size.cast("long").alias("n_chars"),
            F.when(trained, F.col("_header")).otherwise(size).cast("long").alias("loss_start"),
            size.cast("long").alias("loss_end"),
            "complete",
        )
    )


def _side(rows: DataFrame, side: int) -> DataFrame:
    return rows.select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"),
        F.lit(side).alias("side"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from ``conv_id, turn, role, text``: each conversation, and itself with another end.

    The rejected side has the last turn of the neighbour (conv_id with its lowest bit
    flipped) in place of its own last turn; without a neighbour it ends one turn earlier.
    Rows without id are left as they are, on both sides.
    """
    own = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    place = F.coalesce("turn", F.lit(LAST_TURN))
    last = own.groupBy("pair_id").agg(
        F.max(F.struct(place.alias("place"), "role", "text")).alias("end")
    )
    ends = last.select("pair_id", F.col("end.place").alias("place")).where("pair_id is not null")
    other = last.select(
        F.expr("pair_id ^ 1").alias("pair_id"),
        F.col("end.role").alias("role"),
        F.col("end.text").alias("text"),
    ).where("pair_id is not null")
    kept = (
        own.join(ends.withColumnRenamed("pair_id", "_pair"), F.col("pair_id") == F.col("_pair"))
        .where(place < F.col("place"))
        .select("pair_id", "turn", "role", "text")
    )
    # Apart from the join, in which they would all meet in one task.
    kept = kept.unionByName(own.where("pair_id is null"))
    swapped = ends.join(other, "pair_id").select(
        "pair_id",
        F.when(F.col("place") != LAST_TURN, F.col("place")).alias("turn"),
        "role",
        "text",
    )
    return own, kept.unionByName(swapped)
