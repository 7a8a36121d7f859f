"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what
follows on either side is a completion with the spans that count for the
loss. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turns: Column) -> Column:
    """Turns (role, text) as one string."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), ""
    )


def loss_spans(turns: Column, trained: str) -> Column:
    """Code point spans (start, end) of the text and end mark of each ``trained`` turn."""
    extra = len(START) + len(MIDDLE) + len(END)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + len(START) + len(MIDDLE) + F.char_length(t["role"])
        end = state["at"] + F.lit(extra).cast("long") + F.char_length(t["role"]) + F.char_length(t["text"])
        own = F.array(F.struct(begin.cast("long").alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(t["role"] == trained, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans")
        )

    return F.aggregate(turns, zero, add, lambda s: s["spans"])


def conversations(turns: DataFrame, key: str, turn_col: str, role_col: str, text_col: str, name: str) -> DataFrame:
    """(key, turns): each conversation's turns in order, as (role, text)."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_list(row))
    return turns.groupBy(F.col(key).alias("key")).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)
    )


def format_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    key: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: str = "assistant",
    keep_chosen: bool = False,
) -> DataFrame:
    """A row per pair that has both sides: prompt and two masked completions.

    ``keep_chosen``: a pair that has a chosen side alone keeps its row too; its
    rejected side has no turns.

    ``chosen`` and ``rejected`` hold a row per turn (key, turn, role, text).
    Columns: key, ``n_prompt`` (turns both sides begin with), ``prompt``
    (those, rendered once), ``chosen`` and ``rejected`` (the rest of each
    side, rendered), ``chosen_spans`` and ``rejected_spans`` (code points of
    the completion that count for the loss: text and end mark of each
    ``trained`` turn; the prompt never counts) and ``same`` (the sides are
    equal, so both completions are empty).

    Turns are ordered by turn (nulls first), ties by role, then text; rows that
    repeat are turns of their own. Null roles and texts are ''. Null keys are
    one pair like any other. Empty tables give an empty result; other columns
    are ignored. A pair is one output row, so a conversation has to fit one.
    """
    a = conversations(chosen, key, turn_col, role_col, text_col, "a")
    b = conversations(rejected, key, turn_col, role_col, text_col, "b").withColumnRenamed("key", "other")
    both = a.join(b, F.col("key").eqNullSafe(F.col("other")), "left" if keep_chosen else "inner")
    if keep_chosen:
        both = both.withColumn("b", F.coalesce("b", F.array().cast(b.schema["b"].dataType)))
    common = F.least(F.size("a"), F.size("b"))
    differs = F.filter(
        F.sequence(F.lit(1), F.greatest(common, F.lit(1))), lambda i: ~F.get("a", i - 1).eqNullSafe(F.get("b", i - 1))
    )
    lcp = F.coalesce(F.get(differs, F.lit(0)) - 1, common)
    cut = both.withColumn("n", lcp)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    parts = cut.select("key", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return parts.select(
        F.col("key").alias(key),
        F.col("n").cast("long").alias("n_prompt"),
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        loss_spans(F.col("a"), trained).alias("chosen_spans"),
        loss_spans(F.col("b"), trained).alias("rejected_spans"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("same"),
    )


def swapped_answers(
    turns: DataFrame, key: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """Rejected sides for a table without any: the last answer comes from a neighbour.

    Conversations 2k and 2k + 1 are neighbours. A conversation's last
    ``trained`` turn gets the text of its neighbour's, and is left out if the
    neighbour has none; conversations without such a turn stay as they are.
    Null keys have no neighbour.
    """
    k, t = F.col(key).alias("key"), F.col(turn_col).alias("turn")
    plain = turns.select(
        k, t, F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    last = (
        plain.where((F.col("role") == trained) & F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    swap = last.select((F.col("key").bitwiseXOR(F.lit(1))).alias("from"), F.col("last.text").alias("swap"))
    marked = last.join(swap, F.col("key") == F.col("from"), "left").select(F.col("key").alias("own"), "last", "swap")
    joined = plain.join(marked, F.col("key") == F.col("own"), "left")
    is_last = F.coalesce(
        (F.col("role") == trained) & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text")), F.lit(False)
    )
    return joined.where(~(is_last & F.col("swap").isNull())).select(
        F.col("key").alias(key),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.when(is_last, F.col("swap")).otherwise(F.col("text")).alias(text_col),
    )
