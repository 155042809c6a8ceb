"""Preference pairs from two versions of conversations: one prompt, two masked completions.

DataFrame functions only. Turns of both versions meet by their pair in one aggregation; the first turn
that isn't the same in both ends the common prefix, which array functions find. A conversation
is gathered because it is rendered: its text is one value of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered, and which role's words are learned.
OPEN, SHUT, LEARNED = "<|{}|>\n", "<|end|>\n", "assistant"


def _turns(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63)))
    return df.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), turn.alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(SHUT))


def _segments(turns: Column) -> Column:
    """Mask of a completion: runs of characters, learned or not, in order; a turn's end mark belongs to its words."""
    head = lambda t: F.struct((F.length(t["role"]) + 5).cast("long").alias("chars"), F.lit(False).alias("learn"))
    body = lambda t: F.struct((F.length(t["text"]) + len(SHUT)).cast("long").alias("chars"), (t["role"] == LEARNED).alias("learn"))
    return F.flatten(F.transform(turns, lambda t: F.array(head(t), body(t))))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a pair: the longest common turn prefix as prompt, and what follows it in each version.

    (pair, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask): a mask is an
    array of (chars, learn) runs that cover its completion; only assistant words and their end mark
    are learned, and the prompt never is. A pair that only one version has, or whose versions are
    equal, comes with an empty completion where nothing follows. Repeated equal rows of a
    version are one turn; different rows of one turn number are ordered by role and text and
    are common only if both versions have just these. A null turn number comes first, a null role
    or text is empty, and rows with a null pair are left out.
    """
    a, b = (_turns(df, pair_col, turn_col, role_col, text_col) for df in (chosen, rejected))
    turn = F.struct("turn", "role", "text")
    both = a.select("pair", turn.alias("c"), F.lit(None).cast(a.select(turn.alias("t")).schema["t"].dataType).alias("r"))
    both = both.unionByName(b.select("pair", F.lit(None).cast(both.schema["c"].dataType).alias("c"), turn.alias("r")))
    # Repeated rows are one, and nulls of the other side are left out.
    grouped = both.groupBy("pair").agg(F.sort_array(F.collect_set("c")).alias("c"), F.sort_array(F.collect_set("r")).alias("r"))
    differs = F.concat(F.array_except("c", "r"), F.array_except("r", "c"))
    grouped = grouped.withColumn("split", F.array_min(F.transform(differs, lambda t: t["turn"])))
    common = lambda t: F.col("split").isNull() | (t["turn"] < F.col("split"))
    parts = grouped.select("pair", F.filter("c", common).alias("p"), *[F.filter(x, lambda t: ~common(t)).alias(x) for x in ("c", "r")])
    text = lambda c: F.array_join(F.transform(c, _rendered), "")
    return parts.select(
        F.col("pair").alias(pair_col),
        F.size("p").cast("long").alias("n_prompt_turns"),
        text("p").alias("prompt"),
        text("c").alias("chosen"),
        text("r").alias("rejected"),
        _segments(F.col("c")).alias("chosen_mask"),
        _segments(F.col("r")).alias("rejected_mask"),
    )


def shortened_answers(turns: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A worse version of each conversation: it ends with its last assistant turn, cut to half of its characters. One without such a turn stays."""
    answer = F.col(role_col) == LEARNED
    last = F.max(F.when(answer, F.col(turn_col))).over(Window.partitionBy(pair_col))
    half = F.substring(F.col(text_col), F.lit(1), F.floor(F.length(text_col) / 2).cast("int"))
    found = turns.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(turn_col) <= F.col("__last")))
    return found.withColumn(text_col, F.when((F.col(turn_col) == F.col("__last")) & answer, half).otherwise(F.col(text_col))).drop("__last")
