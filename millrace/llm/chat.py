"""Preference formatting of chosen and rejected conversations.

A pair's longest common prefix of turns is rendered once, as the prompt; the turns after it are rendered as the two
completions, each with the spans of code points that a loss counts (text and end mark of assistant turns). All of it is built-in array functions.

A turn is rendered ``<|role|>\\n`` text ``<|end|>\\n``. Spans are ``start-end`` of the completion, joined by commas.

Defined cases: null roles and texts are empty; turns are ordered by number, then role, then text (null numbers first), and
repeated turns stay; conversations without a differing turn have equal, empty completions; each turn without a conversation id is a conversation of its own;
texts that hold a mark such as ``<|end|>`` are rendered as they are, not escaped (spans tell what counts);
an empty table gives no rows; other columns are ignored.

Scale: one shuffle, by conversation; a group is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
END = "<|end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from rows ``(conv_id, turn, role, text)``."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(one), lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return turns.withColumn("_alone", alone).groupBy("conv_id", "_alone").agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).drop("_alone")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns at the start are equal in both."""
    n = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~(F.get(a, i).eqNullSafe(F.get(b, i))))
    return F.array_min(differing)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """``start-end`` of what counts in ``rendered(turns)``: one pass that carries the place and the spans so far."""
    fixed = len("<||>\n") + len(END + "\n")
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(t["role"]) + F.length(t["text"]) + fixed
        span = F.concat_ws("-", s["at"] + F.length(t["role"]) + len("<||>\n"), end - 1)
        joined = F.when(s["spans"] == "", span).otherwise(F.concat_ws(",", s["spans"], span))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", joined).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, none, step)["spans"]


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", carry: tuple[str, ...] = ()) -> DataFrame:
    """Prompt, completions and their loss spans of each row of ``pairs``; ``chosen`` and ``rejected`` are arrays of (role, text)."""
    a, b = F.coalesce(F.col(chosen), F.array().cast(TURN)), F.coalesce(F.col(rejected), F.array().cast(TURN))
    cut = pairs.select(*carry, a.alias("a"), b.alias("b")).withColumn("prompt_turns", common_turns(F.col("a"), F.col("b")))
    rest = lambda x: F.slice(F.col(x), F.col("prompt_turns") + 1, F.size(x))
    parts = cut.select(*carry, "prompt_turns", F.slice("a", F.lit(1), F.col("prompt_turns")).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    return parts.select(
        *carry, "prompt_turns", rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"), loss_spans(F.col("a")).alias("chosen_loss"),
        rendered(F.col("b")).alias("rejected"), loss_spans(F.col("b")).alias("rejected_loss"),
    )


def shortened_replies(convs: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: the rejected one's last assistant turn is cut to the first half of its code points."""
    turns = F.col("turns")
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))
    other = F.transform(turns, lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), half(t).alias("text"))).otherwise(t))
    return convs.withColumn("last", F.coalesce(last, F.lit(-1))).select("conv_id", turns.alias("chosen"), other.alias("rejected"))
