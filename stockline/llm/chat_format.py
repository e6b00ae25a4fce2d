"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are its context, its text alone is trainable. A
conversation that does not end with an assistant turn has one more example without a target, so that every turn is in
some example. Turns are written as <|im_start|>role<|im_sep|>text<|im_end|> and a line break. In roles and texts, a
backslash becomes two and <| becomes <\\|, so control strings of a text stay text, and one pass over the escapes gives
the text back.

Null text or role: empty. Turns are ordered by turn (nulls first), then role and text; repeated rows are repeated turns.
Null conv_id: one conversation. Other columns are ignored. A conversation is one row while its examples are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _heads(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END)))


def examples(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """conv_id, example (from 0), prompt, target (null: nothing to train), rest: formatted text in three parts.

    prompt + target + rest is the example; the target alone is under the loss mask. All parts are escaped; rest closes
    the target's turn.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    coded = F.transform(
        "turns",
        lambda t: F.struct(
            escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == target_role).alias("aim")
        ),
    )
    grouped = grouped.select("conv_id", coded.alias("turns"))
    grouped = grouped.select("conv_id", "turns", _heads(F.col("turns")).alias("written"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["aim"])
    # A closing example without target, one past the last turn, unless the last turn is a target.
    past = F.when(F.element_at("turns", -1)["aim"], F.array().cast("array<int>")).otherwise(
        F.array(F.size("turns") + 1)
    )
    spread = grouped.select("conv_id", "turns", "written", F.posexplode(F.concat(ends, past)).alias("example", "at"))
    target = F.get(F.col("turns"), F.col("at") - 1)
    before = F.array_join(F.slice("written", F.lit(1), F.col("at") - 1), "")
    head = F.when(target.isNotNull(), F.concat(F.lit(START), target["role"], F.lit(SEP))).otherwise(F.lit(""))
    return spread.select(
        "conv_id", "example", F.concat(before, head).alias("prompt"), target["text"].alias("target"),
        F.when(target.isNotNull(), F.lit(END)).otherwise(F.lit("")).alias("rest"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
            unescaped(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, its trainable text and the size of all its examples."""
    whole = F.concat("prompt", F.coalesce("target", F.lit("")), "rest")
    # The longest example is the last and holds every turn.
    last = F.max_by(whole, "example")
    aims = F.sort_array(
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", unescaped(F.col("target")).alias("text"))))
    )
    per = formatted.groupBy("conv_id").agg(
        turns_of(last).alias("turns"), F.array_join(F.transform(aims, lambda a: a["text"]), "").alias("loss"),
        F.sum(F.length(whole)).alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
