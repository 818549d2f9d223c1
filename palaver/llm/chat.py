"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens lay a conversation on a line that is ruled every ``budget`` tokens. Turns within one cell
form a window; a turn across a rule is a window of its own. So windows are whole turns, at most the budget or one turn
large, and a turn's window follows from two numbers. Each window starts with the conversation's system turn and repeats
the turns before it that fit into ``history`` tokens; only assistant texts that are new in a window carry loss.
``&`` and ``<`` inside roles and texts are written as entities, so no text can form a control string.

Turns are ordered by (turn, role, text), nulls first. Null roles and texts are empty. Repeated rows are repeated turns.
Rows without a conversation id form one conversation. The system turn is the first turn, if its role is ``system``. An
empty table gives no rows. Prefix sums are taken in two levels, so a crowded conversation is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window's new turns, of its repeated ones, and turn numbers summed in one task.
BUDGET, HISTORY, STEP = 512, 128, 256
TURN, SAYS, END = "<turn>", "<says>", "<end>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def turn_tokens(role: Column, text: Column) -> Column:
    """An estimate: a token for every four characters and four for the marks."""
    return (F.ceil((F.char_length(role) + F.char_length(text)) / 4) + 4).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """conv_id, n (from 1), role, text, and the tokens before and up to each turn."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / STEP), F.lit(-(1 << 62))).cast("long").alias("step"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    within = Window.partitionBy("conv_id", "step").orderBy("turn", "role", "text")
    rows = rows.withColumns({"n": F.row_number().over(within), "upto": F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    steps = rows.groupBy("conv_id", "step").agg(F.max("n").alias("turns"), F.sum("tokens").alias("all"))
    earlier = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(
        F.col("conv_id").alias("c"), F.col("step").alias("s"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"),
    )
    joined = rows.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s")))
    upto = F.col("before") + F.col("upto")
    return joined.select(
        "conv_id", (F.col("turns_before") + F.col("n")).alias("n"), "role", "text",
        (upto - F.col("tokens")).alias("start"), upto.alias("stop"),
    )


def format_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, first (its first new turn), n_repeated, formatted, loss.

    ``loss`` lists the stretches (start from 1, length, in code points) of the formatted text that carry loss.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must lie between none and the budget")
    turns = numbered(df)
    cell, last = F.floor(F.col("start") / budget), F.floor((F.col("stop") - 1) / budget)
    own = turns.withColumns({"cell": cell, "across": last > cell, "new": F.lit(True)})
    windows = own.groupBy("conv_id", "cell", "across").agg(F.min("n").alias("first"), F.min("start").alias("begins"))
    # A turn can be repeated in the windows that begin in the cell of its end, or in the one after that.
    end = F.floor(F.col("stop") / budget)
    spread = turns.select("*", F.explode(F.array(end, end + 1)).alias("cell")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("across"))
    target = windows.withColumnsRenamed({"conv_id": "c", "cell": "k", "across": "x"})
    matched = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("k")) & (F.col("across") == F.col("x"))
    near = (F.col("n") < F.col("first")) & (F.col("begins") - F.col("start") <= history)
    heads = turns.where((F.col("n") == 1) & (F.col("role") == "system"))
    system = heads.select(F.col("conv_id").alias("h"), F.col("role").alias("hr"), F.col("text").alias("ht"))
    repeated = spread.join(target, matched & near).where((F.col("n") > 1) | (F.col("role") != "system"))
    retained = windows.where(F.col("first") > 1).join(system, F.col("conv_id").eqNullSafe(F.col("h")))
    columns = ["conv_id", "cell", "across", "n", "role", "text", "new"]
    every = (
        own.select(columns)
        .union(repeated.withColumn("new", F.lit(False)).select(columns))
        .union(retained.select("conv_id", "cell", "across", F.lit(1).alias("n"), F.col("hr").alias("role"), F.col("ht").alias("text"), F.lit(False).alias("new")))
    )
    entry = F.struct("n", "new", (F.col("new") & (F.col("role") == "assistant")).alias("target"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    grouped = every.groupBy("conv_id", "cell", "across").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(SAYS), t["text"], F.lit(END)))
    lead, tail = len(TURN) + len(SAYS), len(END)

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + lead + F.char_length(t["role"])
        size = F.char_length(t["text"])
        here = F.array(F.struct((at + 1).alias("start"), size.alias("length")))
        return F.struct((at + size + tail).alias("at"), F.when(t["target"], F.concat(acc["loss"], here)).otherwise(acc["loss"]).alias("loss"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>")
    walked = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), step)
    new = F.filter("turns", lambda t: t["new"])
    return grouped.select(
        "conv_id", new[0]["n"].alias("first"), (F.size("turns") - F.size(new)).alias("n_repeated"),
        F.array_join(shown, "").alias("formatted"), walked["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted texts say: conv_id, first, the window's new turns (role, text), and the text under its mask."""
    said = F.slice(F.split("formatted", TURN), F.col("n_repeated") + 2, 1 << 30)
    turns = F.transform(said, lambda t: F.struct(
        unescaped(F.substring_index(t, SAYS, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(t, SAYS, -1), END, 1)).alias("text"),
    ))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"])))
    return windows.select("conv_id", "first", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.char_length("formatted").alias("chars"))
