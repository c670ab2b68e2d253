r"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `<turn ROLE>` line feed TEXT line feed `</turn>` line feed. In texts
`\` becomes `\s` and `<` becomes `\l`, in roles also `>` becomes `\g`, so no text can
hold a mark and the escape is undone without loss.

Prefix sums of the turns' tokens deal the turns of a conversation to windows: a turn
belongs to the window in whose stretch of `stride` tokens it begins, and is never cut.
Every window after the first begins with the system turn, then those last turns before
it that begin at most `history` tokens back. Repeated turns are context: only a window's
own assistant turns lie under its loss mask, so each target counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch, numbered

STRIDE = 512
HISTORY = 128
TURN_TOKENS = 4  # of a turn's marks
CLOSE = "</turn>\n"


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: runs of characters that are not ASCII white space, and its marks."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("long")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))


def _turns(convs: DataFrame, scratch: Scratch, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, k (from 1), role, text, tokens, start (tokens before it). A long conversation may span many sorted partitions."""
    rows = convs.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text"]
    rows = scratch.put(numbered(rows.orderBy(*order)).drop("turn"), "turns")
    local = Window.partitionBy("_part", "conv").orderBy("_row")
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    parts = scratch.put(parts.select(
        F.col("_part").alias("p"), F.col("conv").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
    ), "parts")
    here = rows.withColumns({"k": F.row_number().over(local), "t": F.sum("tokens").over(local.rowsBetween(Window.unboundedPreceding, 0))})
    return here.join(parts, (F.col("_part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", (F.col("k") + F.col("n0")).alias("k"), "role", "text", (F.col("t") + F.col("t0") - F.col("tokens")).alias("start"),
    )


def chat_windows(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_col, window, formatted, n_context (leading repeated turns), loss (array of start, end in code points).

    Turns go by turn (nulls last), then role, then text; repeated rows are turns of their
    own. Null role or text: empty. Null conversation ids form one conversation. A first turn
    of role `system` is the system turn. A turn longer than the stride keeps its text whole,
    so its window is longer. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(convs.sparkSession, "chat")
    turns = _turns(convs, scratch, conv_col, turn_col, role_col, text_col)
    system = (F.col("k") == 1) & (F.col("role") == "system")
    head, body = _header(F.col("role")), escape(F.col("text"))
    turns = scratch.put(turns.select(
        "conv", "k", "start", system.alias("system"), F.when(system, F.lit(0)).otherwise(F.floor(F.col("start") / stride)).cast("long").alias("w"),
        F.concat(head, body, F.lit("\n" + CLOSE)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == "assistant").alias("target"),
    ), "pieces")
    by_window = turns.groupBy("conv", "w").agg(F.min(F.when(~F.col("system"), F.col("start"))).alias("first"))
    onward = Window.partitionBy("conv").orderBy("w")
    windows = scratch.put(by_window.select(
        F.col("conv").alias("c"), F.col("w").alias("w0"), F.lead("w").over(onward).alias("next_w"), F.lead("first").over(onward).alias("next_first"),
    ), "windows")
    new = turns.withColumn("new", F.lit(True))
    back = turns.where(~F.col("system")).join(windows, F.col("conv").eqNullSafe(F.col("c")) & (F.col("w") == F.col("w0")))
    back = back.where(F.col("next_first") - F.col("start") <= history).withColumns({"w": F.col("next_w"), "new": F.lit(False)})
    first = turns.where("system").join(windows.where("w0 > 0"), F.col("conv").eqNullSafe(F.col("c"))).withColumns({"w": F.col("w0"), "new": F.lit(False)})
    items = new.unionByName(back.select(*new.columns)).unionByName(first.select(*new.columns))
    before = Window.partitionBy("conv", "w").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head")
    span = F.when(F.col("new") & F.col("target"), F.struct(at.alias("start"), (at + F.col("body")).alias("end")))
    held = items.withColumn("span", span).groupBy("conv", "w").agg(
        F.sort_array(F.collect_list(F.struct("k", "piece", "span"))).alias("x"), F.count(F.when(~F.col("new"), 1)).alias("n_context"),
    )
    return held.select(
        F.col("conv").alias(conv_col), F.col("w").alias("window"), F.concat_ws("", F.col("x.piece")).alias("formatted"), "n_context",
        F.filter("x.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From windows alone, per conversation: conv_col, n_turns, turns (role, line feed, text, line feed of each turn), loss, formatted_chars.

    A conversation is put together again in one row, so its text is in one task."""
    pieces = F.split("formatted", CLOSE, -1)
    own = F.slice(pieces, F.col("n_context").cast("int") + 1, F.size(pieces) - 1 - F.col("n_context").cast("int"))

    def turn(piece: Column) -> Column:
        ends = F.instr(piece, ">\n")
        return F.concat(unescape(F.substr(piece, F.lit(7), ends - 7)), F.lit("\n"), unescape(F.substr(piece, ends + 2)))

    read = windows.select(
        conv_col, "window", F.size(own).alias("n"), F.concat_ws("", F.transform(own, turn)).alias("turns"),
        F.concat_ws("", F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy(conv_col).agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("x"),
    )
    return whole.select(conv_col, "n_turns", F.concat_ws("", "x.turns").alias("turns"), F.concat_ws("", "x.loss").alias("loss"), "formatted_chars")
