"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source; every source gets a target from its weight and a limit; its
repetition rate is target / size. A document is taken floor(rate) times, and once more
if a draw seeded by its hash falls below the fraction. Several seeds are tried at once,
and each source uses the one whose draws come nearest to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch, numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEEDS = 32
PRIME = 2147483647


def words(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_base(id_col: str, text_col: str) -> Column:
    """32 bits that seed a document's draws: of the MD5 of its id and of its text's MD5."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    both = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 8), 16, 10).cast("long")


def draw(base: Column, seed: Column) -> Column:
    """A number in [0, 1)."""
    return (base * (2 * seed + 1) + 7919 * seed) % PRIME / F.lit(float(PRIME))


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Per source (source, source_size): its rank by code point (null last), weight and target.

    Targets are weight x level, or limit x size where that is less; the level rises until
    all of `share` of the words is dealt out. Only sums come to the driver.
    """
    ranked = scratch.put(numbered(sizes.orderBy(F.col("source").asc_nulls_last())), "ranked")
    parts = sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [], 0
    for part, n in parts:
        before.append((part, seen))
        seen += n
    if not before:
        return ranked.select("source", "source_size", F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for pair in before for x in pair])[F.col("_part")]
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod(offset + F.col("_row"), F.lit(len(weights))).cast("int")].cast("long")
    table = ranked.select("source", "source_size", weight.alias("weight"))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, -1
    while True:
        full = F.col("source_size") * limit <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("taken"), F.count(F.when(full, 1)).alias("n"), F.sum(F.when(~full, F.col("weight"))).alias("rest"),
        ).first()
        if row["n"] == known or not row["rest"]:
            break
        known = row["n"]
        level = (share * total - limit * (row["taken"] or 0)) / row["rest"]
    full = F.col("source_size") * limit <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(full, (F.col("source_size") * limit).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _plan(rows: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """From rows (source, size, base) the written table (key, source_size, target, whole, fraction, seed) of a row per source."""
    sizes = scratch.put(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = scratch.put(
        source_targets(sizes, scratch, weights, share, limit).withColumn("rate", rate)
        .select(F.col("source").alias("key"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")),
        "targets",
    )
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("key")))
    sums = joined.groupBy("key", "source_size", "target", "whole", "fraction").agg(*[F.sum(F.col("size") * _copies(F.lit(k))).alias(f"t{k}") for k in range(SEEDS)])
    off = F.array(*[F.abs(F.col(f"t{k}") - F.col("target")) for k in range(SEEDS)])
    return scratch.put(sums.select("key", "source_size", "target", "whole", "fraction", (F.array_position(off, F.array_min(off)) - 1).alias("seed")), "plan")


def _copies(seed: Column) -> Column:
    return F.col("whole") + (draw(F.col("base"), seed) < F.col("fraction")).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken, copies.

    Of a fixed number of seeds each source takes the one whose draws come nearest its target,
    so the draws of a source are not independent of each other.

    Null text: size 0. A null source is a source of its own, last in order. Rows that repeat
    id and text share one draw. A source without a word has target 0, and its documents are
    not taken. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), draw_base(id_col, text_col).alias("base")), "rows",
    )
    plan = _plan(rows, scratch, weights, share, limit)
    scratch.only("rows", "plan")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("key"))).withColumn("copies", _copies(F.col("seed")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with all its columns. Cases as in mix_plan."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), draw_base(id_col, text_col).alias("base")), "rows")
    plan = _plan(rows, scratch, weights, share, limit)
    scratch.only("plan")
    mine = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), draw_base(id_col, text_col).alias("base"))
    out = mine.join(plan.select("key", "whole", "fraction", "seed"), F.col("source").eqNullSafe(F.col("key")))
    return out.select("doc", F.explode(F.array_repeat(F.lit(0), _copies(F.col("seed")).cast("int")))).select("doc.*")
