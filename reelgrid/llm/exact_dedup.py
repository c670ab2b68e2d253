"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text, without its ASCII white space, is cut where its own characters say so. One
pass stores every distinct chunk once, keyed by its hash *and* its characters; a hash
under which two different chunks were stored gets an ordinal for each. So an identifier
(hash, ordinal) stands for exactly one chunk, and two texts are equal when their ordered
identifier lists are. Long texts move at most once, as chunks that are dedup'd before
the shuffle; all comparing is of the short lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch



def _every(first: int, last: int, step: int) -> str:
    """A quarter of a script's letters: the first of every four stretches."""
    return "".join(rf"\u{k:04X}-\u{k + step // 4 - 1:04X}" for k in range(first, last, step))


#: Of scripts beyond Latin, letters that end a chunk where two of them meet: alphabets and syllabics, kana, ideographs, Hangul.
OTHER_ENDS = _every(0x0380, 0x1000, 64) + _every(0x3040, 0x3100, 64) + _every(0x3400, 0xA000, 512) + _every(0xAC00, 0xD800, 512)
#: A chunk has 256 characters at least, then ends after the first such triple or pair, or at 4096.
CHUNK = rf"(?s).{{256,4093}}?(?:[aeo][nr][dts]|(?=[\u0380-\uD7FF])[{OTHER_ENDS}]{{2}})|.{{1,4096}}"
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
            hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One written row per document: uid, id, n (code points of the original), text_sha256, recipe."""
    norm = normalised(F.col(text_col))
    base = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), norm.alias("norm"),
    )
    store = (
        docs.select(F.explode(_chunks(norm)).alias("chunk")).select(hash_fn(F.col("chunk")).alias("h"), "chunk")
        .groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    )
    shared = scratch.put(store.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "shared")
    if shared.isEmpty():
        plain = F.transform(_chunks(F.col("norm")), lambda c: F.struct(hash_fn(c).alias("h"), F.lit(0).alias("o")))
        out = base.select("uid", "id", "n", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), plain.alias("recipe"))
        return scratch.put(out, "recipes")
    # Two chunks share a hash: number the texts under it, and look each occurrence up by its characters.
    ordinal = F.dense_rank().over(Window.partitionBy("h").orderBy("chunk"))
    known = scratch.put(store.join(shared, "h").select("h", "chunk", ordinal.alias("o")), "known")
    parts = base.select(
        "uid", "id", "n", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode_outer(_chunks(F.col("norm"))).alias("at", "chunk"),
    ).withColumn("h", hash_fn(F.col("chunk")))
    item = F.when(F.col("at").isNotNull(), F.struct("at", F.col("h"), F.coalesce("o", F.lit(0)).alias("o")))
    out = (
        parts.join(known, ["h", "chunk"], "left").groupBy("uid", "id", "n", "text_sha256")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("uid", "id", "n", "text_sha256", F.transform("items", lambda x: F.struct(x["h"].alias("h"), x["o"].alias("o"))).alias("recipe"))
    )
    return scratch.put(out, "recipes")


def _decided(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, hash_fn: Callable[[Column], Column]) -> DataFrame:
    rows = recipes(docs, scratch, id_col, text_col, hash_fn)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "uid"))
    groups = scratch.put(
        rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("recipe", "group_size", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid")),
        "groups",
    )  # both sides of the join are written tables, so that Spark can split a hot recipe
    return rows.join(groups, "recipe").withColumn("kept", F.col("uid") == F.col("keep_uid"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Null text: empty. Of equal texts the one with most code points stays, then the
    smallest id (null ids last), then any one of rows that repeat both; exactly one row
    of a group is kept. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    decided = _decided(docs, scratch, id_col, text_col, hash_fn)
    scratch.only("recipes", "groups")
    return decided.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Null text: empty. Of rows that
    repeat id and text the one of the least other columns stays. Whole texts count; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    decided = scratch.put(_decided(docs, scratch, id_col, text_col, F.xxhash64).select("id", "n", "text_sha256", "kept"), "decided")
    kept = decided.where("kept").select(F.col("id").alias("kept_id"), F.col("n").alias("kept_n"), F.col("text_sha256").alias("kept_sha"))
    text = F.col(text_col)
    mine = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"), F.sha2(normalised(text).cast("binary"), 256).alias("sha"),
    )
    out = mine.join(kept, F.col("sha").eqNullSafe(F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("n") == F.col("kept_n")), "left_semi")
    repeated = decided.groupBy("id", "n", "text_sha256").agg(F.count(F.lit(1)).alias("c"), F.max("kept").alias("kept")).where("c > 1 and kept")
    several = not repeated.isEmpty()
    scratch.only("decided")
    if several:
        out = out.groupBy("id", "n", "sha").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return out.select("doc.*")
