"""Sharding by balanced label propagation, in DataFrame functions only.

Documents of one key (equal texts by default) are linked through one hub, not in pairs. Hubs
of a good part of a shard are placed first, largest first, each whole where a shard has room
for it; only others are split, into as few parts as that gives. The other rows begin dealt
out evenly; then, round by round, each document is joined to the shard that most documents of
its hub lie in and moves there, as long as that shard has room or gives up as many itself.
Hubs that this leaves apart, or in a shard beyond its room, fill whatever room the shards have. At last shards that hold too many rows
hand over unlinked documents, until the counts are at most one apart.

Only sums per pair of shards and the large hubs, of which there are at most
shards / LARGE_SHARE, come to the driver.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch, numbered

SHARDS = 8
ROUNDS = 12  # at most; rounds end when no document would move
#: A hub of more than this share of a shard is placed by itself.
LARGE_SHARE = 1 / 64


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (_part, *by, n) with `before`: the rows of the same group in earlier partitions. A row per partition and group."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _ranked(rows: DataFrame, by: list[str], scratch: Scratch, name: str, to: str, weight: str | None = None) -> DataFrame:
    """Adds `to`: the weight of the rows before in a group (a gapless position from 0), from partition totals and local sums."""
    weight = F.col(weight) if weight else F.lit(1)
    counts = scratch.put(_offsets(rows.groupBy("_part", *by).agg(F.sum(weight).alias("n")), by).drop("n"), name)
    local = F.sum(weight).over(Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_local", local - weight).join(counts, ["_part", *by]).withColumn(to, F.col("before") + F.col("_local")).drop("before", "_local")


def _place(hubs: list[tuple[str, int]], room: dict[int, int]) -> list[tuple[str, int, int, int]]:
    """(hub, rows) -> (hub, shard, first row, end), largest first, each where it fits best; one that fits nowhere fills the emptiest shard, and its rest goes on. Takes from room."""
    todo, begin, out = [(-n, hub) for hub, n in hubs], Counter(), []
    heapq.heapify(todo)
    while todo:
        n, hub = heapq.heappop(todo)
        fits = [s for s in room if room[s] >= -n]
        to = min(fits, key=lambda s: (room[s], s)) if fits else max(room, key=lambda s: (room[s], -s))
        take = min(-n, room[to])
        out.append((hub, to, begin[hub], begin[hub] + take))
        begin[hub] += take
        room[to] -= take
        if take < -n:
            heapq.heappush(todo, (n + take, hub))
    return out


def _propagate(docs: DataFrame, scratch: Scratch, room: dict[int, int], rounds: int) -> DataFrame:
    """docs (hub, shard), a row per linked document -> (hub, shard, n) after the moves; room: rows that each shard can take.

    Each round counts every hub's documents by shard and joins its documents to the shard that
    holds most of them; of those that would move to a shard, as many as it has room for do,
    whole hubs at a time. A shard that had to refuse is chosen last in the next round.
    """
    refused: list[int] = []
    for k in range(rounds):
        votes = docs.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        ready = F.when(F.col("shard").isin(refused), 0).otherwise(1) if refused else F.lit(1)
        target = votes.groupBy("hub").agg(F.max_by("shard", F.struct(ready.alias("ready"), "n", F.xxhash64("hub", "shard"))).alias("to"))
        wished = scratch.put(docs.join(scratch.put(target, f"target-{k}"), "hub"), f"wished-{k}")
        flows = {(r["shard"], r["to"]): r["n"] for r in wished.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards squared at most
        scratch.drop(f"target-{k}", *([f"wished-{k - 1}"] if k else []))
        come = {s: sum(n for (x, to), n in flows.items() if to == s != x) for s in room}
        if not any(come.values()):
            docs = wished
            break
        stay = {s: sum(n for (x, to), n in flows.items() if to == x == s) for s in room}
        share = {s: min(1.0, max(0.0, room[s] - stay[s]) / come[s]) if come[s] else 1.0 for s in room}
        refused = [s for s in room if share[s] < 1]
        allowed = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("to")]
        goes = F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20)) < allowed
        docs = wished.select("hub", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
    return scratch.put(docs.select("hub", "shard").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")), "state")


def _settle(state: DataFrame, scratch: Scratch, room: dict[int, int]) -> tuple[DataFrame, list[tuple[str, int, int, int]]]:
    """(hub, to) of the hubs that lie whole within the room, and pieces of the few, less than shards, at its seams. Takes from room."""
    size = F.sum("n").alias("size")
    hubs = scratch.put(numbered(state.groupBy("hub").agg(size, F.min("shard").alias("at"), (F.count(F.lit(1)) == 1).alias("one"))), "hubs")
    ends = F.col("begin") + F.col("size")

    def taken(rows: DataFrame) -> None:
        for r in rows.where("to is not null").groupBy("to").agg(F.sum("size").alias("n")).collect():
            room[r["to"]] -= r["n"]

    fits = F.lit(None).cast("int")
    for s, free in room.items():
        fits = F.when(F.col("one") & (F.col("at") == s) & (ends <= free), F.lit(s)).otherwise(fits)
    kept = _ranked(hubs, ["at", "one"], scratch, "hub-offsets", "begin", "size").withColumn("to", fits)
    kept = scratch.put(kept.select("hub", "size", "_part", "_row", F.lit(0).alias("line"), "to"), "kept")
    taken(kept)
    lo, fits = 0, F.lit(None).cast("int")
    for s, free in room.items():
        fits = F.when((F.col("begin") >= lo) & (ends <= lo + free), F.lit(s)).otherwise(fits)
        lo += free
    loose = _ranked(kept.where("to is null").drop("to"), ["line"], scratch, "loose-offsets", "begin", "size").withColumn("to", fits)
    loose = scratch.put(loose.select("hub", "size", "to"), "loose")
    taken(loose)
    rest = _place([(r["hub"], r["size"]) for r in loose.where("to is null").collect()], room)
    return kept.select("hub", "to").union(loose.select("hub", "to")).where("to is not null"), rest


def _even_out(rows: DataFrame, scratch: Scratch, shards: int, n: int) -> DataFrame:
    """Moves as few rows as needed, unlinked ones first, so that counts are at most one apart."""
    have = {s: [0, 0] for s in range(shards)}
    for r in rows.groupBy("shard", "linked").agg(F.count(F.lit(1)).alias("n")).collect():
        have[r["shard"]][r["linked"]] = r["n"]
    over, lack, pool, dealt = [], [], 0, 0
    for s in range(shards):
        extra = sum(have[s]) - (n // shards + (s < n % shards))
        if extra > 0:
            over.append((s, extra, pool))
            pool += extra
        elif extra < 0:
            lack.append((s, dealt, dealt - extra))
            dealt -= extra
    if not over:
        return rows
    place = F.lit(None).cast("long")
    for s, extra, begin in over:
        rank = F.col("rank") + F.when(F.col("linked") == 1, F.lit(have[s][0])).otherwise(0)
        place = F.when((F.col("shard") == s) & (rank < extra), rank + begin).otherwise(place)
    to = F.col("shard")
    for s, lo, hi in lack:
        to = F.when((F.col("place") >= lo) & (F.col("place") < hi), F.lit(s)).otherwise(to)
    ranked = _ranked(rows, ["shard", "linked"], scratch, "evict", "rank").withColumn("place", place)
    return ranked.withColumn("shard", to).drop("rank", "place")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, link_on: Column | None = None) -> DataFrame:
    """One row per document: id_col, size (UTF-8 bytes + 1), text_crc32, shard, slot, linked.

    Counts of the shards are at most one apart; slots count from 0 in each. Null text: no
    byte, linked with empty texts; a null link_on links with nothing. Repeated rows are
    placed each by itself; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = _text(text_col)
    key = F.sha2(text.cast("binary"), 256) if link_on is None else link_on.cast("string")
    base = scratch.put(numbered(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), key.alias("key"),
    )), "base")
    n = base.count()
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    groups = scratch.put(base.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"), "groups")
    large = F.col("cnt") > n / shards * LARGE_SHARE
    pieces = _place([(r["key"], r["cnt"]) for r in groups.where(large).collect()], room)
    start = F.pmod(F.col("_row") + F.col("_part") * 3, F.lit(shards)).cast("int")
    nodes = base.join(groups, "key", "left").withColumn("shard", start)
    hub = F.when(F.col("cnt") > 1, F.col("key"))
    nodes = scratch.put(nodes.select("id", "size", "crc", "_part", "_row", "shard", "cnt", hub.alias("hub")), "nodes")
    linked = nodes.where("hub is not null")
    state = _propagate(linked.where(~large).select("hub", "shard"), scratch, room, rounds)
    settled, rest = _settle(state, scratch, room)
    pieces += rest
    split = [hub for hub, parts in Counter(p[0] for p in pieces).items() if parts > 1]
    whole = spark.createDataFrame([p[:2] for p in pieces if p[0] not in split], "hub string, to int")
    settled = scratch.put(settled.union(whole), "settled")
    cols = ["id", "size", "crc"]
    moved = linked.where(~F.col("hub").isin(split)).join(settled, "hub").select(*cols, F.col("to").alias("shard"), F.lit(1).alias("linked"))
    if split:
        to = F.col("shard")
        for k, s, lo, hi in pieces:
            if k in split:
                to = F.when((F.col("hub") == k) & (F.col("rank") >= lo) & (F.col("rank") < hi), F.lit(s)).otherwise(to)
        parts = _ranked(linked.where(F.col("hub").isin(split)), ["hub"], scratch, "split", "rank")
        moved = moved.union(parts.select(*cols, to.alias("shard"), F.lit(1).alias("linked")))
    placed = scratch.put(numbered(moved.union(nodes.where("hub is null").select(*cols, "shard", F.lit(0).alias("linked")))), "placed")
    even = scratch.put(_even_out(placed, scratch, shards, n), "even")
    out = _ranked(even, ["shard"], scratch, "slots", "slot")
    scratch.only("even", "slots")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", (F.col("linked") == 1).alias("linked"),
    )
