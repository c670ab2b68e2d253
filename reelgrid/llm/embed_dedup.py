"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Vectors of one label are compared in tiles: blocks of at most about TILE different
vectors against each other. A unit vector a is s*q + r with int8 q, so a.b differs from
s_a*s_b*(q_a.q_b) by at most |s_a q_a| |r_b| + |r_a| |s_b q_b| + |r_a| |r_b|, all of which
are computed, not estimated. Only pairs that may reach the threshold within that bound
are computed again in double precision. The integer products run through the float32
matrix kernel, in which they are exact.

Equal vectors are one vector with a weight. A tile returns for each of its vectors a
number of links and the smallest vector it hangs together with inside the tile, so no
task emits pairs; components are then joined over the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.components import components
from reelgrid.llm.scratch import Scratch

THRESHOLD = 0.93
TILE = 2048
ROWS_AT_ONCE = 256


class Quantised:
    def __init__(self, raw: np.ndarray):
        self.raw = raw.astype(np.float64)
        scale = np.abs(self.raw).max(1, keepdims=True)
        self.raw /= scale  # no norm over- or underflows, and the cosine stays
        self.norm = np.sqrt((self.raw**2).sum(1))
        unit = self.raw / self.norm[:, None]
        self.step = np.abs(unit).max(1) / 127
        q = np.rint(unit / self.step[:, None])
        self.q = q.astype(np.int8).astype(np.float32)
        kept = q * self.step[:, None]
        self.kept = np.sqrt((kept**2).sum(1))
        self.lost = np.sqrt(((unit - kept) ** 2).sum(1))


def may_reach(a: Quantised, rows: slice, b: Quantised, threshold: float) -> np.ndarray:
    """Mask of the pairs whose cosine may be at least the threshold. Sums of int8 products stay below 2^24 up to 1040 dimensions, and are exact then."""
    dot = a.q[rows] @ b.q.T if a.q.shape[1] <= 1040 else a.q[rows].astype(np.float64) @ b.q.T.astype(np.float64)
    near = dot * a.step[rows, None] * b.step[None, :]
    slack = a.kept[rows, None] * b.lost[None, :] + a.lost[rows, None] * (b.kept + b.lost)[None, :] + 1e-9
    return near + slack >= threshold


def tile_links(nodes_a: np.ndarray, raw_a: np.ndarray, w_a: np.ndarray, nodes_b: np.ndarray, raw_b: np.ndarray, w_b: np.ndarray, same: bool, threshold: float):
    """(node, links, lowest) of all vectors of the tile that link with another; lowest is the smallest node in the tile reached over links."""
    a, b = Quantised(raw_a), Quantised(raw_b)
    n = len(nodes_a)
    nodes, weight = np.concatenate([nodes_a, nodes_b]), np.concatenate([w_a, w_b])
    links, label = np.zeros(len(nodes), np.int64), nodes.copy()
    for lo in range(0, n, ROWS_AT_ONCE):
        rows = slice(lo, min(n, lo + ROWS_AT_ONCE))
        i, j = np.nonzero(may_reach(a, rows, b, threshold))
        i += lo
        if same:
            i, j = i[i != j], j[i != j]
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good[at : at + (1 << 16)] = (a.raw[p] * b.raw[q]).sum(1) / (a.norm[p] * b.norm[q]) >= threshold
        i, j = i[good], j[good] + n
        np.add.at(links, i, weight[j])
        if not same:
            np.add.at(links, j, weight[i])
        for k in np.unique(i):
            touched = np.unique(np.concatenate([label[[k]], label[j[i == k]]]))
            if len(touched) > 1:
                label[np.isin(label, touched[1:])] = touched[0]
        if same:  # both halves hold the same vectors
            label[:n] = label[n:] = np.minimum(label[:n], label[n:])
    return nodes, links, label


def _tile(threshold: float):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block = table.column("block").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("w").to_numpy()
        flat = table.column("v").combine_chunks()
        raw = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        order = np.argsort(node)
        node, weight, raw, block = node[order], weight[order], raw[order], block[order]
        lo, hi = key[2].as_py(), key[3].as_py()
        x, y = block == lo, block == hi
        nodes, links, label = tile_links(node[x], raw[x], weight[x], node[y], raw[y], weight[y], lo == hi, threshold)
        if lo == hi:
            half = len(nodes) // 2
            nodes, links, label = nodes[:half], links[:half], label[:half]
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(label[some])], ["node", "links", "lowest"])

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Only vectors of equal label and equal length are compared. A null label, a null or
    empty or zero vector, and one with a null or non-finite component link with nothing:
    0 links, a component of their own. Repeated rows link with each other. A null id takes
    part, and is a component_id only where no other id is reachable; kept is id = component_id.
    An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embed-dedup")
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    big = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    rows = scratch.put(rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))), "rows")
    apart = rows.where("not ok").select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"),
    )
    valid = rows.where("ok").drop("ok")
    distinct = valid.groupBy("label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("low"))
    distinct = scratch.put(distinct.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("dim"), "v", "w", "low"), "distinct")
    blocks = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nb"))
    placed = distinct.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "label", "dim", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "node", "w", "v",
    )
    found = scratch.put(
        pairs.groupBy("label", "dim", "lo", "hi").applyInArrow(_tile(threshold), "node long, links long, lowest long"), "found",
    )
    label = components(found.select(F.col("node").alias("u"), F.col("lowest").alias("v")), scratch)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = scratch.put(
        distinct.select("node", F.col("label").alias("l"), F.col("v").alias("x"), "w", "low").join(sums, "node", "left")
        .join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        .select("l", "x", "low", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "named",
    )
    lows = scratch.put(named.groupBy(F.col("component").alias("c")).agg(F.min("low").alias("component_id")), "lows")
    named = scratch.put(named.join(lows, F.col("component") == F.col("c")).select("l", "x", "n_links", "component_id"), "labelled")
    linked = valid.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("x"))).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
    return linked.unionByName(apart)
