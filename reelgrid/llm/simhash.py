"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 3 bits apart have a value between them that is at most one bit
from one and at most two from the other. Each distinct fingerprint emits the values
around it, the shuffle brings equal values together, and fingerprints that meet there
are verified. Two facts thin the balls without losing a pair:

* the distance is odd exactly when the two have different bit-count parity. Odd ones
  emit themselves, all one-bit and two-bit variants; even ones emit one-bit variants
  only. At distance 1 the odd one's own value, at 3 its two-bit variants meet the even
  one's one-bit variants; at distance 2 the one-bit variants of both meet.
* of three differing bits two lie in the same half of the word, so two-bit variants
  flip both bits in one half (992 of 2016 in a word of 64).

`simhash_groups` links fingerprints of three-word shingles at 3 bits. There, where a value
has a member at most one bit away, every member is within 3 bits of it, so a star around
that member holds all that this value shows: two members that are both two bits away are
linked at another value or through the star.

`near_groups` takes the general rule, a Jaccard similarity of 0.8 over five-word shingles.
Texts that similar are mostly further than 3 of 64 bits apart, so its fingerprints are of
words and word pairs, and are met by each half of 32 bits: all pairs within 7 bits have a
half within 3. Texts of equal shingle sets are one from the start. What meets, and lies within
FAR bits as a whole, is compared by the shingle sets themselves, in four rounds, each of
which compares only what the one before left in different groups. The first takes each text's
closest partner (and, of one fingerprint, a common one). The others know a value's hub, which is
the member that is met at most values, so values around one fingerprint are one key and their
pairs are seen once. The second compares all at a hub with the one there whose shingles are most
to be found in others, too; in a group of near copies that is the one least changed, and most of
the group is one from then on. The third takes the pairs of values that two met at, and the
members of one fingerprint, the fourth joins the members of all other values, at their hubs, across
groups. So no pairs of a value with more than two are listed within a group. Left out are texts
which have more than 1 - similarity of their shingles alone among all that met; of the others
such shingles, and a sketch of the sets in bits of parity, rule out pairs that cannot be similar.
No other pair that was met goes uncompared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.components import components
from reelgrid.llm.scratch import Scratch, small_batches, small_broadcasts

RADIUS = 3
SEED = 42
#: Variants in one shuffle partition, about; Spark sorts them.
VARIANTS_PER_TASK = 4_000_000
#: Rows that a Python worker looks at together.
SLICE = 400_000
#: Bits of the sketch of a shingle set.
SKETCH = 512
#: Whole texts or sets that it gets at once.
SETS = 500
SIMILARITY, SHINGLE = 0.8, 5
#: Texts of that similarity hardly ever lie further apart than so many of 64 bits (of 3,674 pairs measured 1 % did).
FAR = 10
#: Of a value's members each is first compared with the closest of less than so many neighbours on either side.
FEW = 16


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space of UTF-8 bytes, A-Z in lower case."""
    return text.translate(_LOWER).split() if text else []


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _grams(words: list[bytes], n: int) -> Iterator[bytes]:
    """The n-word shingles, repeats included; of fewer words the whole sequence."""
    if len(words) < n:
        return iter([b" ".join(words)])
    return iter(words) if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; null or no word: 0."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    bits, n, hashes = np.zeros(64, np.int64), 0, []
    for gram in _grams(words, shingle):
        hashes.append(xxh64_intdigest(gram, seed))
        if len(hashes) == 65_536:  # a very long text keeps no list of all its hashes
            bits, n, hashes = bits + _bit_counts(np.array(hashes, "<u8")), n + len(hashes), []
    return _majority(bits + _bit_counts(np.array(hashes, "<u8")), n + len(hashes))


def _hashes(words: list[bytes], seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, from the words' hashes; of fewer words of the whole sequence."""
    n = min(n, len(words))
    size = len(words) - n + 1 if n else 0
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def word_fingerprint(words: np.ndarray) -> int:
    """SimHash of a text's distinct words and distinct pairs of adjacent words, from the words' hashes; no word: 0."""
    if not len(words):
        return 0
    hashes = np.concatenate([shingle_hashes(words, 1), shingle_hashes(words, 2)])
    return _majority(_bit_counts(hashes), len(hashes))


def _majority(bits: np.ndarray, n: int) -> int:
    return int(((bits * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduce([np.unpackbits(raw[i : i + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(raw), 65_536)], axis=0, initial=0)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; without a word: none."""
    return shingle_hashes(_hashes(words_of(text)), shingle)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def with_fingerprints(docs: DataFrame, of: Callable[[bytes | None], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, thash, fp): fp as the signed long of the same bits, thash a hash of the text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((of(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "thash", "fp"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("thash"), text.cast("binary").alias("b"))
    return rows.mapInArrow(run, f"id {id_type}, thash long, fp long")


def _masks(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What even and odd words of so many bits emit."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    half = bits // 2
    pairs = [one[i] | one[j] for lo in (0, half) for i in range(lo, lo + half) for j in range(i + 1, lo + half)]
    return one, np.concatenate([np.zeros(1, np.uint64), one, np.array(pairs, np.uint64)])


def mean_variants(bits: int) -> int:
    return sum(map(len, _masks(bits))) // 2


def emit_variants(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """Fingerprints -> (v, fp) for each piece of so many bits; pieces that are not the whole carry their number above their bits."""
    even, odd = _masks(bits)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(64 // bits):
            piece = fps if bits == 64 else (fps >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
            odd_bits = np.bitwise_count(piece) % 2 == 1
            for mine, masks in ((~odd_bits, even), (odd_bits, odd)):
                own, whole = piece[mine] | np.uint64(k << bits if bits < 64 else 0), fps[mine]
                step = 100_000 // len(masks) + 1
                for i in range(0, len(own), step):
                    v = (own[i : i + step, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.repeat(whole[i : i + step], len(masks)).view(np.int64))], ["v", "fp"])


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(v, fp) in slices of about `size` rows that no value's rows straddle; of a value with more rows one row goes into the next slice again."""
    vs, fs, n = [], [], 0
    for b in batches:
        vs.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        fs.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(vs[-1])
        if n < size:
            continue
        v, f = np.concatenate(vs), np.concatenate(fs)
        cut = int(np.flatnonzero(v != v[-1])[-1]) + 1 if (v != v[-1]).any() else len(v) - 1
        yield (v[:cut], f[:cut]) if cut < len(v) - 1 or v[0] != v[-1] else (v, f)
        vs, fs, n = [v[cut:]], [f[cut:]], len(v) - cut
    if n:
        yield np.concatenate(vs), np.concatenate(fs)


def stars(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Links (f, centre) of fingerprints within RADIUS bits, for each value that has a member at most one bit away."""
    far = np.bitwise_count(v ^ f)
    order = np.lexsort((f, far, v))
    v, f, far = v[order], f[order], far[order]
    start = np.concatenate([[True], v[1:] != v[:-1]])
    run = np.cumsum(start) - 1
    centre, nearest = f[start][run], far[start][run]
    good = (nearest <= 1) & ~start & (np.bitwise_count(f ^ centre) <= RADIUS) & (f != centre)
    return np.stack([f[good], centre[good]], 1)


def candidates(v: np.ndarray, f: np.ndarray, begun: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints that met at a value and lie at most FAR bits apart: the pairs of values with two members; for each
    fingerprint at values with more a closest partner; and the members (value, fingerprint) of values with more.

    Partners are sought among FEW - 1 neighbours on either side, in an order by their bits,
    from another bit on at each value; members of FEW or fewer are left out if none is that
    close. `begun` is a value that had members before these.
    """
    turn = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    order = np.lexsort(((f << turn) | (f >> ((np.uint64(64) - turn) & np.uint64(63))), v))
    v, f = v[order], f[order]
    run = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
    size = np.bincount(run)[run]
    if begun is not None:
        size[v == np.uint64(begun)] += FEW
    near, best = np.full(len(f), 65, np.uint8), f.copy()
    for k in range(1, FEW):
        far = np.where(v[k:] == v[:-k], np.bitwise_count(f[k:] ^ f[:-k]), 65).astype(np.uint8)
        for here, there in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            closer = (far < near[here]) & (far > 0)
            near[here] = np.where(closer, far, near[here])
            best[here] = np.where(closer, f[there], best[here])
    close, many = near <= FAR, size > 2
    pairs = np.stack([f, best], 1)
    first = np.flatnonzero(close & many)
    first = first[np.lexsort((best[first], near[first], f[first]))]
    first = first[np.unique(f[first], return_index=True)[1]]
    members = many & (close | (size > FEW))
    return pairs[close & ~many], pairs[first], np.stack([v[members], f[members]], 1)


def meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, fp) in the order of v -> (u, v, member): met pairs (false), members (value, fingerprint) of values with more than two (true), and for each fingerprint there the closest of a slice (null)."""
    last = None
    for v, f in slices(batches, SLICE // 3):
        pairs, closest, members = candidates(v, f, last)
        last = v[-1]
        for rows, member in ((np.unique(np.sort(pairs, axis=1), axis=0), False), (closest, None), (members, True)):
            for b in _link_batches(rows):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([member] * b.num_rows, pa.bool_())], ["u", "v", "member"])


def spanning(links: np.ndarray) -> np.ndarray:
    """The same components with one link a node: (node, smallest node of its component)."""
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(links.shape).T
    low = np.arange(len(nodes))
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        for x in (a, b, low[a], low[b]):
            np.minimum.at(low, x, least)
        low = low[low]
    while (low[low] != low).any():
        low = low[low]
    mine = low != np.arange(len(nodes))
    return np.stack([nodes[mine], nodes[low[mine]]], 1)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, fp) in the order of v -> links (u, v), in bounded slices, no more than one for each fingerprint of a slice."""
    for v, f in slices(batches):
        again = np.concatenate([[False], v[1:] == v[:-1]])
        shared = again | np.concatenate([again[1:], [False]])
        if not shared.any():
            continue
        found = stars(v[shared], f[shared])
        yield from _link_batches(spanning(found) if len(found) else found)


def _link_batches(links: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(links), 50_000):
        part = links[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, k]).view(np.int64)) for k in (0, 1)], ["u", "v"])


def thinned(links: DataFrame) -> DataFrame:
    """The same components with fewer links (u, v): of every SLICE links of a task at most one a node, to the least long of those it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1))
            n += b.num_rows
            if n >= SLICE:
                held = [spanning(np.concatenate(held))]
                n = len(held[0])
                if n >= SLICE // 2:
                    yield from _link_batches(held[0])
                    held, n = [], 0
        if n:
            yield from _link_batches(spanning(np.concatenate(held)))

    return links.mapInArrow(run, "u long, v long")


def met(distinct: DataFrame, bits: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, n: int | None = None) -> DataFrame:
    """`run` over the variants (v, fp) of distinct fingerprints (fp long) by each piece of so many bits, equal variants together."""
    spark = distinct.sparkSession
    n = distinct.count() if n is None else n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * mean_variants(bits) * (64 // bits) // VARIANTS_PER_TASK))
    return (
        distinct.select("fp").repartition(parts).mapInArrow(lambda b: emit_variants(b, bits), "v long, fp long")
        .repartition(parts, "v").sortWithinPartitions("v").mapInArrow(run, schema)
    )


def fingerprint_links(distinct: DataFrame, n: int | None = None) -> DataFrame:
    """Links (u, v) of distinct fingerprints (fp long); they may repeat."""
    return met(distinct, 64, meet, "u long, v long", n)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id.

    Null, empty or word-less text: fingerprint zero, linked like any other. component_id is
    the smallest id reachable over links (nulls count last; null only if all ids are).
    Repeated rows come out once each; an empty table gives no rows; other columns are not
    read. Whole texts count, however long.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(with_fingerprints(docs, lambda t: fingerprint(t, shingle), id_col, text_col), "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    with small_broadcasts(docs.sparkSession):
        distinct = scratch.put(rows.groupBy("fp").agg(best.alias("best")), "distinct")
        labels = components(thinned(scratch.put(fingerprint_links(distinct), "links")), scratch)
        linked = scratch.put(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "best", F.coalesce("component", "fp").alias("component")), "linked")
        lows = scratch.put(linked.groupBy("component").agg(F.min("best").alias("best")), "lows")
        groups = scratch.put(linked.select("fp", "component").join(lows, "component").select("fp", F.col("best.id").alias("low")), "groups")
    scratch.only("rows", "groups")
    return rows.join(groups.hint("merge"), "fp").select(  # runs later, by the session's own limit of broadcasts
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"),
    )


def with_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, thash, fp, node, n, sketch): word_fingerprint; a hash of the shingle set (texts of equal sets are one node), its size, and of SKETCH buckets which hold an odd number of its hashes, as bits."""
    from xxhash import xxh64_intdigest

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, sizes = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)
            sketches = np.zeros((b.num_rows, SKETCH), np.uint8)
            for i, t in enumerate(b.column(2)):
                words = _hashes(words_of(t.as_py()))
                shingles = shingle_hashes(words, shingle)
                fps[i], nodes[i], sizes[i] = word_fingerprint(words), xxh64_intdigest(shingles.tobytes()), len(shingles)
                sketches[i] = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
            bits = pa.array(np.packbits(sketches, axis=1).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (SKETCH // 64)), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), pa.array(sizes), lists], ["id", "thash", "fp", "node", "n", "sketch"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _text_hash(text).alias("thash"), text.cast("binary").alias("b"))
    return rows.mapInArrow(run, f"id {id_type}, thash long, fp long, node long, n long, sketch array<long>")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets(asked: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Rows (node, shingles) of asked nodes (node, asked: the hash of one of its texts): the hashes of the set, as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["node", "shingles"])

    texts = docs.select(_text_hash(F.col(text_col)).alias("thash"), F.col(text_col).cast("binary").alias("b"))
    return texts.join(asked, F.col("thash") == F.col("asked")).select("node", "b").dropDuplicates(["node"]).mapInArrow(sets, "node long, shingles binary")


def _similar(pairs: DataFrame, made: DataFrame, scratch: Scratch, similarity: float, name: str) -> DataFrame:
    """Of pairs (u, v) of nodes those whose sets (node, shingles) are similar, written."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard(*(np.frombuffer(x[i].as_buffer(), np.uint64) for x in (b.column(2), b.column(3)))) >= similarity for i in range(b.num_rows)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    # sets differ too much in size to be similar: no need to hold them together
    sizes = made.select("node", F.octet_length("shingles").alias("n"))
    fit = pairs.join(sizes.withColumnsRenamed({"node": "u", "n": "nu"}), "u").join(sizes.withColumnsRenamed({"node": "v", "n": "nv"}), "v")
    fit = scratch.put(fit.where(F.least("nu", "nv") >= F.greatest("nu", "nv") * similarity).select("u", "v"), f"fit-{name}")
    left = scratch.put(fit.join(made.withColumnsRenamed({"node": "u", "shingles": "su"}), "u"), f"left-{name}")
    links = left.join(made.withColumnsRenamed({"node": "v", "shingles": "sv"}), "v").select("u", "v", "su", "sv").mapInArrow(check, "u long, v long")
    with small_batches(pairs.sparkSession, SETS):
        links = scratch.put(links, f"similar-{name}")
    scratch.drop(*[f"{k}-{name}" for k in ("fit", "left")])
    return links


def _open(made: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, shared) of the sets (node, shingles) that may be similar to another one: shared counts the shingles that another one has too. Loses none: a similar set shares that part of both."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.fromiter((len(x.as_buffer()) // 8 for x in b.column(1)), np.int64, b.num_rows)
            h = np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.int64) if sizes.any() else np.zeros(0, np.int64)
            nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(h[i : i + 100_000])], ["node", "h"])

    alone = made.mapInArrow(hashes, "node long, h long").groupBy("h").agg(F.min("node").alias("of"), F.count(F.lit(1)).alias("holders"))
    alone = alone.where("holders = 1").groupBy("of").agg(F.count(F.lit(1)).alias("alone"))
    n = (F.octet_length("shingles") / 8).cast("long")
    counted = made.select("node", n.alias("size")).join(alone, F.col("node") == F.col("of"), "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    return counted.where(F.col("shared") >= F.col("size") * similarity - 1e-6).select("node", "shared")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _may_reach(similarity: float, a: str, b: str) -> Column:
    """Whether the sets of two nodes may be similar, by their sketches. Loses none.

    Shingles of both sets leave a bucket's two parities alike, so sets differ in at least as
    many shingles as their sketches in bits; similar ones in at most (1 - s) / (1 + s) of all
    their shingles.
    """
    apart = reduce(add, [F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH // 64)])
    return apart <= (F.col(f"{a}n") + F.col(f"{b}n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _may_share(similarity: float, a: str, b: str) -> Column:
    """The same by what each has in common with any other set: similar ones have s / (1 + s) of all their shingles in common."""
    return F.least(f"{a}shared", f"{b}shared") >= (F.col(f"{a}n") + F.col(f"{b}n")) * (similarity / (1 + similarity)) - 1e-6


def _torn(nodes: DataFrame, links: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes in different groups that may be similar, of fingerprints that met or of one fingerprint: nodes (node, fp, group, n, sketch, shared), links (u, v) of fingerprints."""
    spans = nodes.groupBy("fp").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    of = lambda end: spans.select(F.col("fp").alias(end), F.col("lo").alias(f"lo_{end}"), F.col("hi").alias(f"hi_{end}"))
    torn = links.join(of("u"), "u").join(of("v"), "v").where((F.col("lo_u") != F.col("hi_u")) | (F.col("lo_v") != F.col("hi_v")) | (F.col("lo_u") != F.col("lo_v"))).select("u", "v")
    within = spans.where("lo <> hi").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    torn = scratch.put(torn.union(within), "torn")
    end = lambda c, x: nodes.select(F.col("fp").alias(c), F.col("node").alias(x), F.col("group").alias(f"in_{x}"), *[F.col(k).alias(f"{x}{k}") for k in ("n", "sketch", "shared")])
    return _ordered(torn.join(end("u", "a"), "u").join(end("v", "b"), "v").where((F.col("in_a") != F.col("in_b")) & _may_share(similarity, "a", "b") & _may_reach(similarity, "a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _at_hubs(members: DataFrame) -> DataFrame:
    """Rows (hub, fp, often), distinct, of members (value, fp): all members of a value have one hub in common, the one of them that is a member of most values; of how many, is often."""
    often = members.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("fp")))
    return often.select(F.max(F.struct("often", "fp")).over(Window.partitionBy("value")).alias("x"), "fp").select(F.col("x.fp").alias("hub"), "fp", F.col("x.often").alias("often")).distinct()


#: Of a node at a hub.
AT_HUB = ("fp", "node", "group", "n", "sketch", "shared")


def _led(nodes: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes in different groups that may be similar: at each hub all with the one that shares most of its shingles, in a group of near copies the one least changed. nodes as for `_torn`, hubs: (hub, fp)."""
    at = hubs.join(nodes, "fp").select("hub", *AT_HUB)
    first = at.groupBy("hub").agg(F.max_by(F.struct(*AT_HUB), F.struct(F.col("shared") / F.col("n"), "node")).alias("x"))
    first = first.select(F.col("hub").alias("h"), *[F.col(f"x.{c}").alias(f"o_{c}") for c in AT_HUB])
    led = at.join(first, (F.col("hub") == F.col("h")) & (F.col("group") != F.col("o_group")) & _may_share(similarity, "", "o_") & _may_reach(similarity, "", "o_"))
    return _ordered(led.select(F.col("o_node").alias("u"), F.col("node").alias("v")))


def _apart(nodes: DataFrame, hubs: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes in different groups that may be similar, at values with many: who is not in a hub's largest group, with all others there. nodes as for `_torn`, hubs: (hub, fp)."""
    at = scratch.put(hubs.join(nodes, "fp").select("hub", *AT_HUB), "at")
    sizes = at.groupBy("hub", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max(F.struct("n", "group")).alias("x"), F.count(F.lit(1)).alias("groups"))
    mixed = scratch.put(at.join(sizes.where("groups > 1").select("hub", F.col("x.group").alias("largest")), "hub"), "mixed")
    few = mixed.where(F.col("group") != F.col("largest")).select("hub", *[F.col(c).alias(f"o_{c}") for c in AT_HUB])
    close = _may_share(similarity, "", "o_") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("o_fp"))) <= FAR) & _may_reach(similarity, "", "o_")
    many = few.join(mixed.drop("largest").withColumnRenamed("hub", "h"), (F.col("hub") == F.col("h")) & (F.col("group") != F.col("o_group")) & close)
    return _ordered(many.select(F.col("o_node").alias("u"), F.col("node").alias("v")))


def near_nodes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, thash, node), and for each node its group."""
    with small_batches(docs.sparkSession, SETS):
        rows = scratch.put(with_sets(docs, id_col, text_col, shingle), "rows")
    nodes = scratch.put(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "thash", "n", "sketch")]), "nodes")
    distinct = scratch.put(nodes.groupBy("fp").agg((F.count(F.lit(1)) > 1).alias("several")), "distinct")
    found = scratch.put(met(distinct, 32, meet_all, "u long, v long, member boolean").distinct(), "met")
    links = found.where("not member").select("u", "v")
    hubs = scratch.put(_at_hubs(found.where("member").select(F.col("u").alias("value"), F.col("v").alias("fp"))), "hubs")

    far = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("far")
    ends = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
    closest = ends.union(found.where("member is null").select("u", "v")).select("u", "v", far).groupBy("u").agg(F.min(F.struct("far", "v")).alias("x")).select("u", "x.v")
    several = distinct.where("several").select("fp")
    asked = ends.select(F.col("u").alias("fp")).union(hubs.select("fp")).union(several).distinct()
    asked = scratch.put(nodes.join(asked, "fp").select("node", F.col("thash").alias("asked")), "asked")
    with small_batches(docs.sparkSession, SETS):
        made = scratch.put(_sets(asked, docs, text_col, shingle), "sets")
    shared = scratch.put(_open(made, similarity), "shared")

    label = lambda found: nodes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "fp", F.coalesce("component", "node").alias("group"), "n", "sketch")
    grouped = nodes.select("node", "fp", F.col("node").alias("group"), "n", "sketch")
    still = scratch.put(grouped.join(shared, "node").select("node", "fp"), "open")
    chosen = scratch.put(still.groupBy("fp").agg(F.min("node").alias("one")), "chosen")
    one = lambda end, x: chosen.select(F.col("fp").alias(end), F.col("one").alias(x))
    first = closest.join(one("u", "a"), "u").join(one("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = still.join(chosen, "fp").where("node <> one").select(F.col("node").alias("u"), F.col("one").alias("v"))
    compared, alike = None, None
    rounds = (lambda g: _ordered(first.union(same)), lambda g: _led(g, hubs, similarity), lambda g: _torn(g, links, scratch, similarity), lambda g: _apart(g, hubs, scratch, similarity))
    for k, pairs_of in enumerate(rounds, 1):  # each leaves the next fewer groups, and so fewer pairs
        pairs = pairs_of(grouped.join(shared, "node"))
        pairs = scratch.put(pairs if compared is None else pairs.join(compared, ["u", "v"], "left_anti"), f"pairs-{k}")
        if k > 1 and pairs.isEmpty():
            continue
        found = _similar(pairs, made, scratch, similarity, str(k))
        compared, alike = (pairs, found) if compared is None else (compared.union(pairs), alike.union(found))
        # few links need few tasks: of up to SLICE they come out as stars, and no round of many small tables follows
        few = alike.repartition(-(-alike.count() // SLICE) or 1)
        grouped = scratch.put(label(components(thinned(few), scratch)), f"grouped-{k}")
    scratch.only("rows", *(f"grouped-{k}" for k in range(1, 5)))
    return rows.select("id", "thash", "node"), grouped.select("node", "group")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id_col and component_id, the smallest id of its group of near copies (nulls last).

    Texts are linked where the Jaccard similarity of their shingle sets reaches `similarity`
    (words as for `simhash_groups`; null or word-less texts have empty sets, alike with each
    other); groups are what links reach. Repeated rows come out once each; an empty table
    gives no rows; whole texts count; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    with small_broadcasts(docs.sparkSession):
        rows, groups = near_nodes(docs, scratch, id_col, text_col, similarity, shingle)
        named = scratch.put(rows.join(groups, "node").select("id", "group"), "named")
        best = scratch.put(named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("best")), "lows")
    return named.join(best.hint("merge"), "group").select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of `near_groups`, with all its columns: the one of smallest id
    (nulls last), then of smallest text hash.

    Of rows that repeat id and text one stays, of their other columns the least. An empty
    table gives no rows; whole texts count.
    """
    scratch = Scratch(docs.sparkSession, "near")
    with small_broadcasts(docs.sparkSession):
        rows, groups = near_nodes(docs, scratch, id_col, text_col, similarity, shingle)
        best = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "thash")).alias("best"))
        kept = best.join(groups, "node").groupBy("group").agg(F.min("best").alias("best")).select("best.id", "best.thash")
        kept = scratch.put(kept, "kept")
    mine = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("hash"))
    out = mine.join(kept.hint("merge"), F.col("hash").eqNullSafe(F.col("thash")) & mine.id.eqNullSafe(kept.id), "left_semi")
    repeated = not rows.groupBy("id", "thash").count().where("count > 1").isEmpty()
    scratch.only("kept")
    if repeated:
        out = out.groupBy("id", "hash").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return out.select("doc.*")
