"""Phrase collocations: contiguous phrases of two to four words that occur together more than apart.

Words are counted first. A word that occurs often enough to be part of a candidate is encoded:
its id is the 64-bit hash of language and word (no two words of the corpus share one, which is
checked; another seed is taken else), and every other word breaks its piece. Which words are
frequent reaches the tasks as a bit table of fixed size over the ids: an infrequent word that
falls on a set bit costs work, not correctness, as its phrases are counted and found too rare.

Id n-grams become keys of fixed width: the first word of a key mixes all ids (odd factors, so
that it and the other ids give the first id back), and is spread evenly. Tasks sort and
run-length count their keys, cut them at equal ranges of the first word and hand on one packed
block a range; a range's blocks are then radix-sorted and run-length counted again. Longer
phrases are counted only where all their pairs may be frequent, by a bit table of the pairs.
No key is hot after a task's own count: it reaches its range once a task and flush.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer phrase around it has at least this many hundredths of its occurrences.
COVERED = 80
#: Bits of the tables of frequent words and pairs (16 MB each, at any size of corpus).
FILTER_BITS = 27
#: Words of the corpus to one range of keys; tasks that ranges are dealt to at most, each of which does one after the other; numbers of keys that a task holds before it counts and hands on.
RANGE_WORDS, TASKS, HELD = 2_000_000, 20_000, 4_000_000
_SLICE_BITS = 19  # of a bit table, in one row
# Odd factors of the four places of a key; their values are free (digits of the golden ratio and others of xxHash's kind).
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
#: A-Z to lower case, tabs to spaces, the ends of pieces to a full stop.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz .........")


def _tokens(text: bytes | None) -> list[bytes]:
    """Words, and b"." where a piece ends."""
    return (text or b"").translate(_PLAIN).replace(b".", b" . ").split()


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word, seed) or 1


def _signed(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.view(np.int64))


def counted_words(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n of every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                words.pop(b".", None)
                ids = np.array([_hash(lang, w, seed) for w in words], np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(ids), pa.array([lang] * len(words), pa.binary()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["id", "lang", "word", "n"])
            found.clear()

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                for lang, t in zip(b.column("lang").to_pylist(), b.column("t"), strict=True):
                    found.setdefault(lang, Counter()).update(_tokens(t.as_py()))
                if sum(map(len, found.values())) > 500_000:
                    yield from flush()
        yield from flush()

    parts = texts.mapInArrow(run, "id long, lang binary, word binary, n long")
    return parts.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def bit_table(ids: DataFrame) -> np.ndarray:
    """ids (id) as a table of 2^FILTER_BITS bits, of which the id's low bits choose one. Its size is fixed; slices are made where their ids meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("id").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            piece, bit = (at >> np.uint64(_SLICE_BITS)).astype(np.int64), (at & np.uint64((1 << _SLICE_BITS) - 1)).astype(np.int64)
            for k in np.unique(piece):
                bits = made.setdefault(int(k), np.zeros(1 << (_SLICE_BITS - 3), np.uint8))
                some = bit[piece == k]
                np.bitwise_or.at(bits, some >> 3, (1 << (some & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([m.tobytes() for m in made.values()], pa.binary())], ["k", "bits"])

    where = F.shiftright(F.col("id").bitwiseAND((1 << FILTER_BITS) - 1), _SLICE_BITS)
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in ids.select("id").repartition(where).mapInArrow(run, "k long, bits binary").collect():
        table[r.k << (_SLICE_BITS - 3) : (r.k + 1) << (_SLICE_BITS - 3)] |= np.frombuffer(r.bits, np.uint8)
    return table


def _in_table(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = (ids & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """First word of the key of n-grams given by their columns of ids."""
    total = np.zeros(len(parts[0]), np.uint64)
    for ids, factor in zip(parts, _MIX, strict=False):
        total += ids * factor
    return total ^ (total >> np.uint64(32))


def radix_order(first: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit numbers, sixteen bits at a time; numpy sorts those by counting."""
    order = np.argsort((first & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in (16, 32, 48):
        digit = ((first >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of equally many words, the mixed one first) in order, and the sums of n over equal ones."""
    if not len(keys):
        return keys, n
    order = radix_order(keys[:, 0])
    keys, n = keys[order], n[order]
    same_first = keys[1:, 0] == keys[:-1, 0]
    if (same_first & (keys[1:, 1:] != keys[:-1, 1:]).any(1)).any():  # unlike keys of one mixed word may lie in turns
        order = np.lexsort(keys.T[::-1])
        keys, n = keys[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[begins], np.add.reduceat(n, begins)


def _frequent(texts: DataFrame, sizes: tuple[int, ...], words: np.ndarray, pairs: np.ndarray | None, seed: int, ranges: int, least: int) -> DataFrame:
    """ids (array), n of the n-grams of these sizes that occur at least `least` times."""
    width = max(sizes)
    spark = texts.sparkSession
    tables = spark.sparkContext.broadcast((words, pairs))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = tables.value
        known: dict[bytes, dict[bytes, int]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            keys, n = run_lengths(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            # equal ranges of the mixed word: its upper half, scaled
            place = ((keys[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            for lo in range(0, len(edges) - 1, 1000):
                some = edges[lo : lo + 1001]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[some[:-1]]), pa.array([keys[i:j].tobytes() for i, j in zip(some[:-1], some[1:], strict=True)], pa.binary()),
                     pa.array([n[i:j].astype("<i8").tobytes() for i, j in zip(some[:-1], some[1:], strict=True)], pa.binary())], ["place", "keys", "n"],
                )

        def grams(ids: np.ndarray) -> None:
            follows = (ids[:-1] != 0) & (ids[1:] != 0)  # a pair begins here
            if pairs is not None:
                at = np.flatnonzero(follows)
                follows[at] = _in_table(pairs, mixed([ids[at], ids[at + 1]]))
            for m in sizes:
                if len(ids) < m:
                    continue
                begins = np.flatnonzero(np.logical_and.reduce([follows[i : len(follows) - (m - 2) + i] for i in range(m - 1)]))
                columns = [ids[begins + i] for i in range(m)]
                keys = np.zeros((len(begins), width), np.uint64)
                keys[:, 0] = mixed(columns)
                for i in range(1, m):
                    keys[:, i] = columns[i]
                held.append(run_lengths(keys, np.ones(len(keys), np.int64)))

        ids: list[int] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                for lang, t in zip(b.column("lang").to_pylist(), b.column("t"), strict=True):
                    memo = known.setdefault(lang, {b".": 0})
                    tokens = _tokens(t.as_py())
                    new = [w for w in set(tokens) if w not in memo]
                    if new:
                        hashes = np.array([_hash(lang, w, seed) for w in new], np.uint64)
                        memo.update(zip(new, np.where(_in_table(words, hashes), hashes, np.uint64(0)).tolist(), strict=True))
                    ids += map(memo.__getitem__, tokens)
                    ids.append(0)
                if len(ids) >= HELD // 8:
                    grams(np.array(ids, np.uint64))
                    ids = []
                if sum(k.size for k, _ in held) >= HELD:
                    yield from blocks()
                if sum(map(len, known.values())) > 300_000:
                    known.clear()
        grams(np.array(ids, np.uint64))
        if held:
            yield from blocks()

    def counted(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, n = run_lengths(np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, width) for k, _ in held]), np.concatenate([np.frombuffer(n, np.int64) for _, n in held]))
        keys, n = keys[n >= least], n[n >= least]
        first = _first_ids(keys)
        for at in range(0, len(n), 10_000):
            rows = [[a, *(x for x in rest if x)] for a, rest in zip(first[at : at + 10_000].view(np.int64).tolist(), keys[at : at + 10_000, 1:].view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(n[at : at + 10_000])], ["ids", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range after the other; rows come in their order."""
        here, held = None, []
        for b in batches:
            for place, k, n in zip(*(b.column(c).to_pylist() for c in ("place", "keys", "n")), strict=True):
                if place != here and held:
                    yield from counted(held)
                    held = []
                here = place
                held.append((k, n))
        if held:
            yield from counted(held)

    packed = texts.mapInArrow(pack, "place long, keys binary, n binary")
    tasks = min(ranges, TASKS)
    dealt = packed.repartitionById(tasks, F.floor(F.col("place") * tasks / ranges).cast("int")).sortWithinPartitions("place")
    return dealt.mapInArrow(count, "ids array<long>, n long")


def _first_ids(keys: np.ndarray) -> np.ndarray:
    """The first id, from the mixed word and the other ids."""
    total = keys[:, 0] ^ (keys[:, 0] >> np.uint64(32))
    for i in range(1, keys.shape[1]):
        total = total - keys[:, i] * _MIX[i]
    return total * np.uint64(pow(int(_MIX[0]), -1, 1 << 64))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(25,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words that occur at least `least` times.

    a: occurrences of the phrase, l and r those of its two parts at the cut of lowest score, n:
    words of the language, score: floor(2000000 a / (l + r)). A phrase inside a longer one that
    occurs COVERED hundredths as often or more is left out. Null language: `und`; null text:
    empty. Repeated rows count each time; texts and words of any length count whole; ties in
    score and a are ordered by phrase; a language without a candidate, and an empty table, give
    no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("t"))
    for seed in range(42, 64):
        words = scratch.put(counted_words(texts, seed), "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise ArithmeticError("words share ids under every seed")
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    total = words.agg(F.sum("n")).first()[0] or 0
    ranges = min(1 << 31, max(1, -(-total // range_words)))
    frequent = scratch.put(words.where(F.col("n") >= least), "frequent")
    bits = bit_table(frequent)
    pairs = scratch.put(_frequent(texts, (2,), bits, None, seed, ranges, least), "pairs")

    def pair_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([_signed(mixed([ids[:, 0], ids[:, 1]]))], ["id"])

    pair_bits = bit_table(pairs.select("ids").mapInArrow(pair_codes, "id long"))
    longer = scratch.put(_frequent(texts, (3, 4), bits, pair_bits, seed, ranges, least), "longer")

    phrases = pairs.unionByName(longer)
    m = F.size("ids")
    known = scratch.put(phrases.unionByName(frequent.select(F.array("id").alias("ids"), "n")), "known")
    cuts = phrases.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, m - F.col("k")).alias("right"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("cast(cast(a as decimal(25,0)) * 2000000 div (cast(l as decimal(25,0)) + cast(r as decimal(25,0))) as long)")
    best = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    around = phrases.where(m > 2).select(F.col("n").alias("longer"), "ids", F.explode(F.sequence(F.lit(2), m - 1)).alias("size"))
    around = around.select("longer", F.explode(F.transform(F.sequence(F.lit(1), m - F.col("size") + 1), lambda i: F.slice("ids", i, F.col("size")))).alias("ids"))
    best = best.join(around.groupBy("ids").agg(F.max("longer").alias("longer")), "ids", "left")
    best = best.where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * COVERED)).select("ids", "a", "cut.score", "cut.l", "cut.r")
    best = scratch.put(best, "best")

    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))  # four words at most
    named = best.join(spelled, "ids").select(
        "lang", F.array_join(F.transform("w", lambda w: w["word"].cast("string")), " ").alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("salt"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)  # so one language's last window sees 64 * top rows at most
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
