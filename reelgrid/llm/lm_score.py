"""Scoring texts by a subword lattice: the log probability summed over all segmentations.

A text is its words (A-Z lower-cased), each after a word mark, and one end. A word's probability
is the sum over all ways to write it as pieces of an existing vocabulary, by a forward
recursion in log space over its bytes; all 256 bytes are pieces too, so that every text has a
probability. Piece weights start from the vocabulary's own scores (log probabilities as they
are; where they are merge ranks, as weights of a Zipf law over the ranks) and are fitted to the
training words by expectation-maximisation over the same lattices, the first weights staying as
a prior of one count a piece.

The corpus is read twice. The first pass counts words, in tasks before the shuffle; the table
of all words, with counts and log probabilities, grows with the corpus. The second sums up each
document: the most frequent words (bounded in number and length) are known to every task, all
others are joined by word, where none can be frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch

ROUNDS = 3
#: Words that every task holds: so many at most, of so many bytes at most.
HEAD, HEAD_BYTES = 1 << 16, 64
#: The end of a text among the words; no word holds a line feed.
END = b"\n"
_KEPT = 500_000  # words counted in a task before they are handed on
_CELLS = 1 << 21  # word x position x piece length held at a time
_UNIT = 1 << 20  # expected counts are added as whole numbers of this share
_FINE = 16  # steps of the head's threshold in a doubling of the count


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space for the word mark, and their first weights (sum 1). Pieces that no word can hold are left out; missing bytes are added."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    raw: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            raw[bytes([int(name[3:5], 16)])] = score
            continue
        piece = name.encode()
        mark = "▁".encode()
        piece = b" " + piece[len(mark) :] if piece.startswith(mark) else piece
        if mark not in piece and not any(c in b"\t\n\v\f\r " for c in piece[1:]) and piece[:1] not in (b"\t", b"\n", b"\v", b"\f", b"\r"):
            scored[piece] = max(score, scored.get(piece, score))
    least = min(scored.values(), default=0.0)
    for b in range(256):
        scored.setdefault(bytes([b]), least - 1)
    names = sorted(scored, key=lambda p: (-scored[p], p))
    values = np.array([scored[p] for p in names])
    with np.errstate(over="ignore"):
        weight = np.exp(values)
    if not 0.5 <= weight.sum() <= 1.5:  # not log probabilities: ranks
        weight = 1.0 / (np.arange(len(names)) + 2.7)
    return names, weight / weight.sum()


class Lattice:
    """All segmentations of words into pieces, many words of one length at a time."""

    def __init__(self, pieces: list[bytes]):
        child: dict[tuple[int, int], int] = {}
        piece_at: dict[int, int] = {}
        for number, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                node = child.setdefault((node, byte), len(child) + 1)
            piece_at[node] = number
        keys = np.array([n * 256 + b for n, b in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        self.piece = np.full(len(child) + 1, -1, np.int64)
        self.piece[list(piece_at)] = list(piece_at.values())
        self.longest = max(map(len, pieces))
        # the first two steps of every walk by table
        self.first = np.full(256, -1, np.int64)
        self.first[self.keys[self.keys < 256]] = self.to[self.keys < 256]
        self.second = np.full(65536, -1, np.int64)
        for byte, node in enumerate(self.first):
            if node >= 0:
                lo, hi = np.searchsorted(self.keys, [node * 256, node * 256 + 256])
                self.second[byte * 256 + self.keys[lo:hi] % 256] = self.to[lo:hi]

    def edges(self, text: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, length, piece) of the pieces that start at lo to hi - 1 of the rows of bytes."""
        rows, size = text.shape
        row, start = np.repeat(np.arange(rows), hi - lo), np.tile(np.arange(lo, hi), rows)
        node, found = np.zeros(len(row), np.int64), []
        for length in range(1, self.longest + 1):
            byte = text[row, start + length - 1].astype(np.int64)
            if length == 1:
                node = self.first[byte]
            elif length == 2:
                node = self.second[text[row, start].astype(np.int64) * 256 + byte]
            else:
                key = node * 256 + byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                node = np.where(self.keys[at] == key, self.to[at], -1)
            known = node >= 0
            row, start, node = row[known], start[known], node[known]
            ends = self.piece[node] >= 0
            found.append((row[ends], start[ends], np.full(int(ends.sum()), length), self.piece[node[ends]]))
            inside = start + length < size
            row, start, node = row[inside], start[inside], node[inside]
            if not len(row):
                break
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def stretches(self, text: np.ndarray) -> list[tuple[int, int]]:
        step = max(1, _CELLS // (len(text) * self.longest))
        return [(lo, min(lo + step, text.shape[1])) for lo in range(0, text.shape[1], step)]

    def walked(self, text: np.ndarray, lo: int, hi: int, logp: np.ndarray):
        """The edges that start at lo to hi - 1, and their log probabilities by start, length and row."""
        row, start, length, piece = edges = self.edges(text, lo, hi)
        step = np.full((hi - lo, int(length.max()), len(text)), -np.inf)
        step[start - lo, length - 1, row] = logp[piece]
        return edges, step

    def forward(self, text: np.ndarray, logp: np.ndarray, walked=None) -> np.ndarray:
        """Log probability of every prefix: (positions + 1) x rows."""
        n = text.shape[1]
        alpha = np.full((n + 1, len(text)), -np.inf)
        alpha[0] = 0
        for lo, hi in self.stretches(text):
            _, step = walked or self.walked(text, lo, hi, logp)
            for s in range(lo, hi):
                k = min(step.shape[1], n - s)
                alpha[s + 1 : s + 1 + k] = np.logaddexp(alpha[s + 1 : s + 1 + k], alpha[s] + step[s - lo, :k])
        return alpha

    def expected(self, text: np.ndarray, times: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words that occur so many times."""
        n, stretches = text.shape[1], self.stretches(text)
        once = self.walked(text, 0, n, logp) if len(stretches) == 1 else None
        alpha = self.forward(text, logp, once)
        beta = np.full((n + 1, len(text)), -np.inf)
        beta[n] = 0
        out = np.zeros(len(logp))
        for lo, hi in reversed(stretches):
            (row, start, length, piece), step = once or self.walked(text, lo, hi, logp)
            for s in range(hi - 1, lo - 1, -1):
                k = min(step.shape[1], n - s)
                beta[s] = np.logaddexp.reduce(beta[s + 1 : s + 1 + k] + step[s - lo, :k], 0)
            share = np.exp(alpha[start, row] + logp[piece] + beta[start + length, row] - alpha[n, row])
            out += np.bincount(piece, share * times[row], len(logp))
        return out


def by_size(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their bytes after the word mark as a matrix), words of one length at a time and bounded many."""
    sizes = np.array([len(w) for w in words], np.int64)
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        step = max(1, _CELLS // (32 * (int(n) + 1)))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            yield some, np.frombuffer(b"".join([b" " + words[i] for i in some]), np.uint8).reshape(len(some), -1)


def log10_words(lattice: Lattice, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words))
    for some, text in by_size(words):
        out[some] = lattice.forward(text, logp)[-1] / np.log(10)
    return out


def _texts(b: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of each text. bytes.split and bytes.lower know ASCII alone: white space of the contract, A-Z."""
    for t in b.column("t"):
        yield (t.as_py() or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their number in training documents; a word of held-out documents alone has 0."""
    train, other = Counter(), set()

    def flush() -> pa.RecordBatch:
        for w in other:
            train.setdefault(w, 0)
        out = pa.RecordBatch.from_arrays([pa.array(list(train), pa.binary()), pa.array(list(train.values()), pa.int64())], ["word", "c"])
        train.clear()
        other.clear()
        return out

    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            for words, held in zip(_texts(b), b.column("held").to_pylist(), strict=True):
                if held:
                    other.update(words)
                    other.add(END)
                else:
                    train.update(words)
                    train[END] += 1
                if len(train) + len(other) > _KEPT:
                    yield flush()
    if train or other:
        yield flush()


def fitted(words: DataFrame, lattice: Lattice, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Natural log probability of each piece and of the end, by rounds of expectation-maximisation over all training words."""
    texts = words.where("c > 0").agg(F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()[0] or 0
    inner = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    counts = np.zeros(len(prior))

    def weights() -> tuple[np.ndarray, float]:
        mass = counts + prior * len(prior)  # one count a piece, and one of the end, come from the vocabulary
        total = mass.sum() + texts + 1
        return np.log(mass / total), float(np.log((texts + 1) / total))

    for _ in range(rounds):
        logp, _ = weights()

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(logp))
            for b in batches:
                words, times = b.column("word").to_pylist(), b.column("c").to_numpy().astype(float)
                for some, text in by_size(words):
                    total += lattice.expected(text, times[some], logp)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(total[at] * _UNIT).astype(np.int64))], ["piece", "n"])

        found = inner.select("word", "c").mapInArrow(expect, "piece long, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        counts = np.zeros(len(prior))  # a number a piece of the vocabulary
        for r in found:
            counts[r.piece] = int(r.n) / _UNIT
    return weights()


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folds: int = 7, held_fold: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Documents whose crc32(id as text) mod `folds` is held_fold are held out, the others train
    (a null id counts as an empty text). A null text is empty: the end alone. base_score is the
    add-one word model's, score the lattice's. Repeated rows are scored and trained on each time;
    texts and words of any length count whole; an empty table gives no rows, and with no
    training document base_score is that of a single unseen kind of token and the weights are
    the vocabulary's. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    id_type = docs.schema[id_col].dataType.simpleString()
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), (crc % folds == held_fold).alias("held"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number: few bytes make much work here
    counted = rows.select("t", "held").mapInArrow(_count, "word binary, c long").repartition(tasks, "word")
    words = scratch.put(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    names, prior = vocabulary(path or public_pieces())
    lattice = Lattice(names)
    logp, end = fitted(words, lattice, prior, rounds)
    end10 = end / np.log(10)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("word").to_pylist()
            found = log10_words(lattice, logp, of)
            found[[i for i, w in enumerate(of) if w == END]] = end10
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], ["word", "c", "lp"])

    weighed = scratch.put(words.mapInArrow(weigh, "word binary, c long, lp double"), "weighed")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    scratch.drop("words")
    under = float(np.log10(sums.n + sums.v + 1))
    lexicon = weighed.select("word", F.col("c") > 0, F.log10(F.col("c") + 1) - under, "lp").toDF("word", "known", "base", "lp")

    # the least count at which the frequent words are few enough, from counts of counts
    level = F.floor(F.log2(F.col("c").cast("double")) * _FINE)
    short = weighed.where((F.col("c") > 0) & (F.length("word") <= HEAD_BYTES))
    least, many = None, 0
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        many += r["count"]
        if many > HEAD:
            break
        least = r.level
    head_words = [] if least is None else short.where(level >= least).select("word").join(lexicon, "word").collect()
    head = spark.sparkContext.broadcast({bytes(r.word): (r.known, r.base, r.lp) for r in head_words})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, part, at = head.value, TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                key, word, times, done = [], [], [], []
                for words in _texts(b):
                    mine = (part << 33) + at
                    at += 1
                    known = base = lp = 0
                    counts = Counter(words)
                    counts[END] = 1
                    for w, k in counts.items():
                        of = known_words.get(w)
                        if of is None:
                            key.append(mine)
                            word.append(w)
                            times.append(k)
                        else:
                            known += k * of[0]
                            base += k * of[1]
                            lp += k * of[2]
                    done.append((mine, len(words) + 1, known, float(base), float(lp)))
                of_docs, none = list(zip(*done, strict=True)), [None] * len(done)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of_docs[0], pa.int64()), b.column("id"), b.column("held"), pa.array(of_docs[1], pa.int64()), pa.array(none, pa.binary()), pa.array(of_docs[2], pa.int64()),
                     pa.array(of_docs[3], pa.float64()), pa.array(of_docs[4], pa.float64())], ["key", "id", "held", "n", "word", "known", "base", "lp"],
                )
                rare = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.nulls(rare, b.schema.field("id").type), pa.nulls(rare, pa.bool_()), pa.array(times, pa.int64()), pa.array(word, pa.binary()), pa.nulls(rare, pa.int64()),
                     pa.nulls(rare, pa.float64()), pa.nulls(rare, pa.float64())], ["key", "id", "held", "n", "word", "known", "base", "lp"],
                )

    parts = rows.mapInArrow(score, f"key long, id {id_type}, held boolean, n long, word binary, known long, base double, lp double")
    parts = scratch.put(parts, "parts")
    of_docs = parts.where("word is null").select("key", "id", "held", "n", "known", "base", "lp")
    rare = parts.where("word is not null").select("key", "n", "word").join(lexicon, "word")
    times = F.col("n")
    rare = rare.select(
        "key", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("long").alias("n"),
        F.when(F.col("known"), times).otherwise(0).alias("known"), (times * F.col("base")).alias("base"), (times * F.col("lp")).alias("lp"),
    )
    out = of_docs.unionByName(rare).groupBy("key").agg(
        F.max("id").alias(id_col), F.bool_or("held").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"),
    )
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(sums.n)).cast("long").alias("train_tokens"), "base_score", "score")
