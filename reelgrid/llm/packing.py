"""Concatenate and cut: all documents are one stream of token ids, cut every `window` ids.

Pass one tokenizes each document once and writes its ids with its place inside its
partition. A prefix sum over the partition totals then gives every document its place in
the stream, and pass two cuts each document where it crosses a window's edge: a document
that crosses has a boundary piece on each side. Nothing is sorted or shuffled.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch

WINDOW = 2048
#: A worker remembers the ids of the last so many to twice so many distinct words, over all its tasks.
MEMO = 300_000


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Latin letters, then ASCII punctuation: two tokens of the pre-tokenizer.
WORD = re.compile(r"([A-Za-z\u00AA-\u024F]+)([!-/:-@\[-`{-~]*)")


def _byte_letters(split) -> dict[int, str]:
    """How the vocabulary shows each byte of two-byte letters, asked of its pre-tokenizer."""
    shown = {}
    for code in range(0x80, 0x250):
        if chr(code).isalpha():
            piece = split(chr(code))[0][0]
            shown |= dict(zip(chr(code).encode(), piece, strict=True))
    return shown


def encoder(path: str, plain_specials: bool = False):
    """Text -> ids as little-endian bytes of `width` each, equal to the tokenizers library's encode of the whole text without special tokens added.

    Strings of special tokens inside a text get those tokens' ids, as the library has it;
    with plain_specials they are ordinary text. Where all white space is single spaces and
    line feeds between other characters, the vocabulary's pre-tokenizer begins a new token
    before each of them, so the text is encoded word by word and the words' ids remembered:
    a word's pieces by the library's pre-tokenizer, their ids by its model. Other texts, and
    those with a special token's string, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
    specials = () if plain_specials else tuple(t.content for t in tok.get_added_tokens_decoder().values())
    raw = [np.array([i], dtype).tobytes() for i in range(tok.get_vocab_size())]
    merge, split = tok.model.tokenize, tok.pre_tokenizer.pre_tokenize_str
    by_word = tok.normalizer is None

    def whole(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype).tobytes()

    def word(text: str) -> bytes:
        return b"".join([raw[t.id] for piece, _ in split(text) for t in merge(piece)])

    def letters(lead: str, w: str) -> bytes:
        piece = lead + (w if w.isascii() else w.encode().decode("latin-1").translate(shown))
        return b"".join([raw[t.id] for t in merge(piece)])

    space, line = (split(c + "a")[0][0][:-1] if by_word else "" for c in " \n")
    feed = word("\n") if by_word else b""
    by_word = by_word and bool(space) and not line  # a space is the beginning of the next token, a line feed one of its own
    shown = _byte_letters(split) if by_word else {}

    class Tails(dict):
        def __missing__(self, t: str) -> bytes:
            out = self[t] = word(t)
            return out

    class Memo(dict):
        older: dict[str, bytes] = {}
        tails = Tails()

        def __missing__(self, w: str) -> bytes:
            new_line = w[0] == "\n"
            m = WORD.fullmatch(w, new_line)
            if w in self.older:
                out = self.older[w]
            elif m and m[1].isalpha():
                head, tail = m[1], m[2]
                if new_line:
                    out = feed + letters("", head)
                else:
                    out = self[head] if tail else letters(space, head)
                if tail:
                    out += self.tails[tail] if len(tail) < 8 else word(tail)
            else:
                out = word(w if new_line else " " + w)
            if len(w) < 64:
                if len(self) >= MEMO:
                    self.older = dict(self)
                    self.clear()
                self[w] = out
            return out

    ids_of = Memo().__getitem__

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not by_word or any(s in text for s in specials) or " ".join(text.split()) != text.replace("\n", " "):
            return whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return word(first) + b"".join(map(ids_of, words))

    return encode, dtype


def shared_encoder(path: str, plain_specials: bool = False):
    """This process's one encoder of a vocabulary. Kept in a module of its own: code that came by value with a task has new globals each time."""
    kept = sys.modules.setdefault("_reelgrid_worker", types.ModuleType("_reelgrid_worker")).__dict__
    key = f"encoder {plain_specials} {path}"
    if key not in kept:
        kept[key] = encoder(path, plain_specials)
    return kept[key]


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, plain_specials: bool = False) -> DataFrame:
    """Rows (id, part, at, n, width, ids): the document's place inside its partition, and its ids with end_id last."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = shared_encoder(path, plain_specials)
        end, part, at = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                ids = [encode(t.as_py() or "") + end for t in b.column(1)]
                n = [len(x) // dtype.itemsize for x in ids]
                ends = list(accumulate(n, initial=at))
                at = ends.pop()
                k = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([part] * k, pa.int64()), pa.array(ends, pa.int64()), pa.array(n, pa.int64()), pa.array([dtype.itemsize] * k, pa.int32()), pa.array(ids, pa.binary())],
                    ["id", "part", "at", "n", "width", "ids"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, part long, at long, n long, width int, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None, end_id: int = 1, plain_specials: bool = False) -> DataFrame:
    """Pieces: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Null or empty text: the end id alone. Every id of every row lies in exactly one piece;
    all sequences but the last are full. Repeated rows are packed each time; an empty
    table gives no rows; other columns are not read. Whole texts count; a document's ids are
    one binary cell. Strings of special tokens inside texts get those tokens' ids unless
    plain_specials is set.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.put(tokenized(docs, id_col, text_col, path or public_vocabulary(), end_id, plain_specials), "ids")
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per input split
    before = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                part, at, n, width = (b.column(i).to_pylist() for i in range(1, 5))
                out: list[list] = [[] for _ in range(7)]
                for k in range(b.num_rows):
                    ids = np.frombuffer(b.column(5)[k].as_buffer(), f"<u{width[k]}").astype("<u4")
                    here, start = before[part[k]] + at[k], 0
                    while start < n[k]:
                        sequence, offset = divmod(here + start, window)
                        length = min(window - offset, n[k] - start)
                        for column, value in zip(out, (k, start, length, n[k], sequence, offset, ids[start : start + length].tobytes()), strict=True):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:6]), pa.array(out[6], pa.binary())],
                    ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return rows.mapInArrow(cut, f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id_col)
