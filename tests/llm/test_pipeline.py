"""Each stage on its predecessor's rows against a plain reading of the stage, and the whole."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from reelgrid.llm.langid import Subwords, predict, train, training_sample
from reelgrid.llm.mixing import mix_plan
from reelgrid.llm.packing import public_vocabulary
from reelgrid.llm.queries import oracle_sql, queries


def test_registry():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) == 13


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    model, words = train(*training_sample(docs)), Subwords()
    kept = stage["language"](spark, docs, sf).cache()
    assert kept.columns == columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if not predict(model, words, r.text)[2])

    exact = stage["exact_dedup"](spark, kept, sf).cache()
    best = defaultdict(list)
    for r in kept.collect():
        best[norm(r.text)].append((-len(r.text or ""), r.doc_id))
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(min(v)[1] for v in best.values())

    near = stage["near_dedup"](spark, exact, sf).cache()
    rows = exact.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    low = {i: i for i in sets}
    find = lambda x: x if low[x] == x else find(low[x])
    ids, pairs = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                low[max(find(a), find(b))] = min(find(a), find(b))
    left = Counter(find(r.doc_id) for r in near.collect())
    assert near.columns == columns and set(left) == {find(i) for i in ids}
    assert sum(left.values()) - len(left) <= 0.1 * (len(ids) - len(left)) if pairs > 9 else sum(left.values()) - len(left) <= 1

    mixed = stage["mixing"](spark, near, sf).cache()
    copies = {r.doc_id: r.copies for r in mix_plan(near).collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    tok = Tokenizer.from_file(public_vocabulary())
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])] += 1
    streams, got = defaultdict(list), Counter()
    for r in pipeline.run(spark, sf).collect():
        streams[r.sequence_id].append((r.offset, r.doc_id, r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    held = []
    for s in sorted(streams):
        at = 0
        for offset, doc, start, n, ids_here in sorted(streams[s]):
            assert offset == at and (start == 0) == (not held)
            at += len(ids_here)
            held += ids_here
            if len(held) == n:
                got[doc, tuple(held)] += 1
                held = []
        assert at == 2048 or s == max(streams)
    assert got == want and not held


@pytest.mark.parametrize("case", ["empty", "null", "doubled", "clashing"])
def test_run_of_odd_tables(spark, tmp_path, case):
    """An empty table and one of nulls give no rows; rows given twice come out as if once; columns of other names go through."""
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = {
        "empty": some.limit(0), "null": some.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema]), "doubled": some.union(some),
        "clashing": some.select("*", *[F.lit(7).alias(n) for n in ("id", "fp", "thash", "doc", "u", "v", "kept", "at", "n", "ids", "part", "hash", "key", "rate", "seed")]),
    }[case]
    folder = str(tmp_path / case)
    odd.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    rows = pipeline.run(spark, folder)
    if case in ("empty", "null"):
        assert rows.count() == 0
        return
    some.coalesce(2).write.parquet(f"{folder}/once/documents.parquet")
    once = pipeline.run(spark, f"{folder}/once")
    texts = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    if case == "clashing":
        assert texts(rows) == texts(once)
    else:  # the language model is trained on other weights of the same rows, and the mix has other sizes
        assert len(texts(rows) ^ texts(once)) <= 0.2 * len(texts(once))
