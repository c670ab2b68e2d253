"""Whitening, language-model scoring and phrases against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from reelgrid.llm import lm_score, phrases
from reelgrid.llm.lm_score import Lattice, lm_scores, log10_words, public_pieces, vocabulary
from reelgrid.llm.phrases import collocations, mixed, run_lengths
from reelgrid.llm.whitening import _deviations, dd_add, outer_sum, spectrum, whiten

# --- whitening


def test_sums_of_products_are_exact():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(900, 3)) * [1.0, 1e9, 1e-7] + [0.0, 3.0, 0.0]
    low = c * 2.0**-54 * rng.uniform(-1, 1, c.shape)
    got = outer_sum((c, low))
    got = dd_add(got, outer_sum((c[:5], low[:5])))
    exact = [[Fraction(a) + Fraction(b) for a, b in zip(r, s, strict=True)] for r, s in zip(c.tolist() + c[:5].tolist(), low.tolist() + low[:5].tolist(), strict=True)]
    for i in range(3):
        for j in range(3):
            want = sum(r[i] * r[j] for r in exact)
            size = sum(abs(r[i] * r[j]) for r in exact)
            assert abs(Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - want) <= size * Fraction(1, 2**88)


def test_spectrum():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    want = np.concatenate([[5.0, 5.0, 5.0 - 1e-9], np.geomspace(3, 1e-8, 37)])
    a = (q * want) @ q.T
    a = (a + a.T) / 2
    values, x = spectrum((a, np.zeros_like(a)))
    assert np.allclose(values, want, rtol=0, atol=2e-14)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15 * 8
    assert np.abs(a @ x - x * values).max() < 1e-14


def plain_whitening(rows, components=16):
    """rows: (id, vector); exact centring by fractions."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = sorted({tuple(v) for v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(sum(Fraction(n * v[i] - s[i], n) * Fraction(n * v[j] - s[j], n) for v in fit) / n) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > e[0] * 2.0**-40).sum()))
    c = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    return [i for i, _ in good], n, [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 20)) * np.geomspace(4, 0.05, 20) + 1000
    rows = [(i, list(map(float, np.float32(r)))) for i, r in enumerate(v)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one vector holds a great part
    rows += [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [])]
    df = spark.createDataFrame([(i, r, "clash", 1) for i, r in rows], "vec_id long, embedding array<float>, x string, id int").repartition(5)
    got = defaultdict(dict)
    for r in whiten(df).collect():
        got[r.vec_id][r.component] = r
    ids, n, deviation, white, share = plain_whitening(rows[:-1])
    assert sorted(got) == sorted(ids)
    sign = {k: math.copysign(1, got[0][k + 1].whitened * white[0, k]) for k in range(16)}
    for i, dev, w in zip(ids, deviation, white, strict=True):
        assert sorted(got[i]) == list(range(1, 17))
        for k in range(16):
            r = got[i][k + 1]
            assert (r.n, r.deviation) == (n, dev) and abs(r.whitened * sign[k] - w[k]) < 1e-9 and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_without_variance_and_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # one vector of the fit
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    two = [(10 + i, [float(i % 2), float(i // 2)]) for i in range(4)] + [(None, [0.0, 0.0])]
    got = whiten(spark.createDataFrame(line + two, schema)).collect()
    by = Counter(r.vec_id for r in got)
    assert {by[i] for i in range(6)} == {1} and {by[10 + i] for i in range(4)} == {2} and by[None] == 2  # a line has one direction
    assert all(abs(r.explained - 1) < 1e-12 for r in got if r.vec_id in range(6))


def test_deviation_beyond_a_long():
    x = np.array([[2**52, 0], [0, 0]])
    assert _deviations(x, 2, [2**52, 0]) == [None, None]
    assert _deviations(np.array([[3, 5], [1, 1]]), 2, [4, 6]) == [4 + 16, 4 + 16]
    x = np.array([[10**9], [-(10**9)]])
    assert _deviations(x, 2, [0]) == [4 * 10**18] * 2


# --- language model


def ways(word, pieces):
    """All segmentations of bytes."""
    if not word:
        return [[]]
    return [[p, *rest] for p in pieces if word.startswith(p) for rest in ways(word[len(p) :], pieces)]


def tiny():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bab", b" ab", b"ba", b"aa", "é".encode(), b"a" + "é".encode()]
    rng = np.random.default_rng(5)
    p = rng.uniform(0.1, 1, len(pieces))
    return pieces, p / p.sum()


def test_lattice_is_the_sum_over_all_segmentations():
    pieces, p = tiny()
    prob, lattice = dict(zip(pieces, p, strict=True)), Lattice(pieces)
    words = [b"", b"a", b"ab", b"abab", b"bbabaab", "aé".encode(), "éaéb".encode(), b"z", b"aaaaaaaa", b"ab"]
    times = np.arange(1, len(words) + 1, dtype=float)
    got = log10_words(lattice, np.log(p), words)
    counts = Counter()
    for w, g, t in zip(words, got, times, strict=True):
        each = [(way, math.prod(prob[x] for x in way)) for way in ways(b" " + w, pieces)]
        total = sum(q for _, q in each)
        assert g == pytest.approx(math.log10(total), abs=1e-12)
        for way, q in each:
            for x in way:
                counts[x] += t * q / total
    found = np.zeros(len(pieces))
    for some, text in lm_score.by_size(words):
        found += lattice.expected(text, times[some], np.log(p))
    assert found == pytest.approx([counts[x] for x in pieces], abs=1e-9)


def test_long_words_come_in_stretches(monkeypatch):
    pieces, p = tiny()
    lattice = Lattice(pieces)
    word = bytes(random.Random(6).choice(b"ab") for _ in range(3000))
    whole = log10_words(lattice, np.log(p), [word])
    _, text = next(lm_score.by_size([word]))
    counts = lattice.expected(text, np.ones(1), np.log(p))
    monkeypatch.setattr(lm_score, "_CELLS", 500)
    assert log10_words(lattice, np.log(p), [word]) == pytest.approx(whole, abs=1e-9) and whole[0] < -400
    assert lattice.expected(text, np.ones(1), np.log(p)) == pytest.approx(counts, abs=1e-7)


def test_vocabulary():
    names, prior = vocabulary(public_pieces())
    assert len(set(names)) == len(names) and prior.sum() == pytest.approx(1) and (prior > 0).all()
    assert all(bytes([b]) in set(names) for b in range(256)) and not any(b" " in n[1:] or b"\n" in n[1:] for n in names)


def texts():
    rng = random.Random(7)
    words = ["der", "the", "Haus", "straße", "日本", " x", "ab▁c", "x" * 70, "THE", "e-mail", "\U0001f600"]
    out = [None, "", " \t\n", "a", "\x0bOne\x0cTwo\x1cThree", "q" * 50_000, "the " * 3000]
    return out + [" ".join(rng.choice(words) + rng.choice(["", "", ".", str(rng.randint(0, 40))]) for _ in range(rng.randint(1, 60))) for _ in range(60)]


def plain_scores(rows, rounds=3):
    """The contract's base, and the lattice with its fit, by dictionaries and a recursion of its own."""
    names, prior = vocabulary(public_pieces())
    longest, start = max(map(len, names)), dict(zip(names, (prior * len(names)).tolist(), strict=True))

    def tokens(t):
        table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        return [w for w in (t or "").encode().translate(table, b"").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w]

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count, texts = Counter(), 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            count.update(tokens(t))
            texts += 1
    extra = Counter()

    def passes(w, p):
        w = b" " + w
        edges = [(i, j, w[i:j]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in p]
        f, g = [-math.inf] * (len(w) + 1), [-math.inf] * (len(w) + 1)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        f[0] = g[-1] = 0.0
        for i, j, x in edges:
            f[j] = add(f[j], f[i] + p[x])
        for i, j, x in reversed(edges):
            g[i] = add(g[i], p[x] + g[j])
        return f, g, edges

    def weights():
        total = sum(extra.values()) + sum(start.values()) + texts + 1
        return {x: math.log((extra[x] + s) / total) for x, s in start.items()}, math.log((texts + 1) / total)

    for _ in range(rounds):
        p, _ = weights()
        new = Counter()
        for w, k in count.items():
            f, g, edges = passes(w, p)
            for i, j, x in edges:
                new[x] += k * math.exp(f[i] + p[x] + g[j] - f[-1])
        extra = new
    p, end = weights()
    n, v = sum(count.values()) + texts, len(count) + (texts > 0)
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    out, memo = [], {}
    for (i, t), h in zip(rows, held, strict=True):
        words = tokens(t)
        for w in words:
            if w not in memo:
                memo[w] = passes(w, p)[0][-1]
        out.append((i, h, len(words) + 1, sum(count[w] > 0 for w in words) + (texts > 0), n, sum(base(count[w]) for w in words) + base(texts), (sum(memo[w] for w in words) + end) / math.log(10)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 4))


def test_scores_against_plain_python(spark, monkeypatch):
    rows = list(enumerate(t for t in texts() if t is None or len(t) < 20_000)) + [(None, "The end"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, word string, key double").repartition(3)
    want = sorted(plain_scores(rows), key=key)
    for head in (lm_score.HEAD, 3):  # most words known to every task, and nearly all joined
        monkeypatch.setattr(lm_score, "HEAD", head)
        got = sorted((tuple(r) for r in lm_scores(df).collect()), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[5] == pytest.approx(w[5], abs=1e-8) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_scores_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm_scores(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scores(spark.createDataFrame([(held, "some words"), (held, None)], schema)).orderBy("n_tokens").collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert r[1].score < r[0].score < 0
    long = lm_scores(spark.createDataFrame(list(enumerate(texts())), schema)).collect()
    assert len(long) == len(texts()) and min(x.score for x in long) < -10_000 and all(math.isfinite(x.score) for x in long)


def test_trained_words_gain(spark):
    """Fitting raises the likelihood of held-out text of the same kind."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, after = (sum(r.score for r in lm_scores(docs, rounds=k).where("held_out").collect()) for k in (0, 3))
    assert after > 0.9 * before and after > before


# --- phrases


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(table)
        for c in ".,;:!?\n\v\f\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in kept.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        rows = []
        for p, a in kept.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * around[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def odd_documents(seed):
    rng = random.Random(seed)
    words = ["Aa", "b", "É", "日", "c c", "d\x1cd", "\x00", "b", "b"]
    mark = [" ", " ", " ", "\t", "  ", ". ", ",", "\x0b", "\x0c", "\r\n", "!", "? "]
    docs = [(None, "en"), ("", None), ("b", "en"), ("b " * 2000, "en"), ("aa b É 日 " * 200, None), ("b", "und"), ("...", "fr")]
    return docs + [("".join(rng.choice(words) + str(rng.choice(["", "", rng.randint(0, 30)])) + rng.choice(mark) for _ in range(rng.randint(1, 200))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]


@pytest.mark.parametrize(("seed", "least", "top", "bits"), [(1, 5, 2000, 27), (2, 2, 40, 19), (3, 1, 2000, 27)])
def test_phrases_against_plain_python(spark, monkeypatch, seed, least, top, bits):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)  # with few bits, rare words share those of frequent ones
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "TASKS", 7)  # several ranges a task
    docs = odd_documents(seed)
    df = spark.createDataFrame([(t, c, 1, "x") for t, c in docs], "text string, lang string, id int, ids string").repartition(3)
    got = sorted(tuple(r) for r in collocations(df, least=least, top=top, range_words=300).collect())
    assert got == plain_phrases(docs, least, top)


def test_phrases_of_an_empty_table(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_unlike_keys_of_one_mixed_word():
    keys = np.array([[5, 2], [5, 1], [9, 1], [5, 2], [5, 1], [0, 0]], np.uint64)
    got, n = run_lengths(keys, np.array([1, 2, 3, 4, 5, 6]))
    assert got.tolist() == [[0, 0], [5, 1], [5, 2], [9, 1]] and n.tolist() == [6, 7, 5, 3]


def test_keys_give_their_ids_back():
    ids = np.random.default_rng(8).integers(0, 2**64, (50, 4), np.uint64)
    keys = ids.copy()
    keys[:, 0] = mixed([ids[:, i] for i in range(4)])
    assert (phrases._first_ids(keys) == ids[:, 0]).all()
