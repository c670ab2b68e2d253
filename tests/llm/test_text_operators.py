"""Exact dedup, SimHash, packing, sharding and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from reelgrid.llm import mixing, simhash
from reelgrid.llm.components import components
from reelgrid.llm.exact_dedup import drop_exact_copies, exact_groups
from reelgrid.llm.packing import encoder, pack, public_vocabulary
from reelgrid.llm.scratch import BROADCAST_BYTES, Scratch, small_broadcasts
from reelgrid.llm.sharding import shard_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(i, t, rng.choice(["a", "b", "ç", None])) for i, t in enumerate(base)]
    rows += [(100, None, "a"), (101, "", "a"), (102, " \n\t", None), (103, "x", "b"), (103, "x", "b"), (None, "x ", "b"), (None, None, None)]
    rows += [(200 + i, base[3].replace(" ", "  ", i), "a") for i in range(6)]
    rows += [(300 + i, base[5] + (" tail" if i % 2 else ""), "b") for i in range(30)]
    rows += [(400, "long " * 60_000, "a"), (401, "y" * 100_000, "b"), (402, "\U0001f600 " * 5_000, "a")]
    return rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def kept_of(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("hash_fn", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5))])
def test_exact_groups(spark, odd_rows, hash_fn):
    want = kept_of(odd_rows)
    got = exact_groups(docs(spark, odd_rows), hash_fn=hash_fn).collect()
    assert len(got) == len(odd_rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert by_sha[r.text_sha256] == (r.keep_id, r.group_size)
    assert sum(r.kept for r in got) == len(want)


def test_drop_exact_copies(spark, odd_rows):
    out = drop_exact_copies(docs(spark, odd_rows))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = out.collect()
    assert Counter((norm(r.text), r.doc_id) for r in got) == Counter((k, v[0]) for k, v in kept_of(odd_rows).items())


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(nodes, linked):
    low = {n: n for n in nodes}
    find = lambda x: x if low[x] == x else find(low[x])
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                low[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprint(odd_rows):
    for _, t, _ in odd_rows:
        if t is None or len(t) < 50_000:
            assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_balls_find_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for d in (1, 2, 3, 4):
            for _ in range(3):
                fps.add(x ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = sorted(fps)
    whole = reach(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.fingerprint_links(df)
    got = {r.node: r.component for r in components(links, Scratch(spark, "t")).collect()}
    mine = defaultdict(set)
    for x in fps:
        mine[got.get(signed(x), signed(x))].add(x)
    want = defaultdict(set)
    for x in fps:
        want[whole[x]].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (3, 4), (None, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300))
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_simhash_groups(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (400, 401)]
    got = simhash.simhash_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {t: plain_fingerprint(t) for _, t, _ in rows}
    comp = reach(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    low = defaultdict(list)
    for i, t, _ in rows:
        low[comp[fp[t]]].append(i)
    want = Counter((i, f"{fp[t]:016x}", min((x for x in low[comp[fp[t]]] if x is not None), default=None)) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_drop_near_copies_against_brute_force(spark, odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows)
    for k, i in enumerate((1, 2, 4, 6, 8, 9)):
        words = odd_rows[i][1].split()
        for j in range(4):  # copies of copies: groups reach further than one link
            for _ in range(max(1, len(words) // 90)):
                if words:
                    words[rng.randrange(len(words))] = f"new{k}{j}"
            rows.append((500 + 10 * k + j, " ".join(words), "a"))
    sets = {t: shingles(t) for _, t, _ in rows}
    texts = sorted(sets, key=lambda t: (t is None, t or ""))
    comp = reach(range(len(texts)), lambda a, b: alike(sets[texts[a]], sets[texts[b]]))
    group = {t: comp[k] for k, t in enumerate(texts)}
    want = defaultdict(list)
    for i, t, _ in rows:
        want[group[t]].append((i is None, i or 0))
    got = simhash.drop_near_copies(docs(spark, rows).repartition(3)).collect()
    kept, best = Counter(group[r.text] for r in got), {g: min(v) for g, v in want.items()}
    # whole groups only: each keeps its best document, none is lost, and nearly all of the others go
    assert kept.keys() == want.keys() and len(want) < len(texts) - 10
    assert all(best[g] in {(r.doc_id is None, r.doc_id or 0) for r in got if group[r.text] == g} for g in want)
    assert sum(kept.values()) - len(want) <= 0.1 * (len(texts) - len(want))


def test_near_copy_recall(spark):
    """Ids divisible by 50 against all rows of a table: of pairs at a five-word Jaccard similarity of 0.8 or more at least 0.9 end in one group."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    pairs = set()
    for i in sets:
        if i % 50 == 0:
            shared = Counter(j for x in sets[i] for j in at[x] if j != i)
            pairs |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    group = {r.doc_id: r.component_id for r in simhash.near_groups(table).collect()}
    assert len(pairs) > 10
    found = sum(group[i] == group[j] for i, j in pairs)
    print(f"recall {found} of {len(pairs)}")
    assert found >= 0.9 * len(pairs)
    kept = {r.doc_id for r in simhash.drop_near_copies(table).select("doc_id").collect()}
    assert kept == set(group.values())


def text_of(n, changed=()):
    words = [f"w{n}x{i}" for i in range(200)]
    for i in changed:
        words[i] = f"other{n}x{i}"
    return " ".join(words)


def test_no_link_that_was_met_is_lost(spark, monkeypatch):
    """Forty triples of one fingerprint each: two alike texts and one unlike them; which comes first by hash must not matter."""
    rows = []
    for n in range(40):
        rows += [(3 * n, text_of(n)), (3 * n + 1, text_of(n, range(0, 12, 3))), (3 * n + 2, text_of(1000 + n))]
    monkeypatch.setattr(simhash, "word_fingerprint", lambda words: FINGERPRINTS[words.tobytes()])
    FINGERPRINTS.clear()
    for i, t in rows:
        FINGERPRINTS[simhash._hashes(simhash.words_of(t.encode())).tobytes()] = (i // 3) * 0x9E3779B97F4A7C15 % 2**64
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    group = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert all(group[3 * n] == group[3 * n + 1] == 3 * n and group[3 * n + 2] == 3 * n + 2 for n in range(40))


FINGERPRINTS = {}


@pytest.mark.parametrize("size", [simhash.FEW, 60])
def test_all_that_meet_at_a_value_are_compared(spark, monkeypatch, size):
    """Fingerprints a few bits from one centre, each with a text of its own but for alike pairs far from each other in any order."""
    rng = random.Random(size)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < size:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), 3)))
    rows = [(i, text_of(i)) for i in range(size)]
    pairs = [(0, size - 1), (1, size // 2), (2, 3)]
    for a, b in pairs:
        rows[b] = (b, text_of(a, range(0, 12, 3)))
    FINGERPRINTS.clear()
    for (_, t), fp in zip(rows, fps, strict=True):
        FINGERPRINTS[simhash._hashes(simhash.words_of(t.encode())).tobytes()] = fp
    monkeypatch.setattr(simhash, "word_fingerprint", lambda words: FINGERPRINTS[words.tobytes()])
    group = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i for i in range(size)} | {b: a for a, b in pairs}
    met = {(a, b) for a, b in pairs if any((list(fps)[a] >> s & 0xFFFFFFFF ^ list(fps)[b] >> s & 0xFFFFFFFF).bit_count() <= 3 for s in (0, 32))}
    assert {(a, b) for a, b in pairs if group[a] == group[b]} >= met and all(group[i] in (i, want[i]) for i in range(size))


def test_sketch_rules_out_pairs_below_the_similarity(spark):
    """Long texts: no pair at 0.8 or more is ruled out, all of some 0.66 are, though most of their shingles are the same."""
    texts = [[f"w{n}x{i}" for i in range(400)] for n in range(30)]
    other = [[f"o{w}" if i % (25 if n < 15 else 50) == 10 else w for i, w in enumerate(words)] for n, words in enumerate(texts)]
    rows = [(2 * n + k, " ".join(t)) for n, both in enumerate(zip(texts, other, strict=True)) for k, t in enumerate(both)]
    sets = simhash.with_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    end = lambda x, k: sets.where(F.col("id") % 2 == k).select((F.col("id") / 2).cast("long").alias("pair"), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}sketch"))
    got = {r.pair: r.may for r in end("a", 0).join(end("b", 1), "pair").select("pair", simhash._may_reach(0.8, "a", "b").alias("may")).collect()}
    alike_sets = {n: alike(shingles(" ".join(texts[n])), shingles(" ".join(other[n]))) for n in range(30)}
    assert sum(alike_sets.values()) == 15 and got == alike_sets


def test_members_of_a_value_have_a_hub_in_common(spark):
    """A large group of near copies: of all that meet at values with many both are at a hub, by far fewer rows than values."""
    rng = random.Random(4)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 400:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(24), rng.choice([1, 2, 3]))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.met(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 32, simhash.meet_all, "u long, v long, member boolean").distinct()
    members = found.where("member").select(F.col("u").alias("value"), F.col("v").alias("fp")).cache()
    at, hubs, n = defaultdict(set), defaultdict(set), 0
    for r in members.collect():
        at[r.value].add(r.fp)
    for r in simhash._at_hubs(members).collect():
        hubs[r.fp].add(r.hub)
        n += 1
    assert max(map(len, at.values())) > 100 and all(set.intersection(*(hubs[f] for f in some)) & some for some in at.values())
    assert n == sum(map(len, hubs.values())) and n < members.count() / 4


def test_listed_pairs_grow_with_a_group_not_with_its_square():
    """Fingerprints up to three bits from one centre: twice as many list little more than twice the pairs, and few for each; whoever met at a value is listed there."""
    import pyarrow as pa

    rng = random.Random(14)
    centre, fps, listed = rng.getrandbits(64), [], {}
    while len(fps) < 1000:
        fps = list(dict.fromkeys([*fps, centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))]))
    for n in (500, 1000):
        batch = pa.RecordBatch.from_arrays([pa.array(np.array(fps[:n], np.uint64).view(np.int64))], ["fp"])
        met = np.concatenate([np.stack([c.to_numpy() for c in b.columns], 1) for b in simhash.emit_variants(iter([batch]), 32)])
        met = met[np.argsort(met[:, 0].view(np.uint64), kind="stable")]
        rows = {tuple(r.values()) for b in simhash.meet_all(iter([pa.RecordBatch.from_arrays([pa.array(met[:, 0].copy()), pa.array(met[:, 1].copy())], ["v", "fp"])])) for r in b.to_pylist()}
        listed[n] = sum(member is False for *_, member in rows)
    assert listed[1000] <= 2.5 * listed[500] + 1000 and listed[1000] <= 10 * 1000, listed
    at, of = defaultdict(set), defaultdict(set)
    for v, f in met.tolist():
        at[v].add(f)
    for u, v, member in rows:
        if member:
            of[u].add(v)
    for v, all_there in at.items():
        if len(all_there) > 2:
            assert of[v] == all_there


def test_a_large_near_group_is_compared_by_few_pairs(spark, monkeypatch):
    """240 texts around one, changed a little to a lot, all met: the groups of brute force, by a few pairs a text."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    centre, fps, rows = rng.getrandbits(64), set(), []
    while len(fps) < 240:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(24), rng.choice([1, 2, 3]))))
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(200), i % 12 + 1):
            words[k] = f"other{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    FINGERPRINTS.clear()
    for (_, t), fp in zip(rows, sorted(fps), strict=True):
        FINGERPRINTS[simhash._hashes(simhash.words_of(t.encode())).tobytes()] = fp
    monkeypatch.setattr(simhash, "word_fingerprint", lambda words: FINGERPRINTS[words.tobytes()])
    compared, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    group = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    comp = reach(range(240), lambda a, b: alike(sets[a], sets[b]))
    assert len({comp[i] for i in range(240)}) > 20 and all((group[a] == group[b]) == (comp[a] == comp[b]) for a in range(240) for b in range(a))
    assert sum(compared) <= 4 * 240


def test_texts_left_out_are_like_no_other(spark):
    """Of texts around one those stay that may be similar to another; what they share is at least what any two share."""
    rng = random.Random(13)
    texts = []
    for i in range(60):
        words = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(100), i % 10):
            words[k] = f"other{rng.randrange(30)}"
        texts.append(" ".join(words))
    made = [(i, bytes(simhash.shingle_set(t.encode()).tobytes())) for i, t in enumerate([*texts, ""])]
    left = {r.node: r.shared for r in simhash._open(spark.createDataFrame(made, "node long, shingles binary"), 0.8).collect()}
    sets = [shingles(t) for t in texts]
    for a in range(60):
        for b in range(a):
            if alike(sets[a], sets[b]) and sets[a] != sets[b]:
                assert min(left[a], left[b]) >= len(sets[a] & sets[b])
    assert 10 < len(left) < 55


@pytest.mark.parametrize("letters", ["abcdefghijklmnorst", "абвгдеёжзийклмнопрстуфхцчшщ", "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年", "अआइईउऊएऐकखगघचछजझटठडढतथदधनपफबभमयरलव", "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"])
def test_chunks_meet_again_in_every_script(spark, letters):
    """One inserted character changes the chunk it is in, and few after it; chunks put together are the text."""
    from reelgrid.llm.exact_dedup import _chunks

    rng = random.Random(11)
    text = "".join(rng.choice(letters) for _ in range(30_000))
    other = text[:9000] + rng.choice(letters) + text[9000:]
    a, b = (r.c for r in spark.createDataFrame([(0, text), (1, other)], "id int, t string").select("id", _chunks(F.col("t")).alias("c")).orderBy("id").collect())
    assert "".join(a) == text and "".join(b) == other and max(map(len, a)) <= 4096
    assert len(a) > 20 and len(set(a) - set(b)) <= 4


def test_slices_split_no_value():
    import pyarrow as pa

    v = np.sort(np.random.default_rng(2).integers(0, 40, 3000)).astype(np.int64)
    v[1000:2500] = v[1000]
    v.sort()
    f = np.arange(3000)
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i : i + 70]), pa.array(f[i : i + 70])], ["v", "fp"]) for i in range(0, 3000, 70)]
    seen, largest = Counter(), 0
    for a, b in simhash.slices(iter(batches), 200):
        seen.update(b.tolist())
        largest = max(largest, len(a))
    assert set(seen) == set(range(3000)) and largest < 500 and sum(n - 1 for n in seen.values()) < 20


def test_few_links_come_out_as_stars(spark):
    """A chain over both signs: every node is linked to the least long at once, so no round follows."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)], "u long, v long").repartition(1)
    assert {tuple(r) for r in simhash.thinned(chain).collect()} == {(i, -40) for i in range(-39, 41)}


def test_spanning_keeps_components():
    rng = np.random.default_rng(5)
    links = rng.integers(0, 3000, (2000, 2)).astype(np.uint64)
    links = links[links[:, 0] != links[:, 1]]
    got = simhash.spanning(links)
    low = {int(n): int(n) for n in np.unique(links)}
    find = lambda x: x if low[x] == x else find(low[x])
    for a, b in links.tolist():
        low[max(find(a), find(b))] = min(find(a), find(b))
    assert {(n, find(n)) for n in low if find(n) != n} == set(map(tuple, got.tolist()))


def test_dense_groups_over_many_partitions(spark):
    """A large group of near copies and one of exact copies, dealt over 211 partitions: the components of a union-find, few links."""
    rng = random.Random(9)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 10_000:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 3, 4]))))
    fps |= {rng.getrandbits(64) for _ in range(2000)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        scratch = Scratch(spark, "t")
        links = scratch.put(simhash.fingerprint_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(211)), "links")
        few = simhash.thinned(links)
        n = few.count()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = {r.node: r.component for r in components(few, scratch).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    order = sorted(fps)
    low = {x: x for x in order}
    find = lambda x: x if low[x] == x else find(low[x])
    flips = [1 << i for i in range(64)]
    for x in order:  # one or two bits link the group; three hold whatever is left
        for i in range(64):
            for y in [x ^ flips[i]] + [x ^ flips[i] ^ flips[j] for j in range(i)]:
                if y in low and find(x) != find(y):
                    low[max(find(x), find(y))] = min(find(x), find(y))
    roots = sorted({find(x) for x in order})
    for x in roots:  # fingerprints apart so far
        for y in order:
            if (x ^ y).bit_count() <= 3 and find(x) != find(y):
                low[max(find(x), find(y))] = min(find(x), find(y))
    groups, mine = defaultdict(set), defaultdict(set)
    for x in order:
        groups[find(x)].add(x)
        mine[got.get(signed(x), signed(x))].add(x)
    assert len(roots) > 2000 and sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    assert n < 10 * len(fps)  # with 4 to 8 tasks a link a node each


@pytest.mark.parametrize("plain_specials", [False, True])
def test_encoder_equals_the_library(plain_specials):
    encode, dtype = encoder(public_vocabulary(), plain_specials)
    tok = Tokenizer.from_file(public_vocabulary())
    tok.encode_special_tokens = plain_specials
    assert np.frombuffer(encode("x <|endoftext|> y"), dtype).tolist() == tok.encode("x <|endoftext|> y", add_special_tokens=False).ids
    assert (50256 in np.frombuffer(encode("x <|endoftext|> y"), dtype)) != plain_specials
    rng = random.Random(1)
    some = [" ", " ", "\n", "  ", "\t", "a", "Bc", "'s", "12", "é", " ", "　", ".", ",", "|", "<|endoftext|>", "\r\n", "日本", "\x85", "​", "\U0001f600", "ª"]
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(text), dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_encoder_on_a_table(spark):
    """Every text of sf0.01 as the library encodes it."""
    encode, dtype = encoder(public_vocabulary())
    tok = Tokenizer.from_file(public_vocabulary())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect():
        assert np.frombuffer(encode(r.text), dtype).tolist() == tok.encode(r.text, add_special_tokens=False).ids


def test_pack(spark, odd_rows):
    tok = Tokenizer.from_file(public_vocabulary())
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 103] + [(700, "x <|endoftext|> y<|endoftext|>", "a")]
    got = pack(docs(spark, rows).repartition(3), window=64).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, own))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        assert sum((p for _, p in sorted(parts)), []) == ids[i]
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == len(sequences) - 1
    crc = pack(docs(spark, rows[:1])).select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(np.array(ids[rows[0][0]][:2048], "<u4").tobytes())


def test_shards(spark, odd_rows):
    got = shard_rows(docs(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in odd_rows)


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i // 3 if i < 300 else i}", "a") for i in range(2000)] + [(5000 + i, "hot", "a") for i in range(1000)]
    got = {r.doc_id: r["shard"] for r in shard_rows(docs(spark, rows)).collect()}
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    whole = sum(len({got[3 * g + k] for k in range(3)}) == 1 for g in range(100))
    assert whole >= 95


def test_shards_keep_large_groups_whole(spark):
    sizes = {"a": 360, "b": 250, "c": 120, "d": 60, "e": 1000}
    texts = [k for k, n in sizes.items() for _ in range(n)] + [f"own {i}" for i in range(4000 - sum(sizes.values()))]
    random.Random(3).shuffle(texts)
    got = [(texts[r.doc_id], r["shard"]) for r in shard_rows(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()]
    counts = Counter(s for _, s in got)
    assert set(counts.values()) == {500}
    spread = {k: len({s for t, s in got if t == k}) for k in sizes}
    assert spread == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2}


def test_shards_leave_no_pair_apart_beside_a_hot_group(spark):
    texts = ["hot"] * 2000 + [f"pair {i // 2}" for i in range(3000)] + [f"own {i}" for i in range(1000)]
    random.Random(4).shuffle(texts)
    got = [(texts[r.doc_id], r["shard"]) for r in shard_rows(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()]
    assert set(Counter(s for _, s in got).values()) == {750}
    places = defaultdict(set)
    for t, s in got:
        places[t].add(s)
    assert sum(len(p) > 1 for t, p in places.items() if t != "hot") == 0 and len(places["hot"]) == 3


def test_shards_keep_a_group_of_100_000_rows_whole(spark):
    table = spark.range(900_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, "hot").when(F.col("id") % 9 < 3, F.concat(F.lit("pair "), F.floor(F.col("id") / 9).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    placed = shard_rows(table).select("doc_id", "shard").join(table, "doc_id")
    counts = [r.n for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert counts == [112_500] * 8
    apart = placed.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert apart.count() == 0


def test_shards_cut_no_more_than_the_best_of_all_placements(spark):
    """Groups that just fill the shards: every placement of whole groups is tried for the fewest that must be split."""
    from itertools import product

    rng = random.Random(11)
    for _ in range(3):
        sizes = [rng.randint(2, 7) for _ in range(7)]
        n = 3 * max(-(-sum(sizes) // 3), 8)
        texts = [f"g{k}" for k, m in enumerate(sizes) for _ in range(m)] + [f"own {i}" for i in range(n - sum(sizes))]
        best = min(sum(max(0, sum(m for m, s in zip(sizes, at) if s == k) - n // 3) for k in range(3)) for at in product(range(3), repeat=len(sizes)))
        got = [(texts[r.doc_id], r["shard"]) for r in shard_rows(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), shards=3).collect()]
        assert set(Counter(s for _, s in got).values()) == {n // 3}
        split = sum(len({s for t, s in got if t == f"g{k}"}) > 1 for k in range(len(sizes)))
        assert split <= best + 1, (sizes, split, best)


def test_mix(spark, odd_rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix_plan(docs(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows)
    sizes = Counter()
    for _, t, s in odd_rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in order})
    mixed = mixing.mix(docs(spark, odd_rows))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixed.count() == sum(r.copies for r in got)
    assert Counter(map(tuple, mixing.mix_plan(docs(spark, odd_rows).repartition(3)).collect())) == Counter(map(tuple, got))


def test_mix_is_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 400), f"s{rng.randint(0, 5)}") for i in range(900)]
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix_plan(docs(spark, rows)).collect():
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert all(abs(a - t) <= 0.03 * t for a, t in by.values())


@pytest.mark.parametrize("operator", [exact_groups, simhash.simhash_groups, pack, shard_rows, mixing.mix_plan, mixing.mix, drop_exact_copies, simhash.drop_near_copies])
def test_empty_tables_and_clashing_names(spark, operator):
    assert operator(docs(spark, [])).count() == 0
    names = "id uid n h o u v fp key part at shard slot size source_size target plan seed whole kept base recipe text_sha256 rows doc".split()
    clash = docs(spark, [(1, "a b c d", "s"), (2, "a b c d", None)]).select("*", *[F.lit(7).alias(n) for n in names])
    assert operator(clash).count() >= 1


def test_near_copies_need_no_large_broadcasts(spark, monkeypatch):
    """Their tables grow with the documents: the driver holds none of more than a stated size, nor the last one."""
    key, seen, put = "spark.sql.autoBroadcastJoinThreshold", [], Scratch.put
    before = spark.conf.get(key)
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: seen.append(spark.conf.get(key)) or put(self, df, name))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight "), (F.col("id") % 20).cast("string")).alias("text"))
    for found in (simhash.drop_near_copies(docs), simhash.near_groups(docs), simhash.simhash_groups(docs)):
        assert found.count() in (20, 40) and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert str(BROADCAST_BYTES) in seen and spark.conf.get(key) == before
    try:
        for size, inside in (("-1", "-1"), ("256k", "256k"), ("2MB", str(BROADCAST_BYTES)), (str(BROADCAST_BYTES), str(BROADCAST_BYTES))):
            spark.conf.set(key, size)
            with small_broadcasts(spark):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == size
    finally:
        spark.conf.set(key, before)
