"""Personal data beyond the base: recall, clean documents, labelers and the classifier against plain Python."""

import random
import re
from collections import Counter
from math import exp, log

import pytest
from pyspark.sql import functions as F

from reelgrid.llm import pii

GOOD = {
    "email": ["write to john.{} [at] site [dot] org today", "mail anna{} at example dot com please"],
    "ip": ["the host 2001:db8::ff00:42:{} answers", "server 2001:0db8:0000:0000:0000:ff00:0042:{} is up"],
    "card": ["paid by card 4111.1111.1111.{} on Monday"], "phone": ["please call (212) 555 {}.", "tel: 212-555-{}, evenings"],
    "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188{}"', "the api_key: sk_live_abcdefghijkl{} leaked", "password = hunter{}x!"],
    "iban": ["IBAN DE89 3704 0044 0532 0130 00 for item {}"], "name": ["my name is Mr. John Smith, seat {}", "dear Alice Johnson, number {} is yours"],
    "address": ["we live at {} Baker Street", "Adresse: Hauptstraße {}", "habite au {}, rue de Rivoli", "la dirección es Calle Mayor {}"],
}
BAD = ["see commit 04dbebab91ab85687d33eeaaf9ac699e1188{} for it", "sha256: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f0{}", "order no 1234 5678 {}", "plain words {} without any", "version 2.{} of the text"]


def test_forms_are_found_and_their_like_are_not(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for kind, forms in GOOD.items():
        for form in forms:
            for _ in range(25):
                want[len(rows)] = kind
                rows.append((len(rows), form.format(rng.randint(1000, 9999))))
    for form in BAD:
        for _ in range(25):
            want[len(rows)] = None
            rows.append((len(rows), form.format(rng.randint(1000, 9999))))
    got = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for kind in GOOD:
        mine = [i for i, k in want.items() if k == kind]
        assert sum(kind in got[i] for i in mine) >= 0.9 * len(mine), kind
    clean = [i for i, k in want.items() if k is None]
    assert sum(bool(got[i]) for i in clean) <= 0.05 * len(clean), Counter(rows[i][1][:12] for i in clean if got[i])


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_planted_cases_of_a_table(spark):
    """Every document of sf0.1 that holds an address, a number or a token has a span; documents without a digit or @ have none."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(table)).collect()}
    planted = clean = caught = touched = secrets = found = 0
    for r in table.collect():
        token = re.search(r'(?i)token = "([0-9a-f]{40})"', r.text)
        card = any(luhn(x) for x in re.findall(r"(?<![0-9])[0-9]{16}(?![0-9])", r.text))
        if token or card or "@" in r.text or "+1 (" in r.text or re.search(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r.text):
            planted += 1
            caught += got[r.doc_id].n_spans > 0
        elif not re.search(r"[0-9@]", r.text):
            clean += 1
            touched += got[r.doc_id].n_spans > 0
        if token:
            secrets += 1
            found += f"secret:{token.start(1)}:{token.end(1)}" in got[r.doc_id].spans.split(",")
    assert planted > 300 and caught >= 0.98 * planted and secrets > 100 and found >= 0.98 * secrets
    assert clean > 5000 and touched <= 0.001 * clean


def test_expectation_maximisation_row_by_row():
    """The counts of vote patterns give what a plain pass over single spans gives."""
    rng = random.Random(6)
    rows = []
    for _ in range(800):
        true = rng.random() < 0.4
        rows.append(tuple(rng.choice([-1, 0, 1]) if rng.random() < 0.3 else (1 if true else -1) for _ in range(4)))
    _, tables, post = pii.reliabilities(dict(Counter(rows)))
    mine = [1 / (1 + exp(-1.5 * sum(v))) for v in rows]
    for _ in range(pii.ROUNDS):
        true = sum(mine)
        share = min(0.999, max(0.001, (true + 1) / (len(rows) + 2)))
        yes = [{x: (sum(p for p, v in zip(mine, rows) if v[k] == x) + (2 if x == 1 else 1)) / (true + 4) for x in (-1, 0, 1)} for k in range(4)]
        no = [{x: (sum(1 - p for p, v in zip(mine, rows) if v[k] == x) + (2 if x == -1 else 1)) / (len(rows) - true + 4) for x in (-1, 0, 1)} for k in range(4)]
        odds = [log(share / (1 - share)) + sum(log(yes[k][x] / no[k][x]) for k, x in enumerate(v)) for v in rows]
        mine = [1 / (1 + exp(-max(-30.0, min(30.0, z)))) for z in odds]
    assert all(abs(post[v] - p) < 1e-6 for v, p in zip(rows, mine))
    assert all(tables[k][1] == pytest.approx((yes[k][1], no[k][1])) for k in range(4))


def test_added_spans_do_not_overlap(spark):
    texts = ['token = "04dbebab91ab85687d33eeaaf9ac699e118812cd" Mr. Jack Brown Road', "a@b.co [at] c [dot] org", "12 Baker Street 4111.1111.1111.1111 212-555-1234"] * 9
    found = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        for a in r.found:
            for b in r.found:
                if a != b and not (a.base and b.base):
                    assert a.end <= b.start or b.end <= a.start
            assert texts[r.doc_id][a.start : a.end] == a.match


def test_masked_with_repeated_ids(spark):
    rows = [(1, "mail a@b.co now"), (1, "no mail"), (1, "mail a@b.co now"), (2, None), (None, "x@y.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, pii.masked(pii.personal_data(df), df).collect()))
    assert got == Counter([(1, "mail [email] now"), (1, "no mail"), (1, "mail [email] now"), (2, None), (None, "[email]")])
