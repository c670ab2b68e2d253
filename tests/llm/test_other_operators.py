"""PII, embeddings, HTML, language and chat against plain Python."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import pii
from reelgrid.llm.chat import chat_windows, escape, read_back, unescape
from reelgrid.llm.embed_dedup import Quantised, embedding_groups, may_reach
from reelgrid.llm.html_extract import extract_main_text, main_text
from reelgrid.llm.langid import Subwords, accepted_documents, held_out, predict, predict_languages, train, training_sample
from reelgrid.llm.queries import ODD

# The base as the contract words it.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def odd_texts():
    rng = random.Random(4)
    bits = ["a@b.co", "x.y+z@m-1.example.com", "a@b.c_d@e.f", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4", "4111 1111 1111 1111", "4111111111111112", "-", " ", "+1 (607) 555-1611",
            "+49 30 1234567", "+1", "555-123-4567", "(212) 555 1234", "john [at] site [dot] org", "é", "\U0001f600", "tel: ", "card ", "\n", "version ", "2001:0db8:0000:0000:0000:ff00:0042:8329", "9" * 30, "4111.1111.1111.1111"]
    return [None, "", "+" * 50, "a@" * 40, "1" * 3000, "a." * 3000 + "@b.c"] + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_pii_base_and_added(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, base, got[i].spans)
        kinds = Counter(x.split(":")[0] for x in base)
        assert [got[i][f"n_{k}"] for k in BASE] == [kinds[k] for k in BASE]
        assert set(base) <= set(got[i].spans.split(",")) | {""} or not base
    table = pii.masked(pii.personal_data(df), df).where("text like '%[email]%'")
    assert table.count() > 10


def test_long_runs_need_no_stack(spark):
    df = spark.createDataFrame([(1, "12 " * 60_000), (2, "a." * 60_000 + "@" + "b." * 60_000 + "c"), (3, "1." * 60_000), (4, "+" + "1 " * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(df)).collect()}
    assert got[2].n_email == 1 and got[1].n_card == 0 and len(got) == 4


def test_reliabilities_tell_a_good_labeler_from_a_coin():
    rng, counts = random.Random(1), Counter()
    for _ in range(20_000):
        true = rng.random() < 0.6
        good = [(1 if true else -1) * (1 if rng.random() < 0.9 else -1) for _ in range(2)]
        counts[(*good, rng.choice([-1, 1]))] += 1
    share, tables, post = pii.reliabilities(counts)
    assert abs(share - 0.6) < 0.05 and tables[0][1][0] > 0.8 > 0.6 > tables[2][1][0]
    assert post[(1, 1, -1)] > 0.9 and post[(-1, -1, 1)] < 0.1


def plain_embedding(rows, threshold=0.93):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return Counter(out)


@pytest.mark.parametrize("tile", [4, 2048])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).astype(np.float32).tolist(), int(rng.integers(2))) for i in range(150)]
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [1.0] * 15 + [float("nan")], 1), (803, [float("inf")] * 16, 1), (804, [None] * 16, 1), (805, rows[0][1], None), (806, [1.0, 2.0], 1), (807, [2.0, 4.0], 1), (808, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_groups(df, tile=tile).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == plain_embedding(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_groups(df.limit(0)).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 64)) * rng.lognormal(size=(300, 64), sigma=2)
    b = np.concatenate([a[:150] + rng.normal(size=(150, 64)) * 0.2, rng.normal(size=(150, 64))])
    qa, qb = Quantised(a), Quantised(b)
    true = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    for threshold in (0.5, 0.9, 0.99):
        assert not ((true >= threshold) & ~may_reach(qa, slice(None), qb, threshold)).any()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home"><header>Site</header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div><div id=sideBar>Side, text. More.</div>
<article><h1>Big &amp; title</h1><p>First   para,<b>bold</b> here.<br>Next line.<p>Second &eacute; para, with words. And more.</p><form><input><p>Sign up.</p></form><ul><li>One, item.</li><li>Two.</li></ul>
<div class='ad'>Buy, now.</div><!-- c --></article><section class="comments"><p>Great, post. Thanks.</p></section><footer>&copy; me.</footer></body></html>"""


def test_html(spark, sf):
    assert main_text(PAGE) == "Big & title\n\nFirst para,bold here. Next line.\n\nSecond é para, with words. And more.\n\nOne, item.\n\nTwo."
    bare = "<body><div class=menu>Home About</div><h2>Head</h2><p>Long paragraph, with text. It goes on, and on.</p><p>Another one, too. Yes, it is.</p><div class='reader-comments'><p>No, way.</p></div>"
    assert main_text(bare) == "Head\n\nLong paragraph, with text. It goes on, and on.\n\nAnother one, too. Yes, it is."
    for broken in (None, "", "<", "<p", "<!--", "<script>x", "&#x110000;", "</p></div>", "<a href='", "<p>" * 3000):
        main_text(broken)
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = extract_main_text(df).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_keeps_short_blocks_of_an_unnamed_article():
    sentence = "Some words, then more; and so on: it reads, as text does, to an end. "
    long = [f"{n} {sentence * 6}".strip() for n in range(10)]
    items, cells = [f"Item {n} of a short list" for n in range(5)], [f"cell {n}" for n in range(12)]
    middle = f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><table>{''.join(f'<tr><td>{x}</td></tr>' for x in cells)}</table>"
    body = "".join(f"<p>{x}</p>" for x in long[:5]) + middle + "".join(f"<p>{x}</p>" for x in long[5:])
    page = f"<body><div class=top><span>Home</span></div><div class=text>{body}<div class=share>Share, now.</div></div><div class=bottom>End</div></body>"
    assert main_text(page).split("\n\n") == long[:5] + items + cells + long[5:]


@pytest.mark.parametrize("tag", "video object audio canvas svg math select datalist noscript template".split())
def test_html_reads_on_after_an_element_without_its_end(tag):
    page = f"<article><p>First, para.</p><{tag} class=x><p>Second, para.</p><{tag}>Not shown.</{tag}><p>Third, para.</p></article><footer>End.</footer>"
    assert main_text(page) == "First, para.\n\nSecond, para.\n\nThird, para."
    assert main_text(f"<article><p>First, para.</p><{tag}>Not <{tag}>this</{tag}> shown.</{tag}><p>Last, para.</p></article>") == "First, para.\n\nLast, para."


def test_subwords_have_no_seams(monkeypatch):
    from reelgrid.llm import langid

    words = Subwords()
    text = "Ab, çd 12 éfgh\n\n--- ij " * 30
    whole = sorted(words.all(text).tolist())
    for piece in (3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert sorted(words.all(text).tolist()) == whole


def test_language(spark):
    got = predict_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("x"), "score").collect()
    assert np.mean([r.x for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in held)


def test_language_cases(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 5, "de") for i in range(40)]
    rows += [(300, None, "en"), (301, "", None), (302, "12 34 !!", "de"), (303, "the dog and the cat", None), (304, "жизнь и судьба народа", None), (None, "the cat", None), (303, "the dog and the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = [r for r in predict_languages(df).collect()]
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (300, 301, 302)) and by[303].lang_pred == "en" and not by[303].rejected
    kept = accepted_documents(df)
    assert kept.columns == df.columns and kept.where("doc_id in (300, 301, 302)").count() == 0 and kept.where("doc_id < 200").count() == 80
    assert predict_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in predict_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert predict(train([], []), Subwords(), "text")[0] == "und"


def test_unlearned_languages_are_rejected(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model, words = train(*training_sample(table)), Subwords()
    clean = [r for r in table.where(held_out() & F.col("lang").isNotNull() & (F.length("text") > 40)).limit(1000).collect()]
    assert np.mean([predict(model, words, r.text)[2] for r in clean]) < 0.005
    for text in (
        "Il governo ha annunciato oggi che le nuove misure entreranno in vigore a partire dal prossimo mese, dopo una lunga discussione in parlamento.",
        "O governo anunciou hoje que as novas medidas entram em vigor a partir do próximo mês, depois de uma longa discussão no parlamento.",
        "De regering heeft vandaag aangekondigd dat de nieuwe maatregelen vanaf volgende maand ingaan, na een lange discussie in het parlement.",
        "Rząd ogłosił dziś, że nowe środki wejdą w życie od przyszłego miesiąca, po długiej dyskusji w parlamencie.",
        "Hallitus ilmoitti tänään, että uudet toimenpiteet tulevat voimaan ensi kuusta alkaen pitkän keskustelun jälkeen.",
        "Правительство объявило сегодня о новых мерах.",
    ):
        assert predict(model, words, text)[2], text
    first = {r.lang: r.text[:600] for r in clean if len(r.text) > 600}
    assert len(first) > 2
    mixed = [f"{first[a]}\n{first[b]}" for a in first for b in first if a < b]
    assert min(predict(model, words, t)[1] for t in mixed) < model.threshold
    assert not any(predict(model, words, t)[2] for t in mixed)


def test_chat(spark):
    rng = random.Random(6)
    texts = [ODD, "", None, "\\s \\l </turn>\n<turn user>\nx", "a b " * 400, "plain, words here " * 9, "é\U0001f600 <>\\"]
    rows = [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD), (1, 0, "system", "sys " * 700), (2, 0, "system", "only"), (3, 0, None, "x"), (None, 0, "assistant", "y"), (None, None, "a>b\n<", "z")]
    for c in range(10, 22):
        rows += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(rng.choice([1, 6, 60]))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat_windows(df)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns == "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        assert got[c].loss == "".join(x for *_, r, x in turns if r == "assistant")
    many = [r for r in windows.collect() if r.conv_id is not None and r.conv_id % 2 and r.conv_id > 9 and r.window > 0]
    assert many and all(r.formatted.startswith("<turn system>\n") and r.n_context >= 1 for r in many)
    assert read_back(chat_windows(df.limit(0))).count() == 0
    both = spark.createDataFrame([(t or "",) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in both)


def test_empty_tables_and_clashing_names(spark):
    names = "id uid t hits kind start end base found doc lang_pred score rejected held_out pred v label ok w low node block url html n_chars conv k piece window loss turns".split()
    many = [F.lit("x").alias(n) for n in names]
    docs = spark.createDataFrame([(1, "mail a@b.co", "en"), (2, None, None)], "doc_id long, text string, lang string").select("*", *many)
    for df in (docs, docs.limit(0)):
        assert pii.digest(pii.personal_data(df)).count() == predict_languages(df).count() == df.count()
        assert accepted_documents(df).columns == docs.columns and pii.masked(pii.personal_data(df), df).columns == docs.columns
    assert pii.masked(pii.personal_data(docs), docs).where("doc_id = 1").first().text == "mail [email]"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>").select("*", F.lit(1).alias("label"), *[F.lit("x").alias(n) for n in names if n != "label"])
    assert [r.n_links for r in embedding_groups(vectors).collect()] == [1, 1]
    page = spark.createDataFrame([(1, "u", "<p>Hi, you.</p>")], "page_id long, url string, html string").select("*", *[F.lit("x").alias(n) for n in names if n not in ("url", "html")])
    assert extract_main_text(page).first().text == "Hi, you."
    talk = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").select("*", *many)
    assert read_back(chat_windows(talk)).first().turns == "user\nx\n"


APART = '''
import os, sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
sys.path.remove({repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
'''


def test_workers_need_no_package_on_their_path(tmp_path):
    """From another folder, with an empty PYTHONPATH: the driver alone knows where the code is."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK") and not k.startswith("PYSPARK")}
    names = ["op3_embedding_dedup", "op4_main_text", "op5_language", "op6_simhash", "op7_packing", "pipeline"]
    out = subprocess.run([sys.executable, "-c", APART.format(repo=repo, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-2000:]


def test_training_sample_is_the_same_on_every_run_and_knows_all_languages(spark):
    rows = [(i, f"word{i % 7} text{i % 400} some more", f"l{i % 400}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = training_sample(df), training_sample(df.repartition(5))
    assert a == b and len(set(a[1])) == 400
