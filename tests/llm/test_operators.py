"""Every corpus operator against a plain version, and on null, empty, long, tied, repeated and clashing rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import components, conversations, decontaminate, jaccard, langid, lm, mixing, pii, topk, toxicity, warc
from folioforge.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# 1: WARC


def test_warc_round_trip(spark):
    big = "x" * 300_000
    rows = [(1, "http://a.example.com/p?q=1#f", "<p>" + "é" * 100), (2, "https://b.example.com:8080/", "<p>" + "é" * 100), (3, None, None), (4, "no url", ""), (5, "http://a.example.com/p?q=1", "small"), (6, "http://c.example.com/ with blank", "small"), (7, "http://d.example.com", big), (7, "http://d.example.com", big), (None, "http://e.example.com", big), (9, "http://d.example.com", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("at", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    expected = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if h == html and p is not None and n(h) >= warc.REVISIT_BYTES]
        revisit = n(html) >= warc.REVISIT_BYTES and page != min(same)
        expected.append((page, n(html), sha(html), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(expected, key=str)


def test_warc_lookup_finds_only_the_key(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/{i % 50}", f"page {i}") for i in range(500)], "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(pages), block_lines=16)
    assert len(index.directory) > 10
    wanted = spark.createDataFrame([("http://h3.example.org/3",), ("http://h3.example.org/none",), ("http://zzz.example/",)], "url string")
    got = {r.page_id: bytes(r.html).decode() for r in warc.read_records(warc.locate(index, wanted), payload=True).collect()}
    assert got == {i: f"page {i}" for i in range(500) if i % 7 == 3 and i % 50 == 3}


def test_warc_keys_and_empty_table(spark):
    assert warc.url_key("http://www.Example.com:80/a?b=c#d") == "com,example,www)/a?b=c"
    assert warc.url_key("https://x.org:444/") == "org,x:444)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2: mixing


def water_fill(sizes, weights, cap):
    targets, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > cap * sizes[s]]
        if not over:
            return targets | {s: w * level for s, w in free.items()}
        for s in over:
            targets[s] = cap * sizes[s]
            left -= targets[s]
            del free[s]
    return targets


def test_mix_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(1, 120), ["a", "b", "c"]), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", "s4", None]), 0) for i in range(3000)]
    got = mixing.mix(docs(spark, rows).withColumn("taken", F.lit("clash"))).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3.0)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 5
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_mix_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", "en", "b", 0), (None, "one two", "en", None, 0), (5, "x " * 20_000, "en", "a", 0), (6, "y z", None, "c", 0), (6, "y z", None, "c", 0)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 2, 2, 2, 20000]
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r.target for r in mixing.mix(docs(spark, [(1, "", "en", "a", 0)])).collect()} == {0.0}


# 3: decontamination


def test_latent_search_finds_leaks_and_paraphrases(spark):
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(40)], [f"rare{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    items = [(i, text(rng.randint(15, 55))) for i in range(30)]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    rows, planted = [], set()
    for d in range(300):
        body = text(rng.randint(5, 400))
        if d % 10 == 0:
            i = (d // 10) % 30
            leak = items[i][1].split()
            if d % 20 == 0:  # a paraphrase: a tenth of the words replaced
                for k in rng.sample(range(len(leak) - 6), len(leak) // 10):
                    leak[k] = rng.choice(rare)
            body = f"{body} {' '.join(leak).upper()}, {text(rng.randint(0, 60))}"
            planted.add((d, i))
        rows.append((d, body, "en", "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, items[3][1], "en", "s", 0), (1002, text(30_000) + " " + items[4][1], "en", "s", 0)]
    d = docs(spark, rows).withColumn("leaks", F.lit("clash"))
    index = decontaminate.fit(d, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(d, index).collect()}
    assert got == planted | {(None, 3), (1002, 4)}
    kept = decontaminate.clean(d, index)
    assert kept.columns == d.columns and kept.count() == d.count() - len(planted) - 2
    nothing = decontaminate.fit(d, bench.limit(0))
    assert decontaminate.pairs(d, nothing).count() == 0
    assert decontaminate.pairs(d.limit(0), index).count() == 0


@pytest.mark.parametrize("group", [8, 1])
def test_long_items_are_spread_over_blocks(spark, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    monkeypatch.setattr(decontaminate, "GROUP", group)
    rng = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(20)), (2, text(4_000)), (3, text(40)), (4, text(1_500))]
    changed = items[1][1].split()
    for k in rng.sample(range(len(changed)), 200):
        changed[k] = "other"
    rows = [(0, text(500), "en", "s", 0), (1, f"{text(30)} {items[1][1]}", "en", "s", 0), (2, " ".join(changed), "en", "s", 0), (3, f"{items[3][1]} {text(100)} {items[0][1]}", "en", "s", 0), (4, items[2][1], "en", "s", 0), (5, " ".join(items[1][1].split()[:900]), "en", "s", 0)]
    d = docs(spark, rows)
    index = decontaminate.fit(d, spark.createDataFrame(items, "item_id long, text string"))
    assert len(index) >= 5 and all(len(x.latent) <= 64 and x.basis.shape[1] <= 64 for x in index)
    assert sum(len(x.latent) for x in index) == sum(len(decontaminate.passages(t.split())) for _, t in items)
    found = decontaminate.pairs(d, index).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 2), (2, 2), (3, 1), (3, 4), (4, 3)]
    assert all(r.lcs == 1.0 for r in found if r.doc_id != 2)


def test_recall_on_the_corpus(spark, data, corpus):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    index = decontaminate.fit(corpus, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(corpus, index).collect()}
    words = {r.doc_id: f" {' '.join(decontaminate.terms(r.text))} " for r in corpus.collect()}
    exact = {(d, i) for d, t in words.items() for x in index for i, ws in x.items if f" {' '.join(ws)} " in t}
    assert exact <= got and len(got - exact) <= 0.05 * len(exact) + 1


def test_more_passages_than_directions(spark, corpus, monkeypatch):
    """Several blocks, and fewer directions than passages: exact leaks and paraphrases are found all the same."""
    monkeypatch.setattr(decontaminate, "BLOCK", 60)
    rng = random.Random(8)
    pool = [f"{a}{b}" for a in "abcdefghij" for b in ("lo", "mi", "ne", "po", "ra", "su", "ti", "vu", "xe", "za", "bre", "cla", "dro")]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(15, 60)))) for i in range(90)]
    rows = []
    for i, t in items:
        ws, around = t.split(), [rng.choice(pool) for _ in range(60)]
        if i % 2:
            ws = [rng.choice(pool) if rng.random() < 0.12 else w for w in ws if rng.random() > 0.05]
        rows.append((i, " ".join([*around[:30], *ws, *around[30:]]), "en", "s", 0))
    d = docs(spark, rows)
    index = decontaminate.fit(d.unionByName(corpus.select(*d.columns)), spark.createDataFrame(items, "item_id long, text string"))
    assert len(index) > 1 and all(x.basis.shape[1] < len(x.latent) for x in index)
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(d, index).collect()}
    assert sum((i, i) in got for i in range(0, 90, 2)) >= 44 and sum((i, i) in got for i in range(1, 90, 2)) >= 41
    assert len(got - {(i, i) for i in range(90)}) <= 2


@pytest.mark.parametrize("grown", [1, 20_000])
def test_short_items_and_paraphrases_whatever_the_corpus_size(spark, monkeypatch, grown):
    """Short items of frequent words inside long texts; a corpus of 10 million documents has the shares of a small one."""
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(60)], [f"rare{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.sample(common, rng.randint(10, 20)))) for i in range(20)]
    rows, planted = [], set()
    for d in range(500):
        body = [rng.choice(rare) for _ in range(rng.randint(20, 60))]
        if d % 5 == 0:
            i = d // 5 % 20
            leak = items[i][1].split()
            if d % 2:  # a paraphrase: one word replaced
                leak[rng.randrange(len(leak) - 6)] = rng.choice(rare)
            at = rng.randint(0, len(body))
            body[at:at] = leak
            planted.add((d, i))
        else:
            body += rng.sample(common, 12)
            rng.shuffle(body)
        rows.append((d, " ".join(body), "en", "s", 0))
    d = docs(spark, rows)
    counted = decontaminate.document_frequency

    def many(*args):
        df, total = counted(*args)
        return df * grown, total * grown

    monkeypatch.setattr(decontaminate, "document_frequency", many)
    index = decontaminate.fit(d, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(d, index).collect()}
    assert planted <= got


def test_no_passage_that_reaches_the_energy_is_dropped(spark, corpus):
    """Against every passage projected by a plain sum; passages that repeat a word gain length."""
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "eta theta iota kappa alpha")], "item_id long, text string")
    (index,) = decontaminate.fit(corpus, bench)
    rng = random.Random(7)
    known, other = "alpha beta gamma delta eta theta iota kappa".split(), [f"w{i}" for i in range(500)]
    texts = [[rng.choice(known[: rng.randint(1, 8)]) if rng.random() < rng.random() / 4 else rng.choice(other) for _ in range(rng.randint(1, 90))] for _ in range(400)]
    got = {(d, at, i) for d, at, i, _ in decontaminate.Searcher(index).candidates(texts)}
    expected, sure = set(), set()
    for d, ws in enumerate(texts):
        b = np.array([decontaminate.bucket(w) for w in ws])
        for k, p in enumerate(decontaminate.passages(b)):
            z = index.basis[index.rows[p]].astype(float).sum(axis=0)
            energy, norm = np.linalg.norm(z), math.sqrt((index.idf[p] ** 2).sum())
            if not energy:
                continue
            for j, cos in enumerate(index.latent @ z / energy):
                if energy >= (decontaminate.ENERGY + 1e-4) * norm and cos >= decontaminate.COSINE + 1e-4:
                    sure.add((d, k * decontaminate.STEP, int(index.owner[j])))
                if energy >= (decontaminate.ENERGY - 1e-4) * norm and cos >= decontaminate.COSINE - 1e-4:
                    expected.add((d, k * decontaminate.STEP, int(index.owner[j])))
    assert len(sure) > 50 and sure <= got <= expected


def test_lcs():
    rng = random.Random(3)
    for _ in range(50):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs_length(a, b) == table[-1, -1]


# 4: conversations


def test_snapshot_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok")]
    convs = {1: base[:2], 2: base, 3: base, 4: base[:1], 5: [("user", "hello"), ("assistant", "hi")], 6: base[1:], 7: [("user", None), (None, "x")], 8: base + [("user", f"t{i}") for i in range(600)], 9: [("user", "dup"), ("user", "dup")], 10: [("user", "dup")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost")]
    random.Random(4).shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h1", F.lit("clash"))
    got = conversations.collapse(d).collect()
    full = {c: tuple((r or "", t or "") for r, t in x) for c, x in convs.items()}
    proper = {x[:k] for x in full.values() for k in range(1, len(x))}
    first = {}
    for c, x in sorted(full.items()):
        first.setdefault(x, c)
    keep = {c for x, c in first.items() if x not in proper}
    assert {r.conv_id for r in got} == keep == {5, 6, 7, 8, 9}
    for c in keep:
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [(r.role, r.rendered) for r in mine] == [(r, f"<|{r}|>\n{t}\n<|end|>\n") for r, t in full[c]]
        assert {r.n_turns for r in mine} == {len(full[c])}
    assert conversations.collapse(d.limit(0)).count() == 0


def test_same_turn_numbers_are_ordered_by_content(spark):
    rows = [(1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, None, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in conversations.collapse(d).collect()} == {1}


# 5: language


def test_language_accuracy_and_odd_texts(spark, corpus):
    held = corpus.withColumn("h", held_out("doc_id", 4))
    net = langid.fit(held.where(~F.col("h")))
    got = langid.identify(held.where("h").withColumn("score", F.lit("clash")), net).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = docs(spark, [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "123 !?", "en", "s", 0), (4, "a", "en", "s", 0), (5, "the that and " * 20_000, "en", "s", 0), (5, "the that and " * 20_000, "en", "s", 0)])
    pred = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, net).orderBy("doc_id").collect()]
    assert [p[1] for p in pred[:3]] == ["und"] * 3 and [p[2] for p in pred[:3]] == [0.0] * 3
    assert pred[3][1] != "und" and pred[4][1:] == pred[5][1:] == (pred[4][1], pred[4][2]) and pred[4][1] == "en"
    assert langid.fit(odd.where("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), net).count() == 0


def test_network_tables_agree_with_filters():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], [rng.normal(size=(w, langid.KINDS, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], np.zeros(24, np.float32), rng.normal(size=(24, 2)).astype(np.float32), np.zeros(2, np.float32))
    x, _, _ = langid.windows([bytes(rng.integers(0, 256, 700, dtype=np.uint8))])
    plain = langid.softmax(np.maximum(net.pooled(x)[0] + net.bias, 0) @ net.dense + net.offset)
    assert np.allclose(plain, net.probabilities(x, net.tables()), atol=1e-5)


# 6: Jaccard join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def near_copies(seed, n_base=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = sentence(rng, 40, vocabulary)
    rows, d = [], 1000
    for _ in range(n_base):
        base = sentence(rng, rng.randint(60, 200), vocabulary).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((d, " ".join(w)))
            d -= 1
    for _ in range(40):  # documents that share a passage only
        rows.append((d, f"{sentence(rng, rng.randint(5, 80), vocabulary)} {passage} {sentence(rng, rng.randint(5, 80), vocabulary)}"))
        d -= 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, seed):
    rows = near_copies(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(d).collect())
    plain = jaccard.link(d, links=False)
    assert "n_links" not in plain.columns and sorted((r.doc_id, r.n_shingles, r.component_id) for r in plain.collect()) == got
    assert got == brute_components(rows)


def test_jaccard_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 8)
    rows = near_copies(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark):
    long = "a b c d e f g " * 5_000
    rows = [(9, "A  b\tc"), (8, "a b c"), (7, "a b c d"), (6, None), (5, ""), (4, " \n"), (3, long), (2, long + "h"), (1, " "), (1, " "), (None, "a b C")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(d).collect()), key=str)
    expected = [(9, 1, 8), (8, 1, 8), (7, 1, 7), (6, 0, 6), (5, 0, 5), (4, 0, 4), (3, 7, 2), (2, 8, 2), (1, 1, 1), (1, 1, 1), (None, 1, 8)]
    assert got == sorted(expected, key=str)
    assert jaccard.link(d.limit(0)).count() == 0
    kept = jaccard.keep_one(d.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 5, 6, 7, 8]


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    assert {(r.v, r.label) for r in components.components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(1000, 1000), (1001, 1000)}


# 7: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    pieces = ["a@b.co", "x.y%z@q-r.st.uv", "@", "a@", "@b.c", "a@b@c.d.e", "1.2.3.4", "1.2.3.4.5", "1.2..3.4.5.6", "999.1.1.1", "001.02.3.255", "4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437 1", "+1 (234) 567-8901", "+1", "++12345678", "+1 234 567 8901 23456 789", "é", " ", "\n", ".", "12", "word", "+49.30.1234567."]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", ","]) for _ in range(rng.randint(0, 8)))
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text


def test_base_spans_are_linear():
    for unit in ("1", "a", "1.", "a@", "+1", "+", "."):
        assert len(pii.base_spans(unit * 200_000)) >= 0


def test_long_texts_of_glued_spans_take_linear_time(spark, corpus):
    model = pii.fit(corpus)
    unit = "call +1 (234) 567-8901 4465758382889437 now or a.b@c.de\n"
    took = []
    for n in (500, 4_000):
        began = time.process_time()
        base = pii.base_spans(unit * n)
        added = pii.added_spans(unit * n, base, model)
        took.append(time.process_time() - began)
        assert len(base) == n and all(0 <= a < b <= len(unit) * n for _, a, b in added)
    assert took[1] < 8 * 2.5 * took[0] + 1


def test_semi_markov_adds_what_the_checks_dropped(spark, corpus):
    model = pii.fit(corpus)
    glued = "call +1 (234) 567-8901 4465758382889437 now"
    base = pii.base_spans(glued)
    assert base == []
    assert set(pii.added_spans(glued, base, model)) == {("phone", 5, 22), ("card", 23, 39)}
    for clean in ("version 1.2 of 2024, pages 10-20 and 3.5", "room 12 at 10:30", "a.b. 9. and 10."):
        assert pii.added_spans(clean, [], model) == []
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, f"é a@b.co {glued}", "en", "s", 0), (3, f"é a@b.co {glued}", "en", "s", 0), (4, "word " * 50_000 + "1.2.3.4", "en", "s", 250007), (5, "plain", "en", "s", 5)]
    d = docs(spark, rows).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.detect(d, model).collect()}
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "email:2:8,card:32:48,phone:14:31" and got[3].n_email == 1 and got[3].n_card == 0
    assert got[3].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert got[4].spans == "ip:250000:250007"
    redacted = {r.doc_id: r for r in pii.redact(d, model).collect()}
    assert redacted[3].text == "é <EMAIL> call <PHONE> <CARD> now" and redacted[3].n_chars == len(redacted[3].text)
    assert redacted[5].text == "plain" and redacted[5].n_chars == 5 and redacted[1].text is None
    assert pii.redact(d, model).columns == d.columns and pii.detect(d.limit(0), model).count() == 0


def test_forward_agrees_with_enumeration():
    rng = np.random.default_rng(1)
    m = pii.SemiMarkov(rng.normal(size=(len(pii.TYPES), len(pii.FEATURES))), rng.normal(size=(len(pii.TYPES), len(pii.TYPES))))
    text = "a 12 b@c.de"
    tokens = [x.span() for x in pii.WORD.finditer(text)]
    s = m.potentials(m.lattice(text, tokens))
    scores = []

    def walk(at, before, total, path):
        if at == len(tokens):
            scores.append((total, path))
            return
        for n in range(1, len(tokens) - at + 1):
            for k in range(len(pii.TYPES)):
                if k and True or n == 1:
                    walk(at + n, k, total + m.trans[before, k] + s[at + n - 1, n - 1, k], [*path, (at + n - 1, n, k)])

    walk(0, 0, 0.0, [])
    assert math.isclose(np.logaddexp.reduce(m.forward(s)[-1]), np.logaddexp.reduce([x for x, _ in scores]))
    assert m.decode(s) == [x for x in max(scores, key=lambda x: x[0])[1] if x[2]]
    inside = np.logaddexp.reduce([x for x, p in scores if (2, 1, 1) in p]) - np.logaddexp.reduce([x for x, _ in scores])
    assert math.isclose(m.posterior(s, 2, 1, 1), inside - math.log1p(-math.exp(inside)), rel_tol=1e-6)


# 8: top-k


def brute_top_k(vectors, k):
    q = {i: [math.floor(float(x) * 256) for x in v] for i, v in vectors.items()}
    out = set()
    for i in q:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-3, 4, 6).astype(np.float32) / 4 for i in range(400)}
    for i in range(100, 250):
        vectors[i] = vectors[0]  # ties
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()]
    rows += [(1000, None, "x"), (1050, [float("nan")] * 6, "x"), (1100, [1.0, None], "x"), (1150, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = {tuple(r) for r in topk.top_k(d.where("vec_id % 50 = 0"), d, "vec_id", "embedding").collect()}
    assert got == brute_top_k(vectors, 5)


def test_top_k_small_and_empty(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, []), (2, [])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(d.where("vec_id = 0"), d, "vec_id", "embedding").collect()}
    assert got == {(0, 1, 1, 65536), (0, 2, 2, 0), (0, 3, 2, 0)}  # every row is a candidate, repeated ones too
    assert topk.top_k(d.limit(0), d, "vec_id", "embedding").count() == 0
    assert topk.top_k(d.where("vec_id = 0"), d.where("vec_id = 0"), "vec_id", "embedding").count() == 0


def test_top_k_is_exact_for_large_components_and_repeated_ids(spark):
    d = spark.createDataFrame([(0, [1e5, 1e5]), (1, [1e5, 1e5]), (2, [-1e5, 3.0])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(d.where("vec_id = 0"), d, "vec_id", "embedding").collect()}
    assert got == {(0, 1, 1, 2 * 25_600_000**2), (0, 2, 2, 25_600_000 * (768 - 25_600_000))}
    # beyond 64 bits: ranked exactly, returned as the nearest long
    d = spark.createDataFrame([(0, [1e12]), (1, [1e12]), (2, [2e12]), (3, [-1e12]), (4, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(d.where("vec_id = 0"), d, "vec_id", "embedding").orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 2, 4, 3] or [r[2] for r in got] == [2, 1, 4, 3]
    assert got[0][3] == 2**63 - 1 and got[-1][3] == -(2**63) and got[2][3] == 256 * 256_000_000_000_000
    # rows that repeat the query's id: all but its own are candidates, and each such query has its own result
    rows = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (7, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(d.where("vec_id = 50"), d, "vec_id", "embedding", groups=3).collect())
    want = []
    for i, (a, v) in enumerate(rows):
        if a == 50:
            scored = sorted((-sum(int(x * 256) * int(y * 256) for x, y in zip(v, w, strict=True)), b) for j, (b, w) in enumerate(rows) if j != i)
            want += [(50, r + 1, b, -s) for r, (s, b) in enumerate(scored)]
    assert got == sorted(want)


# 9: toxicity


def test_toxicity_on_held_out_rows(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{big}/documents.parquet").withColumn("h", held_out("doc_id", 4)).withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{big}/labels.parquet")
    chain = toxicity.fit(d.where("not h"), labels)
    got = {r.doc_id: r for r in toxicity.tag(d.where("h"), chain).collect()}
    gold = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got}
    hit = sum(got[i].predicted == y for i, y in gold.items())
    assert hit >= 0.9 * len(gold)
    for r in got.values():
        assert all(r.text[s.start : s.end].isalpha() for s in r.toxic_spans)


def test_a_document_is_one_chain(spark):
    rng = np.random.default_rng(2)
    chain = toxicity.Chain({"=bad": 0, "=awful": 1}, np.array([3.0, 2.0]), -2.0, rng.normal(size=(2, 2)))
    texts = [[rng.choice(["bad", "awful", "x", "x", "x", "x", "x", "x"]) if rng.random() < 0.2 else "x" for _ in range(n)] for n in (0, 1, 5, 64, 65, 128, 300, 1000)] + [["x"] * 200]
    for words, p in zip(texts, toxicity.Tagger(chain).marginals(texts), strict=True):
        assert len(p) == len(words)
        if words:
            e = np.array([[chain.score(w) for w in words]]) + chain.bias
            plain = toxicity.forward_backward(e, np.ones_like(e, bool), chain.trans)[0][0]
            assert np.abs(p - plain).max() < 1e-9
    rows = [(i, f"{'awful thing' if i % 3 == 0 else 'nice thing'} w{i % 7}", "x", "x", "x") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y string, l_key string, t string")
    y = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(60)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r.predicted for r in toxicity.tag(d, toxicity.fit(d, y)).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(60))


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=(1, toxicity.CHAIN)), rng.normal(size=(2, 2))
    mask = np.zeros((1, toxicity.CHAIN), bool)
    mask[0, :6] = True
    p, _, z = toxicity.forward_backward(e * mask, mask, trans)
    paths = [[(i >> t) & 1 for t in range(6)] for i in range(64)]
    scores = np.array([sum(e[0, t] * s for t, s in enumerate(x)) + sum(trans[a, b] for a, b in zip(x, x[1:], strict=False)) for x in paths])
    w = np.exp(scores - np.logaddexp.reduce(scores))
    assert math.isclose(z[0], np.logaddexp.reduce(scores))
    assert np.allclose(p[0, :6], [sum(q for q, x in zip(w, paths, strict=True) if x[t]) for t in range(6)]) and not p[0, 6:].any()


def test_toxicity_odd_rows(spark):
    rng = random.Random(6)
    clean = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = sentence(rng, 30, clean).split()
        for w in ("vilestuff", "nastything") if bad else ():
            words.insert(rng.randrange(31), w)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels += [(i, 0, int(bad)), (i, 0, 0)]
    d, y = docs(spark, rows), spark.createDataFrame([*labels, (None, 0, 1), (7, 0, None), (8, 0, 5)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(d, y)
    odd = docs(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "é vilestuff, " + "worda " * 30_000 + "nastything", "en", "s", 0), (4, "wordab", "en", "s", 0), (4, "wordab", "en", "s", 0)])
    got = toxicity.tag(odd, chain).orderBy("doc_id").collect()
    assert got[0].score == got[1].score and got[0].predicted == 0
    assert [(s.start, s.end) for s in got[2].toxic_spans][0] == (2, 11) and len(got[2].toxic_spans) == 2
    assert got[3].score == got[4].score and got[3].predicted == 0
    short = docs(spark, [(1, "worda vilestuff nastything", "en", "s", 0)])
    assert toxicity.tag(short, chain).first().predicted == 1
    none = toxicity.fit(d, y.limit(0))
    assert {r.score for r in toxicity.tag(odd, none).collect()} == {0.0}
    assert toxicity.tag(odd.limit(0), chain).count() == 0


def test_toxicity_of_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(8)
    rows = [(i % 5, " ".join(rng.choice(("calm", "word", "plain")) for _ in range(20)) + (" vilestuff" if i % 5 == 0 else "") + " " + "z" * 5_000, "en", "s", 0) for i in range(300)]
    d = docs(spark, rows).withColumn("y", F.lit("clash")).withColumn("l_key", F.lit(1)).withColumn("h", F.lit(2))
    labels = spark.createDataFrame([(i, 0, int(i == 0)) for i in range(5)], "doc_id long, quality int, toxic int").withColumn("y", F.lit(3))
    chain = toxicity.fit(d, labels, toxic=2, other=3)  # 20 rows at most for the last layer, of 300
    got = toxicity.tag(d, chain)
    assert got.columns == [*d.columns, "score", "predicted", "toxic_spans"]
    mean = {bad: np.mean([r.score for r in got.collect() if (r.doc_id == 0) == bad]) for bad in (True, False)}
    assert mean[True] > mean[False]


# 10: language model


def plain_base(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def scored(spark, rows, head=lm.HEAD, passes=lm.PASSES):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", held_out("doc_id", 7)).withColumn("n_tokens", F.lit("clash"))
    counts, top, model = lm.fit(d.where("not held_out"), head=head, passes=passes)
    return lm.score(d, counts, top, model), top, model


def same(got, expected):
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, expected, strict=True))


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_base_score_matches_counting(spark, corpus, head):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").limit(80).collect()]
    rows += [(500, None), (501, ""), (502, "  \x1f"), (503, "A a  a\tB"), (503, "A a  a\tB"), (None, "null id"), (504, "long " * 30_000)]
    d, _, _ = scored(spark, rows, head)
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in d.collect()], plain_base(rows))


def test_model_is_normalised_and_learns(spark):
    rng = random.Random(8)
    nxt = {w: rng.choice("abcdefgh") for w in "abcdefgh"}
    rows = []
    for i in range(300):
        w, out = rng.choice("abcdefgh"), []
        for _ in range(60):
            out.append(w)
            w = nxt[w] if rng.random() < 0.8 else rng.choice("abcdefgh")
        rows.append((i, " ".join(out)))
    d, top, model = scored(spark, rows, passes=20)
    n = len(model.group)
    for one, two in ((0, 0), (3, 5), (8, 1)):
        assert math.isclose(np.exp(model.log_probabilities(np.full(n, one), np.full(n, two), np.arange(n))).sum(), 1, rel_tol=1e-4)
    held = [r for r in d.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_open_vocabulary_sums_to_one(spark):
    _, top, model = scored(spark, [(i, f"w{i % 400} w{i % 3} x") for i in range(1000)])
    scorer = lm.Scorer(top, model)
    end, n = scorer.symbols.end, len(model.group)
    first = lambda symbols: np.exp(model.log_probabilities(np.full(len(symbols), end), np.full(len(symbols), end), symbols))
    # a word's probability as the first of a text: the text's score without its end's
    p = 0.0
    for w in top.head:
        if w:
            c = scorer.symbols.of_head[top.head[w]]
            p += 10 ** scorer.batch([w])[0][3][0] / float(np.exp(model.log_probabilities(np.array([c]), np.array([end]), np.array([end])))[0])
    unseen = (first(scorer.symbols.of_part) * 10 ** scorer.symbols.share[scorer.symbols.of_part]).sum()
    assert n == len(top.head) + lm.REST and math.isclose(p + first(np.array([end]))[0] + unseen, 1, rel_tol=1e-4)
    # with a small single-word vocabulary most words share symbols, and the sum is still one
    one = scorer.batch([b"w399 never-seen"])[0][3][0]
    assert -12 < one < 0


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    d, _, _ = scored(spark, [(held, "a b")])
    r = d.first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0
    assert scored(spark, [])[0].count() == 0


def test_products_are_shipped_in_single_precision(spark, monkeypatch):
    sent, kind = [], type(spark.sparkContext)
    plain = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, x: sent.append(x) or plain(self, x))
    rows, w = [([0, 1, 2], 1.0), ([1, 3, 3], 0.5)], np.array([1.0, 2.0, 3.0, 0.5])
    x = np.random.default_rng(1).normal(size=(4, 2))
    terms = [(np.bincount(ids, minlength=4) * w, weight) for ids, weight in rows]
    expected = sum(weight * np.outer(t, t @ x) for t, weight in terms)
    got = decontaminate.gram_times(spark.createDataFrame(rows, "ids array<int>, weight double"), x, w)
    assert np.allclose(got, expected, rtol=1e-5)
    assert sent[0][0].dtype == np.float32  # doubles took the pipeline's driver over its limit
