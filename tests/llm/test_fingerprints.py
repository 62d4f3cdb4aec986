"""Sketches, spelling variants and vector codes against plain versions, and on null, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import codes, sketch, spelling

DOCS = "doc_id long, text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# 11: sketches


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    rolled = [" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [" ".join(ws)] * bool(ws)
    return {hashlib.md5(s.encode()).hexdigest()[:16] for s in rolled}


def low(hashes, k=128):
    return sorted(hashes)[:k]


def likeness(a, b, k=128):
    u = low(set(a) | set(b), k)
    return len([x for x in u if x in a and x in b]) / len(u) if u else 1.0


def prose(rng, n):
    return " ".join(rng.choice("alpha Bravo charlie delta écho foxtrot golf hotel india juliet kilo lima".split()) + str(rng.randrange(30)) for _ in range(n))


def test_fingerprints(spark):
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [(i * 11, prose(rng, rng.choice([0, 1, 3, 5, 40, 300, 900]))) for i in range(120)]
    rows += [(2, None), (3, ""), (4, " \t\n"), (5, "Ünï çödé 𝒳𝒴𝒵"), (6, long), (8, long + " more words here now yes"), (9, rows[50][1]), (900, "one two three four five"), (None, "no id at all")]
    df = spark.createDataFrame(rows, DOCS).withColumn("at", F.lit(1)).withColumn("tie", F.lit("x")).withColumn("stretch", F.lit(None).cast("int"))
    got = {r.doc_id: r for r in sketch.fingerprints(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[key]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (low(shingles(t)) for t in (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(a), "".join(b))
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
        n = len(shingles(text))
        assert r.n_distinct == n if n < 128 else abs(r.n_distinct / n - 1) < 0.35
    assert got[9].fingerprint == got[rows[50][0]].fingerprint
    assert got[6].near_next > 0.9 and got[6].in_next > 0.9


def test_fingerprints_of_few_rows(spark):
    assert sketch.fingerprints(spark.createDataFrame([], DOCS)).collect() == []
    (only,) = sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], DOCS)).collect()
    assert only.near_next == 1.0 and only.n_chars == 15
    same = sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f")] * 4 + [(None, None)] * 2, DOCS)).collect()
    assert Counter((r.doc_id, r.near_next) for r in same) == {(1, 1.0): 3, (1, 0.0): 1, (None, 1.0): 1, (None, 0.0): 1}


def test_a_frequent_key_is_cut_by_its_texts(spark):
    rows = [(500, f"text number {i} of the key {i % 17}") for i in range(600)] + [(i, f"other {i} one two three four") for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    stretches, _ = sketch._rows_with_stretch(df, "doc_id", "text")
    assert stretches.where("id = 500").select("stretch").distinct().count() > 3
    got = sketch.fingerprints(df)
    assert got.count() == len(rows)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    r = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = r.withColumn("both", sketch.merged(F.col("a"), F.col("b"))).select("*", sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_shingles(F.col("both")).alias("n"), sketch.parsed(sketch.fingerprint(F.col("a"))).alias("back")).first()
    assert abs(r.r - 1 / 3) < 0.13 and abs(r.c - 0.5) < 0.17 and abs(r.n / 2992 - 1) < 0.3 and r.back == r.a
    assert r.both == low(shingles(a) | shingles(b))
    texts = [(rng.choice(["x", "y", None]), prose(rng, 80)) for _ in range(60)] + [("z", "")]
    merged = sketch.merge_groups(spark.createDataFrame(texts, "g string, t string").select("g", sketch.sketch(F.col("t"), 32).alias("s")), ["g"], "s", 32)
    groups = defaultdict(set)
    for g, t in texts:
        groups[g] |= shingles(t)
    assert {m.g: m.s for m in merged.collect()} == {g: low(h, 32) for g, h in groups.items() if h}


# 12: spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, n, len(found))
    return out


def test_dictionary(spark):
    texts = [(i, " ".join(random.Random(i).choice(["Éclairages", "colourful", "COLOURFUL", "x", "abcdefg", "naïveté-abcdefgh1ijklmnop", "ÀÿÀÿÀÿÀ"]) for _ in range(30))) for i in range(300)]
    texts += [(None, "colourful colourful abcdefg"), (1, None), (2, ""), (3, "onlyonce")]
    counts = Counter()
    for key, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    df = spark.createDataFrame(texts, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    assert {r.word: r.n for r in spelling.dictionary(df).collect()} == {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("pairs", [1, 40, 10_000])
def test_variants(spark, pairs):
    rng = random.Random(pairs)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"internation" + x + y for x in "abcdefg" for y in "klmnop"} | {"internationa", "internation", "𝒳internation", "𝒳nternation", "ä" * 40, "ä" * 39, "ä" * 38 + "b"}
    counts = {w: rng.choice([2, 3, 30, 300, 3_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("block", F.lit(0)).withColumn("even", F.lit("x"))
    got = {r.word: r for r in spelling.variants(df, pairs=pairs).collect()}
    expected = plain_variants(counts)
    assert {w: (r.form, r.n, r.n_near) for w, r in got.items()} == expected
    for w, r in got.items():
        end = w
        while expected[end][0]:
            end = expected[end][0]
        assert r.root == end and r.form_n == (counts[r.form] if r.form else None)


def test_skewed_blocks_make_few_pairs(spark):
    words = spark.createDataFrame([("sharedbeginning" + "".join(c) + "sharedend", 2) for c in [f"{a:04d}" for a in range(3000)]], "word string, n long")
    assert spelling.near_pairs(words).count() == sum(1 for a in range(3000) for p in range(4) for d in range(10) if (b := a + (d - a // 10**p % 10) * 10**p) > a and b < 3000)


def test_no_words(spark):
    assert spelling.variants(spelling.dictionary(spark.createDataFrame([(1, "a bc"), (2, None)], DOCS))).collect() == []


# 13: vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, integer vector), by id."""
    at = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * at : (p + 1) * at]
    books = [[cut(v, p) for _, _, v in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for _, _, v in rows:
                mine[best(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if mine[i] else e for i, e in enumerate(book)]
    found = [[best(cut(v, p), books[p]) for p in range(parts)] for _, _, v in rows]
    errors = [sum(d for d, _ in f) for f in found]
    sums = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), e, sums[label], sha) for (i, label, _), f, e in zip(rows, found, errors, strict=True)]


def test_vector_codes(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 2, None]), [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, 1, rows[i][2]) for i in range(20)] + [(300, 2, [3e30] * 7 + [-1e-30])]
    bad = [(301, 1, None), (302, 1, [1.0] * 7 + [None]), (303, 1, [float("nan")] * 8), (304, 1, [float("-inf")] + [0.0] * 7), (305, 1, [1.0] * 4)]
    schema = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame(rows + bad, schema).withColumn("v", F.lit(1)).withColumn("code", F.lit(2)).repartition(5)
    got = sorted(tuple(r)[:5] for r in codes.compress(df, entries=32).collect())
    whole = [(i, label, [math.floor(int(float(np.float32(x))) * 1024 if abs(x) > 1e20 else float(np.float32(x)) * 1024) for x in v]) for i, label, v in rows]
    assert got == plain_codes(whole, entries=32)


def test_vector_codes_of_odd_rows(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert codes.compress(spark.createDataFrame([(1, "a", None)], schema)).collect() == []
    rows = [(1, "a", [1.0, 2.0, 3.0]), (1, "a", [1.0, 2.0, 3.0]), (None, None, [5.0, 5.0, 5.0]), (None, None, [5.0, 5.0, 5.5])]
    got = codes.compress(spark.createDataFrame(rows, schema), entries=2).collect()
    assert len(got) == 4 and {r.label_error for r in got if r.label is None} == {sum(r.error for r in got if r.label is None)}
    assert [r.code for r in codes.compress(spark.createDataFrame([(1, "a", [])], schema)).collect()] == ["00000000"]


def test_tree_search_is_exact():
    rng = np.random.default_rng(9)
    for book in (rng.integers(-50, 50, (256, 16)), rng.integers(0, 2, (200, 4)), np.zeros((40, 3), np.int64), rng.integers(-(2**26), 2**26, (100, 16)), rng.integers(0, 9, (1, 2))):
        points = np.concatenate([book, book + rng.integers(-2, 3, book.shape), rng.integers(-60, 60, (500, book.shape[1]))])
        index, d2 = codes.nearest(points, book, codes.tree(book))
        every = ((points[:, None] - book[None]) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (d2 == every.min(1)).all()
        index, d2 = codes.nearest(points.astype(object) * 10**20, book.astype(object) * 10**20, codes.tree(book.astype(object) * 10**20))
        assert (index == every.argmin(1)).all() and (d2 == every.min(1).astype(object) * 10**40).all()
