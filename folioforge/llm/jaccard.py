"""N-gram Jaccard join by vertical partitioning.

Every document becomes the set of hashes of its five-word shingles. The hash space is cut into fragments;
each fragment finds which of its shingles several different sets have and how many (document frequency).
Shingles are in one global order, rare ones first, and that order is cut at fixed pivots. A set can only
link if enough of its shingles are shared, and linked sets share one of the first few (prefix filter).
For candidate pairs the overlap is counted separately in each fragment of the order and summed per pair.

Large groups never expand into all their pairs: a first round compares each set with one leader per
shingle, and a second one only sets that are still in different components. Links are then counted within
components, block of sets against block of sets inside tasks, so that no pair is a row.

Equal sets (exact copies) are one node. Sets and shingles are told apart by 64- and 48-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, forget, fresh, release, words, written
from .components import components

SHINGLE, PERCENT = 5, 75
#: Shingles in one task's block and (about) in one fragment.
BLOCK, FRAGMENT, FRAGMENTS = 1_000_000, 1_500_000, 32
#: A shingle is frequent if a block has it in so many sets and, over all blocks, an eighth of them do on
#: average: fewer than BLOCK / (HOT / 8) shingles can be, so their list has a fixed bound.
HOT = 64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BITS = 48
#: Pivots of the global order as (document frequency, share of the hash range).
PIVOTS = ((2, 0.25), (2, 0.5), (2, 0.75), (3, 0.0), (3, 0.5), (4, 0.0), (8, 0.0), (64, 0.0))
DF_MAX = (1 << 14) - 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Distinct shingle hashes, ascending; the whole sequence is one shingle if it has fewer words."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    if len(hashes) > 300_000:
        hashes.clear()
    if len(w) < SHINGLE:
        return mixed((w * FACTORS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    h = w[:n] * FACTORS[0]
    for j in range(1, SHINGLE):
        h += w[j : j + n] * FACTORS[j]
    return np.unique(mixed(h))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, h, n, sid) per row, h the text's hash, written; and the frequent shingles with their counts, ascending."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pending, size = Hashes(), {}, 0

        def frequent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(list(pending.values())) >> np.uint64(64 - BITS), return_counts=True)
            h, n = h[n >= HOT].astype(np.int64), n[n >= HOT]
            m = len(h) + 1  # and a row that says one block is done
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.append(n, 1)), pa.array(np.append(h, -1)), pa.array([True] * m)], names)

        names = ["key", "h", "n", "sid", "frequent"]
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), []
            for i, t in enumerate(byte_values(batch.column(1))):
                s = shingle_set(t, hashes)
                n[i] = len(s)
                sid.append(set_id(s) if len(s) else None)
                if len(s) and sid[-1] not in pending:
                    pending[sid[-1]] = s
                    size += len(s)
                    if size >= BLOCK:
                        yield frequent()
                        pending, size = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n), pa.array(sid, pa.int64()), pa.array([False] * len(n))], names)
        if pending:
            yield frequent()
        pending, hashes = {}, Hashes()
        release()

    out = written(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInArrow(scan, "key long, h long, n long, sid long, frequent boolean"), "jaccard-sets")
    hot = out.where("frequent").groupBy("sid").agg(F.sum("n").alias("n"))
    blocks = max(1, hot.where("sid = -1").agg(F.sum("n")).first()[0] or 1)
    rows = sorted(tuple(r) for r in hot.where((F.col("sid") >= 0) & (F.col("n") >= HOT * max(1.0, blocks / 8))).collect())
    return out.where("not frequent").drop("frequent"), np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def pack(tokens: np.ndarray) -> bytes:
    """48-bit integers in six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.int64)


def fragment_rows(docs: DataFrame, text: str, hot: np.ndarray, fragments: int) -> DataFrame:
    """Per block and fragment: set ids, how many of its shingles each has there, and the shingles.

    Frequent shingles need no counting: they go as rows of their own, dealt over the fragments by block.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pending, size, seq = Hashes(), {}, 0, 0

        def rows() -> pa.RecordBatch:
            ids = np.array(list(pending), np.int64)
            owner = np.repeat(np.arange(len(ids)), [len(s) for s in pending.values()])
            token = (np.concatenate(list(pending.values())) >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.searchsorted(shipped.value, token)
            is_hot = (shipped.value[np.minimum(at, len(shipped.value) - 1)] == token) if len(shipped.value) else np.zeros(len(token), bool)
            part = (token >> 16) * fragments >> (BITS - 16)
            part[is_hot] = fragments
            order = np.lexsort((owner, part))
            part, owner, token = part[order], owner[order], token[order]
            edges = np.searchsorted(part, np.arange(fragments + 2))
            out = []
            for f in range(fragments + 1):
                o, t = owner[edges[f] : edges[f + 1]], token[edges[f] : edges[f + 1]]
                if len(o):
                    who, n = np.unique(o, return_counts=True)
                    out.append((f if f < fragments else (seq + int(ids[0])) % fragments, f == fragments, ids[who].tobytes(), n.astype(np.int32).tobytes(), pack(t)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "hot", "ids", "counts", "tokens"])

        for batch in batches:
            for t in byte_values(batch.column(0)):
                s = shingle_set(t, hashes)
                if len(s) and (i := set_id(s)) not in pending:
                    pending[i] = s
                    size += len(s)
                    if size >= BLOCK:
                        yield rows()
                        pending, size, seq = {}, 0, seq + 1
        if pending:
            yield rows()
        pending, hashes = {}, Hashes()
        release()

    return docs.select(text).mapInArrow(cut, "part int, hot boolean, ids binary, counts binary, tokens binary")


def shared_rows(rows: DataFrame, hot: np.ndarray, hot_n: np.ndarray, buckets: int) -> DataFrame:
    """Of each fragment, the shingles of two and more sets as order keys (frequency, hash), dealt by set id."""
    shipped = rows.sparkSession.sparkContext.broadcast((hot, hot_n))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, keys = [], []
        for is_hot in (False, True):
            part = pdf[pdf["hot"] == is_hot]
            if not len(part):
                continue
            sid = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)) for i, n in zip(part["ids"], part["counts"], strict=True)])
            token = np.concatenate([unpack(t) for t in part["tokens"]])
            order = np.lexsort((sid, token))
            sid, token = sid[order], token[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])  # copies in several blocks count once
            sid, token = sid[new], token[new]
            if is_hot:
                n = shipped.value[1][np.searchsorted(shipped.value[0], token)]
            else:
                first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                n = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
            keep = n >= 2
            ids.append(sid[keep])
            keys.append((np.minimum(n[keep], DF_MAX).astype(np.int64) << BITS) | token[keep])
        sid, key = np.concatenate(ids), np.concatenate(keys)
        bucket = (sid % buckets).astype(np.int64)
        order = np.lexsort((sid, bucket))
        sid, key, bucket = sid[order], key[order], bucket[order]
        out = []
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            who, n = np.unique(sid[lo:hi], return_counts=True)
            out.append((b, who.tobytes(), n.astype(np.int32).tobytes(), key[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "ids", "counts", "keys"])

    return rows.groupBy("part").applyInPandas(count, "bucket long, ids binary, counts binary, keys binary")


def linkable(shared: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """sid, n, keys (ascending): the sets with enough shared shingles to link with any other."""

    def gather(shared: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shared):
            sid = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)) for i, n in zip(shared["ids"], shared["counts"], strict=True)])
            key = np.concatenate([np.frombuffer(k, np.int64) for k in shared["keys"]])
            order = np.lexsort((key, sid))
            sid, key = sid[order], key[order]
            size = dict(zip(sizes["sid"], sizes["n"], strict=True))
            who, first = np.unique(sid, return_index=True)
            for s, lo, hi in zip(who.tolist(), first, np.append(first[1:], len(sid)), strict=True):
                if 100 * (hi - lo) >= PERCENT * size[s]:
                    out.append((s, size[s], key[lo:hi]))
        return pd.DataFrame(out, columns=["sid", "n", "keys"])

    s = sizes.withColumn("bucket", F.pmod("sid", F.lit(buckets)))
    return shared.groupBy("bucket").cogroup(s.groupBy("bucket")).applyInPandas(gather, "sid long, n long, keys array<long>")


def least_overlap(a: Column, b: Column) -> Column:
    """The smallest overlap of linked sets with these sizes: 100 o >= PERCENT (a + b - o)."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT) - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment of the order and summed."""
    cuts = [0, *[(df << BITS) + int(x * (1 << BITS)) for df, x in PIVOTS], 1 << 62]
    segment = lambda lo, hi: F.filter("keys", lambda k: (k >= lo) & (k < hi))
    parts = sets.select("sid", F.posexplode(F.array(*[segment(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)])).alias("f", "seg")).where(F.size("seg") > 0)
    left = parts.select(F.col("sid").alias("a"), "f", F.col("seg").alias("x"))
    right = parts.select(F.col("sid").alias("b"), "f", F.col("seg").alias("y"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "f"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"))
    total = partial.groupBy("a", "b").agg(F.sum("o").alias("o"))
    n = pairs.select("a", "b", "n_a", "n_b")
    return n.join(total, ["a", "b"]).where(100 * F.col("o") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def possible(x: str, y: str) -> Column:
    """Length and position filter for two prefix rows (struct n, pos) that share a shingle at their positions.

    pos counts the set's shingles before it in the order, which the other may share only partly.
    """
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(a - F.col(f"{x}.pos") + F.col(f"{x}.before"), b - F.col(f"{y}.pos") + F.col(f"{y}.before"))
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (room >= least_overlap(a, b))


#: Sets of a component that are compared at once, and shingles of them that a dense matrix holds.
SETS, WIDE = 512, 8_192


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of key arrays: products of 0/1 matrices over stretches of their common keys."""
    both, own = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(both, own)
    rows = [(np.repeat(np.arange(len(x)), [len(k) for k in x]), np.concatenate(x)) for x in (a, b)]
    out = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, len(common), WIDE):
        part = common[lo : lo + WIDE]
        dense = []
        for (who, key), x in zip(rows, (a, b), strict=True):
            m = np.zeros((len(x), len(part)), np.float32)
            at = np.minimum(np.searchsorted(part, key), len(part) - 1)
            hit = part[at] == key
            m[who[hit], at[hit]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def link_counts(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """sid, n_links: for every set of a component (classes: sid, label, copies), the documents of other sets that it links with.

    A component's sets are dealt into blocks of about SETS; every two blocks of a component meet in one group of rows.
    Small components share groups.
    """
    sizes = classes.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select(F.col("label").alias("s_label"), F.ceil(F.col("k") / SETS).cast("int").alias("nb"), "k")
    d = linked.join(classes.select(F.col("sid").alias("c_sid"), "label", "copies"), F.col("sid") == F.col("c_sid")).join(sizes, F.col("label") == F.col("s_label"))
    b = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    d = d.select("sid", "n", "keys", "label", "copies", "nb", b.alias("b"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    # small components: about SETS of them to a group
    small = F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.lit(classes.sparkSession.sparkContext.defaultParallelism * 8))).cast("long")
    d = d.withColumn("g", F.when(F.col("nb") == 1, small).otherwise(F.col("label"))).withColumn("lo", F.when(F.col("nb") == 1, -1).otherwise(F.least("b", "o"))).withColumn("hi", F.greatest("b", "o"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("label", sort=False):
            lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
            x, y = (part, part) if lo < 0 or lo == hi else (part[part["b"] == lo], part[part["b"] == hi])
            if not len(x) or not len(y):
                continue
            o = overlaps(list(x["keys"]), list(y["keys"]))
            union = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :] - o
            links = (100 * o >= PERCENT * union) & (x["sid"].to_numpy()[:, None] != y["sid"].to_numpy()[None, :])
            out.append((x["sid"].to_numpy(), links @ y["copies"].to_numpy()))
            if x is not y:
                out.append((y["sid"].to_numpy(), links.T @ x["copies"].to_numpy()))
        who, n = zip(*out, strict=True) if out else ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        return pd.DataFrame({"sid": np.concatenate(who), "n_links": np.concatenate(n)})

    return d.groupBy("g", "lo", "hi").applyInPandas(count, "sid long, n_links long").groupBy("sid").agg(F.sum("n_links").alias("n_links"))


def _classes(docs: DataFrame, key: str, text: str, links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (key, h, n, sid), and per set: sid, component (its smallest key), copies, n_links, keeper (the set that holds the
    component's first row) and best (its own first row: null keys last, then by the text's hash)."""
    sets, hot, hot_n = sets_of(docs, key, text)
    reps = written(sets.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min("key").alias("rep"), F.count("*").alias("copies"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("best")), "jaccard-reps")
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(FRAGMENTS, math.ceil(total / FRAGMENT))
    shared = shared_rows(fragment_rows(docs, text, hot, fragments), hot, hot_n, fragments)
    linked = written(linkable(shared, reps.select("sid", "n"), fragments), "jaccard-linkable")

    # prefix rows; the shingles that no other set has come before the shared ones in the order
    m = F.size("keys")
    prefix = linked.select("sid", "n", m.alias("m"), F.posexplode(F.slice("keys", F.lit(1), (m - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))).alias("i", "tok"))
    prefix = written(prefix.select("tok", F.struct("sid", "n", (F.col("n") - F.col("m") + F.col("i")).alias("pos"), F.lit(0).alias("before")).alias("r")), "jaccard-prefix")
    lists = prefix.groupBy("tok").agg(F.count("*").alias("k"), F.min(F.struct(F.col("r.pos"), F.col("r.sid"), F.col("r.n"))).alias("lead")).where("k > 1")

    star = prefix.join(lists, "tok").where(F.col("r.sid") != F.col("lead.sid")).where(100 * F.least("r.n", "lead.n") >= PERCENT * F.greatest("r.n", "lead.n"))
    star = star.select(F.col("lead.sid").alias("a"), F.col("r.sid").alias("b"), F.col("lead.n").alias("n_a"), F.col("r.n").alias("n_b"))
    star = written(_ordered(star).distinct(), "jaccard-star")
    edges = written(verified(star, linked), "jaccard-links")
    parts = components(edges)

    # what is still apart: shingles whose sets are in several components
    p = prefix.join(parts, F.col("r.sid") == F.col("v"), "left").select("tok", "r", F.coalesce("label", "r.sid").alias("c"))
    p = written(p, "jaccard-apart")
    open_ = p.groupBy("tok").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("tok")
    p = p.join(open_, "tok", "left_semi")
    x, y = p.select("tok", F.col("r").alias("x"), F.col("c").alias("cx")), p.select("tok", F.col("r").alias("y"), F.col("c").alias("cy"))
    rest = x.join(y, (x["tok"] == y["tok"]) & (F.col("cx") != F.col("cy")) & (F.col("x.sid") < F.col("y.sid")) & possible("x", "y"))
    rest = rest.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    rest = written(rest.join(star.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-rest")
    edges = written(edges.unionByName(verified(rest, linked)), "jaccard-all-links")

    labels = components(edges)
    classes = reps.join(labels, F.col("sid") == F.col("v"), "left").select("sid", "rep", "copies", "best", F.coalesce("label", "sid").alias("label"))
    classes = written(classes, "jaccard-components")
    heads = classes.groupBy(F.col("label").alias("h_label")).agg(F.min("rep").alias("component"), F.min_by("sid", F.struct("best", "sid")).alias("keeper"))
    result = classes.join(heads, F.col("label") == F.col("h_label"))
    n_links = F.col("copies") - 1
    if links:
        result = result.join(link_counts(linked, classes.select("sid", "label", "copies")).withColumnRenamed("sid", "l_sid"), F.col("sid") == F.col("l_sid"), "left")
        n_links += F.coalesce("n_links", F.lit(0))
    result = written(result.select("sid", "component", "copies", n_links.alias("n_links"), "keeper", "best"), "jaccard-classes")
    forget(star, rest, prefix, edges, linked, classes)
    return sets, result.withColumnRenamed("sid", "r_sid")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", links: bool = True) -> DataFrame:
    """key, n_shingles, component_id, copies, n_links for every row of docs.

    links=False leaves n_links out, and with it the comparison of all sets inside a component, which grows with the square of
    its distinct sets; components don't need it.

    Two rows link when 100 * intersection >= 75 * union of their five-word shingle sets (ASCII lower
    case; fewer words: the whole sequence). component_id is the smallest key that a row reaches. copies:
    rows with an equal set; n_links: the other rows that the row links with. Null, empty and blank texts have
    no shingle, link with nothing and are components of their own. Rows with a null key get the component's
    smallest key (null if there is none). Rows that repeat a key are separate documents. Other columns are ignored;
    an empty table gives no rows.
    """
    sets, result = _classes(docs, key, text, links)
    out = sets.join(result, F.col("sid") == F.col("r_sid"), "left")
    counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), *counts)


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n_a", "n_b"), ("n_b", "n_a"))])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest key (null keys last, then by the text's hash).

    Decided row by row: rows that share a key but not the text are separate documents, and so are rows with a null key.
    Of rows with equal key and text one stays (the first by the hash of its columns). Null, empty and blank texts
    all stay. Columns of any name pass through unchanged; an empty table gives no rows.
    """
    sets, result = _classes(docs, key, text, links=False)
    first = (F.col("sid") == F.col("keeper")) & F.col("key").eqNullSafe(F.col("best.key")) & (F.col("h") == F.col("best.h"))
    rows = sets.where("sid is not null").join(result, F.col("sid") == F.col("r_sid")).groupBy("key", "h").agg(F.bool_or(first).alias("stays"), F.count("*").alias("n"))
    rows = written(rows.where("not stays or n > 1"), "jaccard-decisions")
    (h,) = fresh(docs, "h")
    d = docs.withColumn(h, F.xxhash64(text))
    names = fresh(d, "d_key", "d_h")
    same = F.col(key).cast("long").eqNullSafe(F.col(names[0])) & (F.col(h) == F.col(names[1]))
    at = lambda x: x.select(F.col("key").alias(names[0]), F.col("h").alias(names[1]))
    alone = d.join(at(rows), same, "left_anti")
    repeated = d.join(at(rows.where("stays")), same, "left_semi")
    (n,) = fresh(d, "n")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    repeated = repeated.withColumn(n, F.row_number().over(Window.partitionBy(key, h).orderBy(F.xxhash64(*plain)))).where(F.col(n) == 1).drop(n)
    return alone.unionByName(repeated).drop(h)
