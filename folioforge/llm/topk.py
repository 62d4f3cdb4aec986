"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A term is a vector dimension. Candidates are packed into blocks, each an inverted index: one posting
list (positions, weights) per dimension. For every non-zero term of a query row the weighted
postings are added into a dense score array, one slot per candidate of the block; partition selection
keeps the block's best k, and a window merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block; a block pair's score array has at most QUERIES * BLOCK integers.
BLOCK = 1024
QUERIES = 512


def _usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def distinct_rows(df: DataFrame, key: str, vector: str, groups: int) -> DataFrame:
    """(id, v, copies, mark, g): the rows that take part, their vectors' hash, and the group that it deals them to.

    Equal rows are counted, so that a vector with very many copies is one row.
    """
    d = df.where(F.col(key).isNotNull() & _usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    d = d.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("mark", F.xxhash64("v"))
    return d.withColumn("g", F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).cast("int"))


SCHEMA = "g int, ids binary, marks binary, copies binary, lengths binary, flat binary"


def _packed(size: int):
    """Blocks of `size` rows of one group. Which rows a block has may differ when a task is repeated; a group's rows don't."""

    def block(part: pd.DataFrame) -> pd.DataFrame:
        out = {"g": [part["g"].iloc[0]], **{f"{c}s" if c != "copies" else c: [part[c].to_numpy(np.int64).tobytes()] for c in ("id", "mark", "copies")}}
        flat = np.concatenate([*part["v"].to_numpy(), np.empty(0)]).astype(np.float64)
        return pd.DataFrame({**out, "lengths": [part["v"].map(len).to_numpy(np.int32).tobytes()], "flat": [flat.tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[int, tuple[list, int]] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                parts, n = rest.get(g, ([], 0))
                parts, n = [*parts, part], n + len(part)
                while n >= size:
                    whole = pd.concat(parts)
                    yield block(whole.iloc[:size])
                    parts, n = [whole.iloc[size:]], n - size
                rest[g] = parts, n
        for parts, n in rest.values():
            if n:
                yield block(pd.concat(parts))

    return pack


class Block:
    """Rows by ascending id, absent terms as zero. x: components as floor(scale * component), exact whatever their size."""

    def __init__(self, ids: bytes, marks: bytes, copies: bytes, lengths: bytes, flat: bytes, scale: int, most: int | None = None) -> None:
        ids, marks, copies, lengths = np.frombuffer(ids, np.int64), np.frombuffer(marks, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(lengths, np.int32)
        raw = np.frombuffer(flat, np.float64)
        large = bool(len(raw)) and float(np.abs(raw).max()) >= 2.0**52 / scale
        # such a double is a whole number already
        flat = np.array([int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in raw.tolist()], object) if large else np.floor(raw * scale).astype(np.int64)
        shape = len(ids), max(1, int(lengths.max(initial=0)))
        inside = np.arange(shape[1]) < lengths[:, None]
        x, raws = np.zeros(shape, flat.dtype), np.zeros(shape)
        x[inside], raws[inside] = flat, raw
        order = np.argsort(ids, kind="stable")
        if most is not None:  # a query's result has at most k copies of a row, besides its own
            order = np.repeat(order, np.minimum(copies[order], most))
        self.ids, self.marks, self.copies, self.lengths, self.raw, self.x = ids[order], marks[order], copies[order], lengths[order], raws[order], x[order]

    def largest(self) -> int:
        return max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0)))) if self.x.size else 0


def block_top_k(queries: Block, candidates: Block, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query's position, candidate's id, score) columns of the k best candidates of one block for each query, ties to the smaller id.

    Scores are whole numbers in the narrowest type that holds every possible sum: 32 or 64 bits, or unbounded.
    """
    bound = queries.largest() * candidates.largest() * min(queries.x.shape[1], candidates.x.shape[1])
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    q, c = queries.x.astype(kind), candidates.x.astype(kind)
    postings = [(at, c[at, t]) for t in range(min(q.shape[1], c.shape[1])) for at in [np.flatnonzero(c[:, t])]]
    for lo in range(0, len(q), QUERIES):
        ids, rows = queries.ids[lo : lo + QUERIES], q[lo : lo + QUERIES]
        scores, product = np.zeros((len(ids), len(c)), kind), np.empty((len(ids), len(c)), kind)
        for t, (at, weight) in enumerate(postings):
            who = np.flatnonzero(rows[:, t])
            if len(at) == len(c) and len(who) == len(ids):
                np.multiply(rows[:, t, None], weight, out=product)
                scores += product
            elif len(at):
                scores[np.ix_(who, at)] += rows[who, t, None] * weight
        first, last = np.searchsorted(candidates.ids, ids), np.searchsorted(candidates.ids, ids, "right")
        for i in range(len(ids)):
            free = np.ones(len(c), bool)
            n = queries.lengths[lo + i]
            for j in first[i] + np.flatnonzero(candidates.marks[first[i] : last[i]] == queries.marks[lo + i]):  # one of the rows that equal the query's
                if candidates.lengths[j] == n and np.array_equal(candidates.raw[j, :n], queries.raw[lo + i, :n]):
                    free[j] = False
                    break
            at = np.flatnonzero(free)
            n = min(k, len(at))
            if not n:
                continue
            pool = scores[i, at]
            edge = np.partition(pool, len(pool) - n)[len(pool) - n]
            sure = np.flatnonzero(pool > edge)
            tied = np.flatnonzero(pool == edge)[: n - len(sure)]  # ids ascend: the smallest of the ties
            for j in np.concatenate((sure, tied)):
                yield lo + i, int(candidates.ids[at[j]]), int(pool[j])


def top_k(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int = 5, scale: int = 256, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * component) among the candidates.

    Every row but the query's own is a candidate; its own is one candidate with its id and vector. So other rows that
    repeat the query's id are candidates, also equal ones, and queries that repeat an id have results of their own.
    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of
    unequal length are multiplied over their common dimensions. Sums are exact; a score beyond 64 bits is
    returned as the nearest long. No queries or no candidates: no rows. Other columns are ignored.

    Both sides travel as packed blocks. Every query block meets every candidate block through an
    equi-join on a candidate group, so that no side is collected or broadcast.
    """
    parallelism = queries.sparkSession.sparkContext.defaultParallelism
    groups = groups or parallelism * 4
    names = ("ids", "marks", "copies", "lengths", "flat")
    # rows meet the rest of their group before they are packed, so that blocks are full; the count of partitions is given, so that
    # adaptive execution keeps the groups apart
    c = distinct_rows(candidates, key, vector, groups).repartition(groups, "g").mapInPandas(_packed(BLOCK), SCHEMA).repartition(groups, "g")
    # a query block is sent to each candidate group once
    q = distinct_rows(queries, key, vector, parallelism).repartition(parallelism, "g").mapInPandas(_packed(QUERIES), SCHEMA)
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *[F.col(x).alias(f"q_{x}") for x in names]).repartition(groups, "g")
    pairs = c.join(q, "g")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                left = Block(*[getattr(row, f"q_{x}") for x in names], scale)
                right = Block(*[getattr(row, x) for x in names], scale, k + 1)
                found = list(block_top_k(left, right, k))
                at = np.array([f[0] for f in found], np.int64)
                yield pd.DataFrame({
                    "query_id": left.ids[at], "mark": left.marks[at], "copies": left.copies[at], "vec_id": np.array([f[1] for f in found], np.int64),
                    "score": np.array([min(max(f[2], -(2**63)), 2**63 - 1) for f in found], np.int64),
                })

    found = pairs.mapInPandas(search, "query_id long, mark long, copies long, vec_id long, score long")
    w = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
