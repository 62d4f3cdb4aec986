"""Vector code compression: product quantisation in whole numbers, with exact nearest entries from ball trees.

A vector is cut into PARTS equal parts; each part becomes the index of the nearest entry of its position's codebook.
The entries of a position stand in a vantage-point tree: a node's vantage entry splits the others by distance, and
each side has the smallest and largest distance to it, rounded outwards. A search goes through the tree with all
vectors of a batch at once and leaves a side out for those whose bound, rounded down, is above their best distance,
rounded up; equal bounds are visited, so that ties reach the lower index. Distances themselves are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a tree's leaf, and vectors that go through a tree together.
LEAF, TOGETHER = 32, 8_192
#: Vectors that meet a leaf's entries at once.
CHUNK = 512
#: Components below this are squared and summed in 64 bits, up to 128 in a part; others as unbounded integers.
SMALL = 2.0**27
#: Relative margin of a distance as a double: conversion, root and rounding each err by less than 2**-52.
MARGIN = 2.0**-48
#: Sums travel as two decimals, v = high * 10**30 + low.
LIMB = 10**30
TOP = 2**63 - 1
SALTS = 32


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a - b
    return (d * d).sum(axis=-1)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


@dataclass
class Node:
    """A leaf (entries, ascending) or a vantage entry with its near and far side and their distances' bounds."""

    entries: np.ndarray | None = None
    vantage: int = -1
    sides: tuple[tuple[Node, float, float], ...] = ()


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The vantage-point tree of a codebook's entries. Sides are halves by rank, so equal entries don't unbalance it."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries=np.sort(entries))
    # the entry farthest from the first one lies at the rim and tells the others apart well
    vantage = int(entries[np.argmax(squared(book[entries], book[entries[0]]))])
    rest = entries[entries != vantage]
    d2 = squared(book[rest], book[vantage])
    order = np.argsort(d2, kind="stable")
    halves = [h for h in np.array_split(order, 2) if len(h)]
    return Node(vantage=vantage, sides=tuple((tree(book, rest[h]), float(_below(d2[h]).min()), float(_above(d2[h]).max())) for h in halves))


def nearest(points: np.ndarray, book: np.ndarray, top: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point; ties to the lower index."""
    if not len(book):
        raise ValueError("a codebook needs an entry")
    index, best, reach = np.zeros(len(points), np.int64), squared(points, book[0]), np.empty(len(points))
    reach[:] = _above(best)

    def take(at: np.ndarray, entry: np.ndarray | int, d2: np.ndarray) -> None:
        better = (d2 < best[at]) | ((d2 == best[at]) & (entry < index[at]))
        who = at[better]
        index[who], best[who] = np.broadcast_to(entry, at.shape)[better], d2[better]
        reach[who] = _above(best[who])

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.entries is not None:
            for lo in range(0, len(at), CHUNK):
                part = at[lo : lo + CHUNK]
                every = squared(points[part][:, None], book[node.entries][None])
                least = every.argmin(axis=1)  # entries ascend: the first of equal ones is the lowest
                take(part, node.entries[least], every[np.arange(len(part)), least])
            return
        d2 = squared(points[at], book[node.vantage])
        take(at, node.vantage, d2)
        low, high = _below(d2), _above(d2)
        bounds = [np.maximum(low - far, near - high) for _, near, far in node.sides]
        # each point goes to its nearer side first: its best distance is small before the other side is weighed
        first = bounds[0] <= bounds[-1] if len(bounds) > 1 else np.ones(len(at), bool)
        for side, turn in ((0, first), (1, ~first), (1, first), (0, ~first)):
            if side < len(bounds):
                visit(node.sides[side][0], at[turn & (bounds[side] * (1 - MARGIN) <= reach[at])])

    for lo in range(0, len(points), TOGETHER):
        visit(top, np.arange(lo, min(lo + TOGETHER, len(points))))
    return index, best


class Books:
    """A codebook for each part position, with its tree."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books
        self.trees = [tree(b) for b in books]

    def assign(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(index, squared distance) of every vector's part, by position."""
        out = []
        for book, top, part in zip(self.books, self.trees, np.split(vectors, len(self.books), axis=1), strict=True):
            whole = part.dtype == object or book.dtype == object
            out.append(nearest(part.astype(object) if whole else part, book.astype(object) if whole else book, top))
        return out

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def _integers(flat: np.ndarray, dims: int) -> np.ndarray:
    """Whole doubles as rows of 64-bit integers, or of unbounded ones where squares could overflow."""
    rows = flat.reshape(-1, dims) if dims else flat.reshape(len(flat), 0)
    if rows.size and np.abs(rows).max() >= SMALL or dims > 128 * PARTS:
        return np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)
    return rows.astype(np.int64)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    n = batch.num_rows
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return _integers(flat, dims) if dims else np.zeros((n, 0), np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TOGETHER: a search pays for each node it visits."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= TOGETHER:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def prepared(df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(id, label, v): floor(scale * component) of the vectors that take part, written to the shared folder.

    v holds whole doubles: a scaled double's floor is always one. Vectors take part if neither they nor a component
    is null and all scaled components are finite. They are filled up with zeros to a multiple of the parts.
    """
    v = F.col(vector)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= 1e57))
    scaled = F.transform(v.cast("array<double>"), lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    fill = F.array_repeat(F.lit(0.0), F.pmod(-F.size(v), F.lit(parts)).cast("int"))
    return written(df.where(good).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.concat(scaled, fill).alias("v")), "vectors")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books | None:
    """Codebooks from (id, v): the first `entries` vectors by id (repeated ids by v, null ids last), then `rounds` rounds of means.

    A round is one job: tasks add up their parts by entry, and one row for each part, entry and task is summed; the
    driver holds parts * entries rows. A mean is floor(sum / count); an entry without parts stays. None without rows.
    Vectors must have one length.
    """
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        return None
    dims = len(start[0].v)
    start = _integers(np.array([r.v for r in start], np.float64).reshape(-1), dims) if dims else np.zeros((len(start), 0), np.int64)
    books = Books(np.split(start, parts, axis=1))
    schema = "part int, entry int, count long, high array<decimal(38,0)>, low array<decimal(38,0)>"
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(len(b), np.int64), np.zeros(b.shape, object)) for b in books.books]
            for batch in _gathered(batches):
                vectors = _vectors(batch, dims)
                for (count, total), part, (index, _) in zip(held, np.split(vectors, parts, axis=1), books.assign(vectors), strict=True):
                    order = np.argsort(index, kind="stable")
                    here, at = np.unique(index[order], return_index=True)
                    count[here] += np.diff(np.append(at, len(index)))
                    total[here] += np.add.reduceat(part[order], at, axis=0).astype(object)
            found = [(p, e, int(count[e]), [int(x) // LIMB for x in total[e]], [int(x) % LIMB for x in total[e]]) for p, (count, total) in enumerate(held) for e in np.flatnonzero(count).tolist()]
            kinds = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("high", pa.list_(pa.decimal128(38, 0))), ("low", pa.list_(pa.decimal128(38, 0)))])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k.type) for i, k in enumerate(kinds)], schema=kinds)

        tasks = rows.select("v").mapInArrow(sums, schema)
        at = dims // parts
        added = tasks.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("high", "low") for i in range(at)])
        after = [b.astype(object) for b in books.books]
        for r in added.collect():
            after[r["part"]][r["entry"]] = [(int(r[f"high{i}"]) * LIMB + int(r[f"low{i}"])) // r["count"] for i in range(at)]
        books = Books([_integers(b.astype(np.float64).reshape(-1), at).reshape(b.shape) if not b.size or max(map(abs, b.reshape(-1))) < SMALL else b for b in after])
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """id, label, code, error: the parts' entries as two hex digits each, and the squared distance to them (at most 2**63 - 1)."""
    dims, kind = sum(b.shape[1] for b in books.books), rows.schema["label"].dataType
    schema = f"id long, code string, error long, label {kind.simpleString()}"

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            found = books.assign(_vectors(batch, dims))
            code = ["".join(f"{i:02x}" for i in c) for c in zip(*[index.tolist() for index, _ in found], strict=True)]
            error = [min(sum(e), TOP) for e in zip(*[d2.tolist() for _, d2 in found], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(code, pa.string()), pa.array(error, pa.int64()), batch.column("label")], ["id", "code", "error", "label"])

    return rows.select("id", "label", "v").mapInArrow(codes, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256, label: every usable vector's code (see prepared, fit, encode).

    label_error sums the errors of equal labels, null ones together (at most 2**63 - 1). Rows with a null key keep a
    code; rows that repeat a key or a vector all stay. Vectors of another length than that of the smallest key's take
    no part. No usable vector: no rows. Other columns are ignored, whatever their names.
    """
    names = fresh(df.select(key, label), "code", "error", "label_error", "codebooks_sha256")
    rows = prepared(df, key, vector, label, scale, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    rows = rows.where(F.size("v") == (first[0].n if first else 0))
    books = fit(rows, parts, entries, rounds)
    if books is None:
        return df.select(F.col(key).cast("long").alias(key), *[F.lit(None).cast("string" if "error" not in n else "long").alias(n) for n in names], F.col(label)).where(F.lit(False))
    coded = written(encode(rows, books), "codes")
    # a label may hold a third of the rows: its rows are dealt out by a salt, its one sum is copied for each
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP)).cast("long").alias("label_error"))
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "of")
    c = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    out = c.join(total, F.col("label").eqNullSafe(F.col("of")) & (c["salt"] == total["salt"]))
    return out.select(F.col("id").alias(key), F.col("code").alias(names[0]), F.col("error").alias(names[1]), F.col("label_error").alias(names[2]), F.lit(books.digest()).alias(names[3]), F.col("label").alias(label))
