"""Benchmark decontamination by latent semantic retrieval.

Terms are hashed to DIM buckets, a batch of texts at once; document frequencies cover the whole corpus. The benchmark is cut into blocks of
at most BLOCK passages. For each, a randomised SVD (subspace iteration over Spark tasks) of its TF-IDF passages,
with passages of the corpus at a small share of the weight, gives a latent space of as few directions as keep
RETAIN of the benchmark passages' squared length; passages that keep less than FLOOR of theirs (no other resembles
them) add their residuals as directions. Where that makes more directions than passages, nothing can be left out, and the passages' own
span is the space. An item of more passages than a block has is spread over blocks, and found through any of them. Every passage of every document is projected and compared by cosine
with every benchmark passage; candidates are checked by longest common subsequence with the item's words, and less
certain ones also by the item's answer, its last words.

Bounds: a block has at most BLOCK passages, so at most BLOCK * 2 * STEP = 16,384 terms and BLOCK directions; a basis is at most
34 MB, and the driver holds a few matrices of that shape; a task holds the bases of GROUP blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, release, written

DIM = 1 << 18
#: Directions at most, more of them in the sketch, power steps; the share of the squared length that the space keeps.
RANK, EXTRA, POWER, RETAIN, FLOOR = 512, 10, 1, 0.95, 0.75
#: Benchmark passages of a block, blocks searched at once, passages of the corpus in a fit and their share of its weight.
BLOCK, GROUP, CORPUS, SHARE = 512, 8, 2_000, 0.2
#: A passage is two segments of STEP words; passages overlap by one segment.
STEP = 16
#: A candidate keeps at least ENERGY of its length in the latent space and has at least COSINE there.
ENERGY, COSINE = 0.15, 0.5
LCS, LCS_ANSWER, ANSWER_WORDS, ANSWER = 0.7, 0.55, 5, 0.8
TERM, BREAK = re.compile(r"\w+"), re.compile(r"\W")
ROWS = 1024
#: Characters of a batch of documents (a longer document is a batch of its own), characters hashed and passages projected at once.
CHARS, PIECE, HOPE = 600_000, 1 << 20, 512


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


@cache
def word_characters() -> np.ndarray:
    """Of every code point, whether it belongs to words."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(0x110000)])


@cache
def powers() -> np.ndarray:
    return np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def hashed(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of each word (a TERM) of a text in lower case: a polynomial of its code points, mixed and cut to DIM."""
    starts, buckets, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(low):
        end = BREAK.search(low, at + PIECE) if at + PIECE < len(low) else None  # not inside a word
        end = end.start() if end else len(low)
        codes = np.frombuffer(low[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.flatnonzero(word_characters()[codes])
        if len(inside):
            first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # of a word, among the characters of words
            place = np.arange(len(inside)) - np.repeat(first, np.diff(first, append=len(inside)))
            h = np.add.reduceat((codes[inside] + np.uint64(1)) * powers()[place & 255], first)
            buckets.append((((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int64))
            starts.append(inside[first] + at)
        at = end
    return np.concatenate(starts), np.concatenate(buckets)


def located(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each of some texts in lower case, and the buckets of all their words."""
    starts, ids = hashed("\n".join(low))
    ends = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    return np.diff(np.searchsorted(starts, ends), prepend=0), ids


def bucket(term: str) -> int:
    return int(hashed(term)[1][0])


def batches_of(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lower case, about CHARS characters at a time."""
    out, size = [], 0
    for t in texts:
        out.append((t or "").lower())
        size += len(out[-1])
        if size >= CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


class Words(dict):
    """The words of each text of a batch, split where they are asked for."""

    def __init__(self, low: list[str]) -> None:
        self.low = low

    def __missing__(self, d: int) -> list[str]:
        self[d] = out = TERM.findall(self.low[d])
        return out


class Sequence:
    """Words to find again as a subsequence: the positions of each as bits of an integer."""

    def __init__(self, words: list[str]) -> None:
        self.length, self.masks = len(words), {}
        for i, x in enumerate(words):
            self.masks[x] = self.masks.get(x, 0) | 1 << i

    def shared(self, b: list[str]) -> list[int]:
        """Positions of b's words, without those that aren't here; no common subsequence is longer than this list."""
        return list(filter(None, map(self.masks.get, b)))

    def longest(self, shared: list[int]) -> int:
        """Length of the longest common subsequence, bit-parallel: one big-integer step for each shared word."""
        v = full = (1 << self.length) - 1
        for m in shared:
            u = v & m
            v = ((v + u) | (v - u)) & full
        return self.length - v.bit_count()


def lcs_length(a: list[str], b: list[str]) -> int:
    s = Sequence(a)
    return s.longest(s.shared(b))


def passages(ids: np.ndarray) -> list[np.ndarray]:
    """Term rows of a text as passages: segments i and i + 1, or the only one."""
    n = max(1, -(-len(ids) // STEP) - 1)
    return [ids[i * STEP : (i + 2) * STEP] for i in range(n)]


@dataclass
class Index:
    rows: np.ndarray  # bucket to row of the basis; the last row, all zero, stands for all other terms
    idf: np.ndarray  # of every bucket: words outside the benchmark weigh by their own frequency in the norm
    basis: np.ndarray  # rows x RANK, idf included
    items: list[tuple[int, list[str]]]
    latent: np.ndarray  # of each benchmark passage, of length 1
    owner: np.ndarray  # item of each benchmark passage


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with each bucket, over the whole corpus, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for low in batches_of(batch.column(0).to_pylist()):
                lengths, ids = located(low)
                n += np.bincount(np.unique(np.repeat(np.arange(len(low)), lengths) * DIM + ids) % DIM, minlength=DIM)
                total += len(low)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], ["bucket", "n"])

    found = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(DIM, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def inverse_frequency(df: np.ndarray, total: int) -> np.ndarray:
    """Depends on the shares of documents only, so that a passage weighs alike in a corpus of any size."""
    return np.log((total + 1) / (df + 0.5))


def gram_times(matrix: DataFrame, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A X for the TF-IDF matrix whose rows are term rows (ids) and a weight; partial products summed by row block.

    X is shipped in single precision, as the partial products come back, so that the driver holds half of it.
    """
    shipped = matrix.sparkSession.sparkContext.broadcast((right.astype(np.float32), idf))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, w = shipped.value
        out, any_rows = np.zeros(x.shape), False
        for pdf in batches:
            for ids, weight in zip(pdf["ids"], pdf["weight"], strict=True):
                at = np.asarray(ids)
                np.add.at(out, at, w[at][:, None] * (weight * (w[at] @ x[at]))[None, :])
                any_rows = True
        if any_rows:
            blocks = range(0, len(out), ROWS)
            yield pd.DataFrame({"block": [i // ROWS for i in blocks], "part": [out[i : i + ROWS].astype(np.float32).tobytes() for i in blocks]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32) for p in pdf["part"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.tobytes()]})

    sums = matrix.mapInPandas(partial, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").toArrow()
    shipped.destroy()
    out = np.zeros(right.shape)
    for block, part in zip(sums["block"].to_pylist(), sums["part"], strict=True):
        rows = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, right.shape[1])
        out[block * ROWS : block * ROWS + len(rows)] = rows
    return out


def randomised_svd(matrix: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 23) -> np.ndarray:
    """The leading right singular vectors (terms x rank): a random sketch, power steps, then a small eigenproblem."""
    width = min(min(rank, matrix.count()) + EXTRA, len(idf))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), width)))[0]
    for _ in range(POWER + 1):
        q = gram_times(matrix, q, idf)  # the q before is no longer held
        q = np.linalg.qr(q)[0]
    values, vectors = np.linalg.eigh(q.T @ gram_times(matrix, q, idf))
    order = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, order[values[order] > 1e-9 * values.max()]]


def drawn_passages(docs: DataFrame, text: str, total: int, most: int) -> DataFrame:
    """buckets of about `most` passages of the corpus, one of each document drawn by its text's hash; written."""
    h = F.xxhash64(F.lit("passage"), F.col(text))
    part = F.shiftrightunsigned(h, 12).cast("double") / float(2**52)
    d = docs.where(part < min(1.0, most / max(1, total))).select(F.col(text).alias("t"), h.alias("h"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ((hashed(t.lower())[1], h) for t, h in zip(pdf["t"], pdf["h"], strict=True) if t)
            rows = [p[h % len(p)].tolist() for ids, h in found if len(ids) for p in [passages(ids)]]
            yield pd.DataFrame({"buckets": rows})

    return written(d.mapInPandas(cut, "buckets array<int>"), "lsa-corpus")


def fit(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> list[Index]:
    """An index for each block of the benchmark; none if it is empty.

    Items without a word, an id or a text take no part; equal items count once. Null and empty documents count as
    documents without terms. The corpus passages in the fit are a sample of about CORPUS; frequencies cover everything.
    """
    named = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    # passages of an item from its count of word runs; blocks by running totals of those, in order of the id
    size = F.greatest(F.ceil(F.regexp_count("t", F.lit(r"\w+")) / STEP) - 1, F.lit(1))
    n = named.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if not n:
        return []
    parts = max(1, -(-n // (BLOCK * 3 // 4)))  # by hash, so blocks differ in size: three quarters full on average
    df, total = document_frequency(docs, text)
    idf = inverse_frequency(df, total)
    corpus = drawn_passages(docs, text, total, CORPUS)
    out = []
    for p in range(parts):
        rows = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()
        for mine in blocks_of(sorted((i, ws) for i, t in rows if (ws := terms(t)))):
            out.append(fit_block(corpus, mine, idf))
    forget(corpus)
    release()
    return out


def blocks_of(items: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str], int, int]]]:
    """Blocks of (item, words, first passage, one after the last) of at most BLOCK passages; an item may go on in the next."""
    block, room = [], BLOCK
    for item, ws in items:
        at, n = 0, len(passages(np.arange(len(ws))))
        while at < n:
            take = min(room, n - at)
            block.append((item, ws, at, at + take))
            at, room = at + take, room - take
            if not room:
                yield block
                block, room = [], BLOCK
    if block:
        yield block


def fit_block(corpus: DataFrame, parts: list[tuple[int, list[str], int, int]], idf: np.ndarray) -> Index:
    """The index of a block's passages. An item's words are all there, as a candidate is checked against the whole item."""
    items = [(item, ws) for item, ws, _, _ in parts]
    mine = [passages(hashed(" ".join(ws))[1])[first:end] for _, ws, first, end in parts]
    used = np.unique(np.concatenate([p for x in mine for p in x]))
    rows = np.full(DIM, len(used), np.int32)
    rows[used] = np.arange(len(used))
    weights = np.append(idf[used], 0.0)
    own = [rows[p] for x in mine for p in x]
    owner = np.repeat(np.arange(len(items)), [len(x) for x in mine])

    def square(p: np.ndarray) -> float:
        at, n = np.unique(p, return_counts=True)
        return float(((n * weights[at]) ** 2).sum())

    mass = sum(map(square, own))
    sample = [rows[r.buckets] for r in corpus.collect()]
    other = sum(map(square, sample))
    each = SHARE / (1 - SHARE) * mass / other if other else 0.0
    spark = corpus.sparkSession
    matrix = written(spark.createDataFrame([(p.tolist(), w) for part, w in ((own, 1.0), (sample, each)) if w for p in part], "ids array<int>, weight double"), "lsa-passages")
    v = randomised_svd(matrix, weights)
    forget(matrix)
    full = np.stack([(v[p] * weights[p][:, None]).sum(axis=0) for p in own])
    kept = np.cumsum((full**2).sum(axis=0)) / max(mass, 1e-12)
    rank = min(v.shape[1], int(np.searchsorted(kept, RETAIN)) + 1)
    v = v[:, :rank]
    outside = np.flatnonzero((full[:, :rank] ** 2).sum(axis=1) < FLOOR * np.array(list(map(square, own))))
    if len(outside):
        whole = rank + len(outside) > len(own)  # as many directions as passages: their own span loses nothing
        chosen = range(len(own)) if whole else outside
        rest = np.zeros((len(weights), len(chosen)))
        for j, p in enumerate(chosen):
            np.add.at(rest[:, j], own[p], weights[own[p]])
        v = np.linalg.qr(rest if whole else np.concatenate((v, rest), axis=1))[0]
    basis = np.ascontiguousarray(v * weights[:, None], np.float32)
    latent = np.stack([basis[p].sum(axis=0) for p in own])
    return Index(rows, idf, basis, items, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12), owner)


class Searcher:
    def __init__(self, index: Index) -> None:
        self.index = index
        self.whole = [Sequence(words) for _, words in index.items]
        self.answers = [Sequence(words[-ANSWER_WORDS:]) for _, words in index.items]
        self.square = (index.idf**2).astype(np.float32)
        self.other = len(index.basis) - 1

    def candidates(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word of the passage, item, cosine) of the pairs that reach ENERGY and COSINE."""
        return self.search(*located([" ".join(d) for d in docs]))

    def search(self, lengths: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        x = self.index
        if not len(ids):
            return
        segments = -(-lengths // STEP)
        first_word = np.cumsum(lengths) - lengths
        first_segment = np.cumsum(segments) - segments
        owner = np.repeat(np.arange(len(lengths)), segments)
        starts = first_word[owner] + (np.arange(len(owner)) - first_segment[owner]) * STEP
        weight, row = self.square[ids], x.rows[ids]
        square = np.add.reduceat(weight, starts)
        is_known = row < self.other
        once = np.add.reduceat(weight * is_known, starts)  # of known words, as if none came again
        known = np.flatnonzero(is_known)
        count = np.add.reduceat(is_known.astype(np.int64), starts)
        offset = np.cumsum(count) - count
        row, weight = row[known], weight[known]
        follows = np.append(False, owner[1:] == owner[:-1])  # continues the text of the segment before
        pair = np.append(follows[1:], False)  # has a next segment
        square[:-1] += square[1:] * pair[:-1]
        both = count.copy()
        both[:-1] += count[1:] * pair[:-1]  # known words of a passage: they follow each other in row
        once[:-1] += once[1:] * pair[:-1]
        # projecting cannot add length, so passages whose known terms are shorter than ENERGY can't reach it
        hope = np.flatnonzero((pair | ~follows) & (both > 0))
        least = ENERGY**2 * (1 - 1e-4) * square[hope]
        sure = once[hope] >= least
        # repeats can lengthen a passage of n words by the factor n at most
        open_ = np.flatnonzero(~sure & (once[hope] * both[hope] >= least * (1 - 1e-4)))
        sure[open_] = self.known_square(row, weight, offset[hope[open_]], both[hope[open_]]) >= least[open_]
        hope = hope[sure]
        for lo in range(0, len(hope), HOPE):
            at = hope[lo : lo + HOPE]
            parts = np.unique(np.concatenate((at, at[pair[at]] + 1)))
            sums = self.project(row, offset[parts], count[parts])
            z = sums[np.searchsorted(parts, at)]
            z[pair[at]] += sums[np.searchsorted(parts, at[pair[at]] + 1)]
            norm, energy = np.sqrt(square[at]), np.linalg.norm(z, axis=1)
            live = np.flatnonzero((energy >= ENERGY * norm) & (energy > 0))
            cos = (z[live] @ x.latent.T) / energy[live, None]
            for i, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                s = at[live[i]]
                yield int(owner[s]), int(starts[s] - first_word[owner[s]]), int(x.owner[p]), float(cos[i, p])

    def known_square(self, row: np.ndarray, weight: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Squared TF-IDF length of the known terms of passages; a term that comes n times counts n * n times."""
        inside = np.arange(2 * STEP) < count[:, None]
        at = np.minimum(first[:, None] + np.arange(2 * STEP), len(row) - 1)
        found = np.where(inside, row[at], self.other)
        order = np.argsort(found, axis=1)
        found = np.take_along_axis(found, order, axis=1)
        square = np.take_along_axis(np.where(inside, weight[at], 0), order, axis=1)
        out = square.sum(axis=1)
        for lag in range(1, 2 * STEP):
            same = (found[:, lag:] == found[:, :-lag]) & (found[:, lag:] < self.other)
            if not same.any():
                break
            out += 2 * (square[:, lag:] * same).sum(axis=1)
        return out

    def project(self, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sums of the term vectors of segments; position by position, so that each step adds whole rows."""
        order = np.argsort(-count, kind="stable")
        first, reach = first[order], np.searchsorted(-count[order], -np.arange(count.max(initial=0)))
        z = np.zeros((len(first), self.index.basis.shape[1]), np.float32)
        vector = np.empty_like(z)
        for j, n in enumerate(reach):  # the first n segments have more than j known words
            z[:n] += np.take(self.index.basis, row[first[:n] + j], axis=0, out=vector[:n], mode="clip")
        out = np.empty_like(z)
        out[order] = z
        return out

    def check(self, i: int, region: list[str]) -> tuple[float, float]:
        """Shares of an item's words and of its answer that the region holds in order; zeros if too few words are there at all."""
        whole, answer = self.whole[i], self.answers[i]
        there = whole.shared(region)
        if len(there) / whole.length < LCS_ANSWER:
            return 0.0, 0.0
        return whole.longest(there) / whole.length, answer.longest(answer.shared(region)) / answer.length

    def batch(self, docs: Words, lengths: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, float, float, bool]]]:
        best: list[dict[int, tuple]] = [{} for _ in lengths]
        tried: dict[tuple[int, int, int], tuple[float, float]] = {}
        for d, at, i, cos in self.search(lengths, ids):
            if (d, at, i) not in tried:
                reach = self.whole[i].length
                tried[d, at, i] = self.check(i, docs[d][max(0, at - reach) : at + 2 * STEP + reach])
            share, answer_share = tried[d, at, i]
            if share >= LCS or (share >= LCS_ANSWER and answer_share >= ANSWER):
                old = best[d].get(i, (0.0, 0.0, False))
                best[d][i] = (max(old[0], cos), max(old[1], share), old[2] or answer_share >= ANSWER)
        return [[(self.index.items[i][0], *x) for i, x in sorted(b.items())] for b in best]


def leaks(searchers: list[Searcher], texts: list[str | None]) -> Iterator[list[tuple[int, float, float, bool]]]:
    """Per text: (item id, best cosine, LCS share, answer found) of the items that it holds."""
    for low in batches_of(texts):
        where, words = located(low), Words(low)
        for rows in zip(*[s.batch(words, *where) for s in searchers], strict=True):
            yield merged(x for r in rows for x in r)


def merged(found: Iterable[tuple[int, float, float, bool]]) -> list[tuple[int, float, float, bool]]:
    """One row an item, the best of what its passages found, whichever blocks they are in."""
    best: dict[int, tuple] = {}
    for item, *x in found:
        best[item] = tuple(map(max, best.get(item, x), x))
    return sorted((item, *x) for item, x in best.items())


KIND = "array<struct<item_id long, cosine double, lcs double, answer boolean>>"


def leaked_items(indexes: list[Index], docs: DataFrame, text: str = "text") -> Column:
    """KIND of a text column: GROUP blocks of the benchmark in one pass over the text, further ones in passes of their own."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))

    def searched(group: list[Index]) -> Column:
        shipped = docs.sparkSession.sparkContext.broadcast(group)

        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            searchers = [Searcher(x) for x in shipped.value]
            for column in batches:
                out = []
                for lo in range(0, len(column), 1000):
                    out += leaks(searchers, column.slice(lo, 1000).to_pylist())
                yield pa.array([[dict(zip(("item_id", "cosine", "lcs", "answer"), x, strict=True)) for x in row] for row in out], kind)
            del searchers
            release()

        # not deterministic to the optimizer, so that a filter on the result doesn't evaluate it again
        return F.arrow_udf(find, KIND).asNondeterministic()(F.col(text))

    groups = [searched(indexes[i : i + GROUP]) for i in range(0, len(indexes), GROUP)]
    if len(groups) > 1:
        # an item that goes on from group to group is found in several: an array of one binds what they found
        of = lambda all_, i, field: F.array_max(F.transform(F.filter(all_, lambda x: x["item_id"] == i), lambda x: x[field]))
        row = lambda all_, i: F.struct(i.alias("item_id"), *[of(all_, i, c).alias(c) for c in ("cosine", "lcs", "answer")])
        one = F.transform(F.array(F.concat(*groups)), lambda a: F.transform(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["item_id"]))), lambda i: row(a, i)))
        return one[0]
    return groups[0] if groups else F.array().cast(KIND.replace(" long", ": long").replace(" double", ": double").replace(" boolean", ": boolean"))


def contamination(docs: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """docs with leaks, an array of the benchmark items found (a column of that name is replaced).

    Null and empty texts hold none; without benchmark items nobody does. Repeated rows get equal results.
    """
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    return docs.select(*kept, leaked_items(indexes, docs, text).alias("leaks"))


def pairs(docs: DataFrame, indexes: list[Index], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: a row for each item that a document holds."""
    d = contamination(docs.select(key, text), indexes, text).select(key, F.explode("leaks").alias("x"))
    return d.select(key, "x.item_id", F.round("x.cosine", 6).alias("cosine"), F.round("x.lcs", 6).alias("lcs"), "x.answer")


def clean(docs: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; columns of any name pass through unchanged.

    Decided row by row, so null and repeated ids don't matter. Null and empty texts stay; without benchmark items all
    rows do; an empty table gives no rows.
    """
    (found,) = fresh(docs, "leaks")
    d = docs.withColumn(found, leaked_items(indexes, docs, text))
    return d.where(F.size(found) == 0).drop(found)
