"""Toxicity by a linear-chain conditional random field over words.

Document labels become token labels: in toxic documents, words (or word stems) that the labelled sample
ties to toxic documents are tagged 1. A two-state chain with word and stem features is trained on those
tags in numpy. Forward-backward marginals of every word are summed up per document, and a logistic layer
turns sum, maximum and rate into the document's score.

A document is one chain, whatever its length: its words are cut into blocks, a block's 2 x 2 transfer matrix is
composed over its words, messages run over the blocks in both directions, and inside a block the words' marginals
follow from the two messages at its ends.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

TOKEN = re.compile(r"[^\W\d_]+")
#: Words of a block of a chain.
CHAIN = 64
STEMS = (4, 5)
#: Training: labelled documents of either label, drawn by hash, whole; blocks of them that train the chain; features at most.
SAMPLE_TOXIC, SAMPLE_OTHER, BLOCKS, FEATURES = 1_500, 3_000, 4_000, 200_000
#: Log-odds from which a feature is part of the chain, and from which it tags a word of a toxic document; documents that need it.
WEAK, STRONG, LEAST = 1.5, 3.0, 5
#: Rows of the logistic layer's fit for each document that is asked for, and letters of a word that the driver gets.
ROWS, LONGEST = 4, 128
THRESHOLD = 0.3
CACHE = 400_000


def features(token: str) -> list[str]:
    w = token.lower()
    return [f"={w}", *[f"{w[:n]}*" for n in STEMS if len(w) >= n]]


@dataclass
class Chain:
    """emission[f]: score of state 1 for a feature; bias: of any word; trans[a, b]; start[a]."""

    index: dict[str, int]
    emission: np.ndarray
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0, 1.0]))
    prior: float = 0.0

    def score(self, token: str) -> float:
        return float(sum(self.emission[i] for f in features(token) if (i := self.index.get(f)) is not None))


class Scores(dict):
    """Emission score by token, filled as tokens appear."""

    def __init__(self, chain: Chain) -> None:
        super().__init__()
        self.chain = chain

    def __missing__(self, token: str) -> float:
        self[token] = out = self.chain.score(token)
        return out


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n chains x CHAIN words with state-1 scores e: P(tag = 1), pair marginals summed per chain, log Z.

    mask is true for the words that exist, which come first.
    """
    n, length = e.shape
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    obs = np.stack((np.zeros_like(e), e), axis=2)
    alpha[:, 0] = obs[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + obs[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for t in range(length - 2, -1, -1):
        nxt = obs[:, t + 1] + beta[:, t + 1]
        step = np.stack([np.logaddexp(trans[a, 0] + nxt[:, 0], trans[a, 1] + nxt[:, 1]) for a in (0, 1)], axis=1)
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]) * mask
    pair = np.exp(alpha[:, :-1, :, None] + trans + (obs + beta)[:, 1:, None, :] - log_z[:, None, None, None]) * mask[:, 1:, None, None]
    return p, pair, log_z


def blocks(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's word scores as rows of CHAIN, and which cells are words."""
    n = -(-len(scores) // CHAIN)
    out, mask = np.zeros(n * CHAIN), np.zeros(n * CHAIN, bool)
    out[: len(scores)], mask[: len(scores)] = scores, True
    return out.reshape(n, CHAIN), mask.reshape(n, CHAIN)


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Tagger:
    """Marginals of many documents at once. Blocks without any feature share a table by length: K[t] for each word t
    with left message a and right message b gives P(tag = 1) as a K[t] b / a M b."""

    def __init__(self, chain: Chain) -> None:
        self.chain, self.scores = chain, Scores(chain)
        self.step = np.exp(np.clip(chain.trans, -30, 30))
        self.start = np.array([[1.0, 1.0], [0.0, 0.0]])  # a document begins in a state before the two, with no transition
        self.plain = []
        for first in (True, False):
            inner, whole = np.zeros((CHAIN + 1, CHAIN, 2, 2)), np.zeros((CHAIN + 1, 2, 2))
            for n in range(1, CHAIN + 1):
                e, mask = np.full((1, CHAIN), chain.bias), np.arange(CHAIN)[None, :] < n
                m = self.matrices(e, mask, np.array([first]))
                whole[n], inner[n] = self.transfer(m)[0], self.words(m)[0]
            self.plain.append((inner, whole))

    def matrices(self, e: np.ndarray, mask: np.ndarray, first: np.ndarray) -> np.ndarray:
        """blocks x CHAIN x 2 x 2: transition into each word times its emission; the identity where there is no word."""
        m = np.broadcast_to(self.step, (*e.shape, 2, 2)).copy()
        m[first, 0] = self.start
        m[..., 1] *= np.exp(np.clip(e, -30, 30))[..., None]
        m /= m.sum(axis=(2, 3), keepdims=True)
        m[~mask] = np.eye(2)
        return m

    def transfer(self, m: np.ndarray) -> np.ndarray:
        out = m[:, 0]
        for t in range(1, m.shape[1]):
            out = out @ m[:, t]
            out = out / out.sum(axis=(1, 2), keepdims=True)
        return out

    def words(self, m: np.ndarray) -> np.ndarray:
        """blocks x CHAIN x 2 x 2: the product over the block with word t held to state 1, at the scale of the whole product."""
        n = len(m)
        left, right = np.empty_like(m), np.empty_like(m)
        left[:, 0], right[:, -1] = m[:, 0], np.eye(2)
        for t in range(1, CHAIN):
            x = left[:, t - 1] @ m[:, t]
            left[:, t] = x / x.sum(axis=(1, 2), keepdims=True)
            x = m[:, CHAIN - t] @ right[:, CHAIN - t]
            right[:, CHAIN - 1 - t] = x / x.sum(axis=(1, 2), keepdims=True)
        held = left[..., :, 1, None] * right[..., None, 1, :]
        both = left @ right
        scale = self.transfer(m).sum(axis=(1, 2)) / np.maximum(both.sum(axis=(2, 3)).T, 1e-300)
        return held * scale.T.reshape(n, CHAIN, 1, 1)

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        rows = [np.fromiter(map(self.scores.__getitem__, tokens), float, len(tokens)) for tokens in docs]
        if len(self.scores) > CACHE:
            self.scores.clear()
        parts = [blocks(s) for s in rows]
        counts = np.array([len(e) for e, _ in parts])
        if not counts.sum():
            return [np.zeros(0) for _ in docs]
        e, mask = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        begin = np.cumsum(counts) - counts
        place = np.arange(len(e)) - np.repeat(begin, counts)
        first, length = place == 0, mask.sum(axis=1)
        whole = np.where(first[:, None, None], self.plain[0][1][length], self.plain[1][1][length])
        special = np.flatnonzero((e != 0).any(axis=1))
        inner: dict[int, np.ndarray] = {}
        for lo in range(0, len(special), 2048):
            at = special[lo : lo + 2048]
            m = self.matrices(e[at] + self.chain.bias, mask[at], first[at])
            whole[at] = self.transfer(m)
            inner |= dict(zip(at.tolist(), self.words(m), strict=True))
        # messages over the blocks of all documents in step, the longest first
        a, b = np.full((len(e), 2), 0.5), np.full((len(e), 2), 0.5)
        order = np.argsort(-counts, kind="stable")
        live = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), side="right")
        a[begin[counts > 0]] = (1.0, 0.0)
        for k in range(1, counts.max()):
            at = begin[order[: live[k]]] + k
            a[at] = unit(np.einsum("ni,nij->nj", a[at - 1], whole[at - 1]))
        for k in range(counts.max() - 2, -1, -1):
            at = begin[order[: live[k + 1]]] + k
            b[at] = unit(np.einsum("nij,nj->ni", whole[at + 1], b[at + 1]))
        p = np.empty((len(e), CHAIN))
        for is_first, (table, _) in zip((True, False), self.plain, strict=True):
            for lo in range(0, len(e), 4096):
                at = lo + np.flatnonzero(first[lo : lo + 4096] == is_first)
                p[at] = np.einsum("ni,ntij,nj->nt", a[at], table[length[at]], b[at])
        for at, table in inner.items():
            p[at] = np.einsum("i,tij,j->t", a[at], table, b[at])
        p /= np.einsum("ni,nij,nj->n", a, whole, b)[:, None]
        p = np.clip(p, 0.0, 1.0)
        return [p[lo : lo + n].reshape(-1)[: len(t)] for lo, n, t in zip(begin, counts, docs, strict=True)]


def summary(p: np.ndarray) -> list[float]:
    """What the last layer sees of a document's marginals."""
    total = float(p.sum())
    return [1.0, math.log1p(total), float(p.max(initial=0.0)), math.log1p(1000 * total / max(len(p), 1)) / 4]


def train(rows: list[tuple[list[str], list[int]]], index: dict[str, int], epochs: int = 60) -> Chain:
    """A chain over blocks of words with their tags, by Adam on the likelihood. index: the features' numbers."""
    n, f_max = len(rows), 1 + len(STEMS)
    ids, mask, gold = np.full((n, CHAIN, f_max), len(index)), np.zeros((n, CHAIN), bool), np.zeros((n, CHAIN))
    for r, (tokens, tags) in enumerate(rows):
        mask[r, : len(tokens)], gold[r, : len(tokens)] = True, tags
        for t, token in enumerate(tokens):
            at = [index[f] for f in features(token) if f in index]
            ids[r, t, : len(at)] = at
    both = np.stack((1 - gold, gold), axis=2)
    pairs = (both[:, :-1, :, None] * both[:, 1:, None, :] * mask[:, 1:, None, None]).sum(axis=(0, 1))
    size = len(index) + 1
    params = np.zeros(size + 5)  # emissions, a dead slot, bias, transitions
    params[size], m, v = -4.0, np.zeros(size + 5), np.zeros(size + 5)
    for step in range(1, epochs + 1):
        emission, bias, trans = params[:size], params[size], params[size + 1 :].reshape(2, 2)
        p, pair, _ = forward_backward((emission[ids].sum(axis=2) + bias) * mask, mask, trans)
        err = (p - gold) * mask
        grad = np.concatenate((np.bincount(ids.ravel(), np.repeat(err.ravel(), f_max), size), [err.sum()], (pair.sum(axis=(0, 1)) - pairs).ravel())) / n
        grad += 1e-4 * params
        grad[size - 1] = 0
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        params -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(index, params[: size - 1].copy(), float(params[size]), params[size + 1 :].reshape(2, 2).copy())


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    layer = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        layer -= np.linalg.solve(h, x.T @ (w * (q - y)) + 0.5 * layer)
    return layer


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> Chain:
    """Learns from a bounded sample of the labelled rows, drawn by the hash of the id; their texts stay in the tasks.

    A document labelled twice counts with its larger label; rows with a null id, or a label that is neither 0 nor
    1, are left out; documents that repeat an id all count; null texts are empty. The tasks count the features of
    the sampled documents, cut blocks of words from them and sum up their marginals; the driver gets at most FEATURES
    feature counts, BLOCKS blocks (words cut to LONGEST letters) and four numbers a row, of ROWS * (toxic + other) different rows at most. The sampled ids, at most twice toxic + other, are broadcast.
    Unless both labels occur, the chain only knows the share of toxic documents.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("l_key")).agg(F.max(label).cast("int").alias("y"))
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    rate = {0: min(1.0, other / max(1, n.get(0, 0))), 1: min(1.0, toxic / max(1, n.get(1, 0)))}
    part = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), F.col("l_key")), 12).cast("double") / float(2**52)
    drawn = y.where(part < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).limit(2 * (toxic + other))
    d = docs.select(F.col(key).alias("d_key"), F.coalesce(text, F.lit("")).alias("t"))
    sample = written(d.join(F.broadcast(drawn), F.col("d_key") == F.col("l_key")).select("t", "y"), "toxicity-sample")
    seen = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(seen) < 2:
        return Chain({}, np.zeros(0), prior=float(seen.get(1, 0) > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c.update({(f, label) for w in set(TOKEN.findall(t)) for f in features(w)})
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in c], pa.string()), pa.array([x for _, x in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["f", "y", "n"])

    counted = sample.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    odds = F.ln((F.col("n1") + 0.5) / (seen[1] + 1)) - F.ln((F.col("n0") + 0.5) / (seen[0] + 1))
    chosen = counted.where(F.col("n1") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= WEAK).orderBy(F.desc("odds"), F.desc("n1"), "f").limit(FEATURES).collect()
    strong, index = {r.f for r in chosen if r.odds >= STRONG}, {f: i for i, f in enumerate(sorted(r.f for r in chosen))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, rng = TOKEN.findall(t), random.Random(t)
                tags = [int(bool(label) and any(f in strong for f in features(w))) for w in tokens]
                for lo in range(0, len(tokens), CHAIN):
                    if any(tags[lo : lo + CHAIN]) or rng.random() < (0.05 if label else 0.15):
                        rows.append(([w[:LONGEST] for w in tokens[lo : lo + CHAIN]], tags[lo : lo + CHAIN]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["tokens", "tags"])

    pieces = sample.mapInArrow(cut, "tokens array<string>, tags array<int>").orderBy(F.xxhash64("tokens"), "tokens").limit(BLOCKS).collect()
    chain = train([(r.tokens, r.tags) for r in pieces], index)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(chain)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                x = [summary(p) for p in tagger.marginals([TOKEN.findall(t) for t in piece.column(0).to_pylist()])]
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # ids may repeat, so that rows have no bound of their own; equal ones are one row with a weight
    few = sample.mapInArrow(summed, "y int, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n"))
    rows = sorted(few.orderBy(F.xxhash64("x", "y"), "y", "x").limit(ROWS * (toxic + other)).collect(), key=lambda r: (r.y, r.x))
    chain.layer = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float), np.array([r.n / rate[r.y] for r in rows]))
    return chain


def toxicity(chain: Chain, text: str = "text") -> Column:
    """struct<score, spans array<struct<start, end, probability>>> of a text column; spans in code points."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(chain)
        for column in batches:
            out, found = [], []
            for lo in range(0, len(column), 512):
                texts = [t or "" for t in column.slice(lo, 512).to_pylist()]
                docs = [TOKEN.findall(t) for t in texts]
                for t, p in zip(texts, tagger.marginals(docs) if chain.index else [np.zeros(len(d)) for d in docs], strict=True):
                    if chain.index:
                        z = float(np.dot(summary(p), chain.layer))
                        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    else:
                        out.append(chain.prior)
                    hit = set(np.flatnonzero(p >= 0.5).tolist())
                    found.append([(m.start(), m.end(), float(p[i])) for i, m in enumerate(TOKEN.finditer(t)) if i in hit] if hit else [])
            spans = pa.array([[dict(zip(("start", "end", "probability"), x, strict=True)) for x in row] for row in found], kind)
            yield pa.StructArray.from_arrays([pa.array(out, pa.float64()), spans], ["score", "spans"])

    return F.arrow_udf(score, "struct<score double, spans array<struct<start int, end int, probability double>>>").asNondeterministic()(F.col(text))


def tag(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted and toxic_spans added (columns of those names are replaced).

    Null and empty texts get the score of a document without words. Without both labels in the training
    rows, every score is the share of toxic ones among them (0 for none). Long texts are read whole;
    repeated rows get equal scores; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted", "toxic_spans")]
    (x,) = fresh(docs, "tox")
    d = docs.select(*kept, toxicity(chain, text).alias(x))
    return d.select(*kept, F.col(f"{x}.score").alias("score"), (F.col(f"{x}.score") >= threshold).cast("int").alias("predicted"), F.col(f"{x}.spans").alias("toxic_spans"))
