"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Counts cover every training token. The model's symbols are the end of a text, the SINGLE most frequent words, and
REST symbols that share all other words by their hash; a word of a rest symbol has the symbol's probability times its
smoothed share of the symbol. Symbols are dealt into GROUPS of about equal frequency, most frequent first, and
p(symbol | two symbols before) = p(group | context) * p(symbol | group, context): both factors are an explicit
softmax over batched matrix products, so that token probabilities are normalised.

Training reads every training token, in ROUNDS: in a round each task runs noise-contrastive steps for both
factors on its part of the documents, from a common start, and the tasks' parameters are averaged by their tokens.

Frequent words (HEAD, a fixed bound) are scored where the text is; all others go through a join with the
full counts, so the vocabulary is never held in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, release, written
from .common import words as split_words

#: Single-word symbols, symbols of all other words, groups of symbols, vector length, noise groups of a batch, noise symbols of a group's tokens.
SINGLE, REST, GROUPS, SIZE, NOISE, NEAR_NOISE = 4_096, 256, 64, 16, 16, 8
#: Words scored without a join, and the bytes from which a word goes by its MD5 sum.
HEAD, HEAD_BYTES = 65_536, 64
END = b""
FLUSH = 300_000
#: Tokens of a step and of the window that steps are drawn from, rounds of averaging, parameters in a block of the average.
BATCH, WINDOW, ROUNDS, BLOCK = 4_096, 65_536, 3, 4_096
#: Tokens that are learnt from at least, counted each time: a corpus with fewer is gone through several times, at most PASSES.
LEAST, PASSES, SMALL_BATCH = 12_000_000, 12, 2_048


def words(text: bytes | None) -> list[bytes]:
    """Words; one of more than HEAD_BYTES bytes goes by its MD5 sum, so that no key is long."""
    ws = split_words(text)
    return ws if max(map(len, ws), default=0) <= HEAD_BYTES else [w if len(w) <= HEAD_BYTES else b"\0" + hashlib.md5(w).digest() for w in ws]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (bytes; empty: end of text), n over all documents, pre-aggregated in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in byte_values(batch.column(0)):
                seen.update(words(t))
                seen[END] += 1
                if len(seen) >= FLUSH:
                    yield flushed(seen)
                    seen = Counter()
        yield flushed(seen)
        seen = Counter()
        release()

    def flushed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Totals, the head (words by falling count, the end first), and tokens and distinct words by hash, over all words."""

    tokens: int
    distinct: int
    head: dict[bytes, int]
    head_counts: np.ndarray
    hashed: np.ndarray  # REST x (tokens, words); the end is not among them
    single: int = SINGLE

    def symbols(self) -> Symbols:
        single = min(self.single, len(self.head))
        own = self.head_counts[:single].astype(float)
        rest = self.hashed.astype(float).copy()
        for w, i in self.head.items():
            if 0 < i < single:
                rest[part_of(w)] -= (own[i], 1)
        counts = np.concatenate((own, rest[:, 0]))
        order = np.argsort(-counts, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        smooth = counts[order] + 1
        group = np.minimum((np.cumsum(smooth) - smooth) / smooth.sum() * GROUPS, GROUPS - 1).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1]
        parts = np.array([part_of(w) for w in self.head], np.int64)  # in order of the head's numbers
        of_head = np.where(np.arange(len(self.head)) < single, at[np.minimum(np.arange(len(self.head)), single - 1)], at[single + parts])
        share = np.zeros(len(order))  # log10 of what the share of a rest symbol is divided by
        share[at[single:]] = -np.log10(rest[:, 0] + rest[:, 1] + 1)
        is_rest = np.zeros(len(order), bool)
        is_rest[at[single:]] = True
        return Symbols(smooth, group, int(at[0]), of_head, at[single:], share, is_rest)


def part_of(word: bytes) -> int:
    return zlib.crc32(word) % REST


@dataclass
class Symbols:
    """Symbols by falling count, so that a group is a range of them."""

    counts: np.ndarray  # one more than the tokens of each
    group: np.ndarray
    end: int
    of_head: np.ndarray
    of_part: np.ndarray
    share: np.ndarray
    is_rest: np.ndarray


def head_of(counts: DataFrame, head: int = HEAD, single: int = SINGLE) -> Counts:
    """The most frequent words, by whole classes of frequency (sixteenths of a power of two), at most head of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the classes of frequency that fit the bound, most frequent first: no task sends more than its part of the head
    short = counts.where(F.octet_length("word") > 0).withColumn("class", F.floor(F.log2(F.col("n").cast("double")) * 16))
    least, size = None, 0
    for r in sorted(short.groupBy("class").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["class"]):
        size += r.k
        if size > head - 1:
            break
        least = r["class"]
    top = sorted(((r.word, r.n) for r in short.where(F.col("class") >= least).collect()), key=lambda r: (-r[1], r[0])) if least is not None else []
    end = counts.where(F.octet_length("word") == 0).collect()
    rows = [(END, end[0].n if end else 0)] + [(bytes(w), n) for w, n in top]
    hashed = np.zeros((REST, 2), np.int64)
    for r in counts.where(F.octet_length("word") > 0).groupBy((F.crc32("word") % REST).alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        hashed[r.part] = r.n, r.v
    return Counts(total.n, total.v, {w: i for i, (w, _) in enumerate(rows)}, np.array([n for _, n in rows], np.int64), hashed, single)


def triples(symbols: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each token; the end stands before a text."""
    one, two = np.roll(symbols, 1), np.roll(symbols, 2)
    one[starts] = two[starts] = end
    second = starts + 1
    second = second[(second < len(symbols))]
    two[second] = np.where(np.isin(second, starts), two[second], end)
    return one, two


def log_sums(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """ln of the sum of exp(h . row) over a table's rows."""
    x = h @ table.T
    if x.size and not np.abs(x).max() < 60:
        top = x.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
    np.exp(x, out=x)
    return np.log(x.sum(axis=1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class LogBilinear:
    """h = near * r_a + far * r_b of the symbols before, a the nearer one. A group scores top_g . h + top_bias_g, a symbol of
    a group q_w . h + bias_w."""

    NAMES = ("r", "near", "far", "q", "bias", "top", "top_bias")

    def __init__(self, symbols: Symbols, seed: int = 11) -> None:
        rng, n = np.random.default_rng(seed), len(symbols.counts)
        self.group = symbols.group
        mass = np.bincount(self.group, symbols.counts)
        self.first = np.searchsorted(self.group, np.arange(len(mass) + 1))
        real = np.float32
        self.r, self.q = rng.normal(0, 0.3, (n, SIZE)).astype(real), rng.normal(0, 0.01, (n, SIZE)).astype(real)
        self.near, self.far, self.top = np.ones(SIZE, real), np.full(SIZE, 0.5, real), rng.normal(0, 0.01, (len(mass), SIZE)).astype(real)
        self.bias, self.top_bias = np.log(symbols.counts / mass[self.group]).astype(real), np.log(mass / mass.sum()).astype(real)
        # noise: groups by the root of their frequency, symbols of a group by frequency
        self.noise_top = np.sqrt(mass) / np.sqrt(mass).sum()
        self.log_noise = np.log(symbols.counts / mass[self.group]).astype(real)
        self.running = np.concatenate(([0.0], np.cumsum(symbols.counts)))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.NAMES:
            old = getattr(self, x)
            setattr(self, x, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.near * self.r.take(one, axis=0) + self.far * self.r.take(two, axis=0)

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """ln p(w | one, two), both factors normalised: all groups at once, then each group's tokens together."""
        g = self.group[w]
        order = np.argsort(g, kind="stable")  # tokens of a group follow each other
        g, w = g[order], w[order]
        h = np.ones((len(w), SIZE + 1), np.float32)  # the last column meets the biases
        h[:, :SIZE] = self.context(one[order], two[order])
        top, q = np.column_stack((self.top, self.top_bias)), np.column_stack((self.q, self.bias))
        x = np.einsum("nd,nd->n", h, top.take(g, axis=0)) - log_sums(h, top)
        edges = np.searchsorted(g, np.arange(len(top) + 1))
        for k in np.flatnonzero((edges[1:] > edges[:-1]) & (self.first[1:] - self.first[:-1] > 1)):
            part = slice(edges[k], edges[k + 1])
            x[part] += np.einsum("nd,nd->n", h[part], q.take(w[part], axis=0)) - log_sums(h[part], q[self.first[k] : self.first[k + 1]])
        out = np.empty_like(x)
        out[order] = x
        return out

    def nce(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, rng: np.random.Generator, memory: dict[str, np.ndarray], rate: float = 0.2) -> None:
        """An AdaGrad step on tokens. Group: NOISE shared noise groups; symbol: NEAR_NOISE noise symbols for the tokens of a group."""
        order = np.argsort(self.group[w], kind="stable")
        one, two, w = one[order], two[order], w[order]
        n, g = len(w), self.group[w]
        h = self.context(one, two)
        drawn = rng.choice(len(self.noise_top), NOISE, p=self.noise_top)
        log_kp = np.log(NOISE * self.noise_top).astype(np.float32)
        own_top, own_q = self.top.take(g, axis=0), self.q.take(w, axis=0)
        top_pos = sigmoid(np.einsum("nd,nd->n", h, own_top) + (self.top_bias - log_kp)[g]) - 1
        top_neg = sigmoid(h @ self.top[drawn].T + (self.top_bias[drawn] - log_kp[drawn]))
        d_h = top_pos[:, None] * own_top + top_neg @ self.top[drawn]

        wide = self.first[g + 1] - self.first[g] > 1  # a group of one symbol needs no choice
        odds = np.float32(np.log(NEAR_NOISE))
        own = np.where(wide, sigmoid(np.einsum("nd,nd->n", h, own_q) + (self.bias - self.log_noise)[w] - odds) - 1, np.float32(0))
        d_h += own[:, None] * own_q
        there = np.unique(g[wide])
        low, high = self.running[self.first[there]], self.running[self.first[there + 1]]
        noise = np.searchsorted(self.running, low[:, None] + rng.random((len(there), NEAR_NOISE)) * (high - low)[:, None], side="right") - 1
        noise = np.minimum(noise, self.first[there + 1][:, None] - 1)
        lo, hi = np.searchsorted(g, there), np.searchsorted(g, there, side="right")
        q_noise, b_noise = self.q[noise], self.bias[noise] - self.log_noise[noise] - odds
        d_noise, d_bias = np.empty((*noise.shape, SIZE), np.float32), np.empty(noise.shape, np.float32)
        for k in range(len(there)):
            part = h[lo[k] : hi[k]]
            x = sigmoid(part @ q_noise[k].T + b_noise[k])
            d_h[lo[k] : hi[k]] += x @ q_noise[k]
            d_noise[k], d_bias[k] = x.T @ part, x.sum(axis=0)

        def step(name: str, at: np.ndarray, rows: np.ndarray) -> None:
            """Adds up the gradients of each row and moves the rows that have one."""
            rows = rows.reshape(len(at), -1)
            turn = np.argsort(at, kind="stable")
            at = at[turn]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            who, d = at[first], np.add.reduceat(rows.take(turn, axis=0), first, axis=0) / np.float32(n)
            table, seen = getattr(self, name).reshape(-1, rows.shape[1]), memory[name].reshape(-1, rows.shape[1])
            new = seen[who] + d * d
            seen[who] = new
            table[who] -= rate * d / np.sqrt(new + 1e-10)

        symbols, groups, zero = np.concatenate((w[wide], noise.ravel())), np.concatenate((g, drawn)), np.zeros(1, np.int64)
        moves = (
            ("r", np.concatenate((one, two)), np.concatenate((d_h * self.near, d_h * self.far))),
            ("near", zero, np.einsum("nd,nd->d", d_h, self.r.take(one, axis=0))), ("far", zero, np.einsum("nd,nd->d", d_h, self.r.take(two, axis=0))),
            ("q", symbols, np.concatenate((own[wide, None] * h[wide], d_noise.reshape(-1, SIZE)))), ("bias", symbols, np.concatenate((own[wide], d_bias.ravel()))),
            ("top", groups, np.concatenate((top_pos[:, None] * h, top_neg.T @ h))), ("top_bias", groups, np.concatenate((top_pos, top_neg.sum(axis=0)))),
        )
        for name, at, rows in moves:
            if len(at):
                step(name, at, rows)


def symbol_lookup(counts: Counts, symbols: Symbols) -> dict[bytes, int]:
    single = min(counts.single, len(counts.head))
    return {w: int(symbols.of_head[i]) for w, i in counts.head.items() if 0 < i < single}


def train(docs: DataFrame, counts: Counts, text: str = "text", passes: int | None = None, seed: int = 11) -> LogBilinear:
    """ROUNDS of noise-contrastive passes, each over the documents that the text's hash deals to it; then the average by tokens.

    passes over each window: as many as make LEAST tokens, from 1 to PASSES; steps of a corpus that needs several are SMALL_BATCH tokens.
    """
    needed = -(-LEAST // max(1, counts.tokens))
    passes = passes or int(min(PASSES, max(1, needed)))
    batch_size = SMALL_BATCH if passes > 1 else BATCH
    symbols = counts.symbols()
    model = LogBilinear(symbols, seed)
    known = symbol_lookup(counts, symbols)
    spark = docs.sparkSession

    def learn(start: np.ndarray):
        shipped = spark.sparkContext.broadcast((start, symbols, known))

        def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, symbols, known = shipped.value
            own = LogBilinear(symbols, seed)
            own.load(start)
            rng, memory = np.random.default_rng(seed), {x: np.zeros_like(getattr(own, x)) for x in own.NAMES}
            ids: list[int] = []
            starts: list[int] = []
            total = 0

            def steps() -> None:
                c = np.array(ids, np.int64)
                one, two = triples(c, np.array(starts), symbols.end)
                for _ in range(passes):
                    order = rng.permutation(len(c))
                    for lo in range(0, len(c), batch_size):
                        at = order[lo : lo + batch_size]
                        own.nce(one[at], two[at], c[at], rng, memory)

            for batch in batches:
                for t in byte_values(batch.column(0)):
                    starts.append(len(ids))
                    ids += [known[w] if w in known else int(symbols.of_part[part_of(w)]) for w in words(t)]
                    ids.append(symbols.end)
                    if len(ids) >= WINDOW:
                        steps()
                        total += len(ids)
                        ids, starts = [], []
            if ids:
                steps()
                total += len(ids)
            if total:
                flat, task = own.flat(), TaskContext.get().partitionId()
                at = range(0, len(flat), BLOCK)
                arrays = [pa.array([total] * len(at), pa.int64()), pa.array([i // BLOCK for i in at], pa.int32()), pa.array([task % 256] * len(at), pa.int32()), pa.array([flat[i : i + BLOCK].astype(np.float64).tobytes() for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["tokens", "block", "task", "params"])

        return pass_over

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = pdf["tokens"].to_numpy(float)
        total = sum(np.frombuffer(p, np.float64) * n for p, n in zip(pdf["params"], tokens, strict=True))
        return pd.DataFrame({"tokens": [int(tokens.sum())], "block": [pdf["block"].iloc[0]], "task": [pdf["task"].iloc[0]], "params": [(total / tokens.sum()).tobytes()]})

    schema = "tokens long, block int, task int, params binary"
    for n in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64(F.lit(seed), F.col(text)), F.lit(ROUNDS)) == n).select(text)
        rows = part.mapInArrow(learn(model.flat()), schema)
        # two levels, so that no group holds the parameters of all tasks
        means = rows.groupBy("block", "task").applyInPandas(average, schema).groupBy("block").applyInPandas(average, schema).collect()
        if means:  # rounded, so that the order of the sums doesn't show
            model.load(np.concatenate([np.frombuffer(r.params, np.float64) for r in sorted(means, key=lambda r: r.block)]).round(6))
    return model


class Scorer:
    """Sums of a batch of texts."""

    def __init__(self, counts: Counts, model: LogBilinear) -> None:
        self.counts, self.model, self.symbols = counts, model, counts.symbols()
        self.log_count = np.log10(counts.head_counts + 1.0)

    def batch(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[list[tuple[bytes, int]]]]:
        """Per text: tokens, head tokens that are known, sum of log10(c + 1), model sum; and the words outside the head."""
        get, ids, starts, sizes, tails, far = self.counts.head.get, [], [], [], [], []
        for t in texts:
            ws = words(t)
            found = [get(w, -1) for w in ws]
            outside = [w for w, i in zip(ws, found, strict=True) if i < 0] if -1 in found else []
            tails.append(list(Counter(outside).items()))
            far += map(part_of, outside)
            starts.append(len(ids))
            ids += found
            ids.append(0)
            sizes.append(len(ws) + 1)
        h, starts, sizes, s = np.array(ids, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), self.symbols
        c = s.of_head[np.maximum(h, 0)]
        c[h < 0] = s.of_part[np.array(far, np.int64)]
        one, two = triples(c, starts, s.end)
        log_count = np.where(h >= 0, self.log_count[np.maximum(h, 0)], 0.0)
        model = np.where(s.is_rest[c], s.share[c] + log_count, 0.0)
        for lo in range(0, len(c), 16_384):
            part = slice(lo, lo + 16_384)
            model[part] += self.model.log_probabilities(one[part], two[part], c[part]) / np.log(10)
        known = (h >= 0) & (self.counts.head_counts[np.maximum(h, 0)] > 0)
        return [sizes, np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(log_count, starts), np.add.reduceat(model, starts)], tails


def score(docs: DataFrame, counts: DataFrame, head: Counts, model: LogBilinear, text: str = "text") -> DataFrame:
    """docs' columns without the text, and n_tokens, n_known, train_tokens, base_score, score (columns of those
    names are replaced). A null text is scored as an empty one, that is its end; rows that repeat stay apart; an empty
    table gives no rows."""
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score", text.lower())
    kept = [c for c in docs.columns if c.lower() not in new]
    shipped = docs.sparkSession.sparkContext.broadcast((head, model))
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, part, row = Scorer(*shipped.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sums, tails = scorer.batch(byte_values(batch.column("_text")))
                ids = np.arange(row, row + batch.num_rows, dtype=np.int64) + (part << 40)
                row += batch.num_rows
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in tails]))).astype(np.int32)
                flat = [x for t in tails for x in t]
                tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int32())], ["word", "n"]))
                arrays = [batch.column(c) for c in batch.schema.names if c != "_text"]
                names = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids), *map(pa.array, sums), tail.cast(tail_type)], [*names, "_row", "n_tokens", "_known", "_logs", "_model", "_tail"])

    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    d = docs.select(*numbered, F.col(text).alias("_text")).mapInArrow(
        per_text, f"{schema}{', ' if kept else ''}_row long, n_tokens long, _known long, _logs double, _model double, _tail array<struct<word: binary, n: int>>"
    )
    d = written(d, "lm-scores")
    # every frequent word is in the head, so that no word is a hot key here
    tail = d.select("_row", F.explode("_tail").alias("t")).select("_row", F.col("t.word").alias("word"), F.col("t.n").alias("k"))
    joined = tail.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("t_known"),
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1)).alias("t_logs"),
    )
    d = d.drop("_tail").join(joined, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    logs = F.col("_logs") + zero("t_logs")
    return d.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "n_tokens", (F.col("_known") + zero("t_known")).cast("long").alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(head.tokens + head.distinct + 1))).alias("base_score"),
        (F.col("_model") + zero("t_logs")).alias("score"),
    )


def fit(docs: DataFrame, text: str = "text", head: int = HEAD, passes: int | None = None, single: int = SINGLE) -> tuple[DataFrame, Counts, LogBilinear]:
    """Counts of all words, their head, and the trained model, from every row (rows that repeat count each time; null texts
    are empty). Without documents the model is untrained. single: words with a symbol of their own; passes: see train()."""
    counts = written(word_counts(docs, text), "lm-counts")
    top = head_of(counts, head, single)
    return counts, top, train(docs, top, text, passes)
