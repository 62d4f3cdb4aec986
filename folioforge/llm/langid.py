"""Language identification with a byte convolutional network, trained in numpy.

Text is cut into fixed-length byte windows that cover it whole. Filters of several widths slide over the
one-hot byte classes, max pooling keeps each filter's best match, and a softmax layer gives the languages.
A document's probabilities are its windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, fresh, release, written

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The training sample: about this many windows in all, shared evenly by the languages (8 each at least), and the windows of a
#: document that is drawn.
SAMPLE, EACH_DOC = 12_000, 6
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """Letters by case-folded value, digits, blanks and other ASCII as one class each, UTF-8 bytes apart; 0 pads."""
    table = np.full(256, 29, np.int32)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha():
            table[b] = 1 + (b | 32) - ord("a")
        elif chr(b).isascii() and chr(b).isdigit():
            table[b] = 27
        elif b in b" \t\n\r\x0b\x0c":
            table[b] = 28
        elif 0x80 <= b < 0xC0:
            table[b] = 30 + b - 0x80
        elif b >= 0xC0:
            table[b] = 94 + (b - 0xC0) // 2
    return table


CLASSES, KINDS = byte_classes(), 128


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW classes, text index of each, bytes of each); an empty text has no window."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    raw = np.zeros(int(counts.sum()) * WINDOW, np.int32)
    sizes, at = [], 0
    for t, n in zip(texts, counts, strict=True):
        raw[at : at + len(t)] = CLASSES[np.frombuffer(t, np.uint8)]
        at += int(n) * WINDOW
        if n:
            sizes += [WINDOW] * (int(n) - 1) + [len(t) - (int(n) - 1) * WINDOW]
    return raw.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts), np.array(sizes, np.float32)


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, KINDS, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max over positions and where, per filter."""
        best, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            n = WINDOW - w + 1
            act = table[0][x[:, :n]]
            for j in range(1, w):
                act += table[j][x[:, j : j + n]]
            at = act.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1)

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For inference: the sum of two neighbouring bytes' weights, looked up by the pair."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(KINDS * KINDS, -1).copy()
        two, three, four = self.filters
        return [(pair(two[0], two[1]),), (pair(three[0], three[1]), three[2].copy()), (pair(four[0], four[1]), pair(four[2], four[3]))]

    def probabilities(self, x: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        out = []
        for lo in range(0, len(x), 128):
            part = x[lo : lo + 128]
            pairs = part[:, :-1] * KINDS + part[:, 1:]
            n3, n4 = WINDOW - 2, WINDOW - 3
            a = np.take(tables[0][0], pairs, axis=0, mode="clip").max(axis=1)
            b = np.take(tables[1][0], pairs[:, :n3], axis=0, mode="clip")
            b += np.take(tables[1][1], part[:, 2:], axis=0, mode="clip")
            c = np.take(tables[2][0], pairs[:, :n4], axis=0, mode="clip")
            c += np.take(tables[2][1], pairs[:, 2:], axis=0, mode="clip")
            hidden = np.maximum(np.concatenate((a, b.max(axis=1), c.max(axis=1)), axis=1) + self.bias, 0)
            out.append(softmax(hidden @ self.dense + self.offset))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network | None:
    """Adam on cross-entropy; None without texts. A fifth of the windows is cut short, for short documents."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    cut = [t[: int(rng.integers(12, WINDOW))] if rng.random() < 0.2 else t[:WINDOW] for t in texts]
    x, owner, _ = windows(cut)
    y = y[owner]
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages, [rng.normal(0, 0.1, (w, KINDS, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    params = [*net.filters, net.bias, net.dense, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            best, where = net.pooled(x[at])
            hidden = np.maximum(best + net.bias, 0)
            err = softmax(hidden @ net.dense + net.offset)
            err[np.arange(len(at)), y[at]] -= 1
            err /= len(at)
            back = (err @ net.dense.T) * (hidden > 0)
            grads = [np.zeros_like(p) for p in net.filters]
            rows, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    np.add.at(grads[k][j], (x[at][rows, where[:, part] + j], np.broadcast_to(cols, (len(at), FILTERS))), back[:, part])
            grads += [back.sum(axis=0), hidden.T @ err, err.sum(axis=0)]
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, each_doc: int = EACH_DOC) -> Network | None:
    """Trains on windows of a bounded sample of the rows, drawn by the hash of id and text, evenly over all languages.

    Each language has sample / languages windows, 8 at least, each_doc of them from a document that is drawn, whatever
    the corpus's size. Rows with a null language or an empty text take no part; rows that repeat an id are drawn by
    their texts, equal rows alike.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0))
    counts = written(docs.groupBy("l").agg(F.count("*").alias("n")), "langid-counts")
    languages = counts.count()
    if not languages:
        return None
    each = max(8, sample // languages)
    h = F.xxhash64(F.lit("langid"), F.col("k"), F.col("t"))
    part = F.shiftrightunsigned(h, 12).cast("double") / float(2**52)
    rate = F.least(F.lit(1.0), F.lit(each / each_doc) / F.col("n"))
    start = (F.pmod(F.xxhash64(F.col("h"), F.col("i")), F.greatest(F.length("t") - WINDOW, F.lit(1)).cast("long")) + 1).cast("int")
    drawn = docs.join(counts.withColumnRenamed("l", "c_l"), F.col("l") == F.col("c_l")).where(part < rate).select("t", "l", F.explode(F.sequence(F.lit(1), F.lit(each_doc))).alias("i"), h.alias("h"))
    drawn = drawn.select(F.substring(F.col("t"), start, F.lit(WINDOW)).alias("t"), "l", F.xxhash64("h", "i").alias("o"))
    rows = drawn.orderBy("o", "t", "l").limit(4 * max(sample, 8 * languages)).collect()
    net = train([r.t.encode() for r in rows], [r.l for r in rows])
    del rows
    release()
    return net


def language(net: Network | None, text: str = "text") -> Column:
    """struct<lang_pred, score> of a text column; und with score 0 for null, for a text with no letter or without a network."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables() if net else []
        for column in batches:
            texts = [t or b"" for t in byte_values(column)]
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            lo = 0
            while net and lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 4 << 20):  # about 4 MB of text at a time
                    size, hi = size + len(texts[hi]), hi + 1
                x, owner, weight = windows(texts[lo:hi])
                p = net.probabilities(x, tables) * weight[:, None]
                total = np.stack([np.bincount(owner, p[:, i], hi - lo) for i in range(p.shape[1])], axis=1)
                size_of = np.bincount(owner, weight, hi - lo)
                best = total.argmax(axis=1)
                has = size_of > 0
                pred[lo:hi][has] = np.array(net.languages, object)[best[has]]
                score[lo:hi][has] = np.clip(total[np.arange(hi - lo), best][has] / size_of[has], 0, 1)
                lo = hi
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang_pred", "score"])

    # not deterministic to the optimizer, so that a filter on the result doesn't evaluate it again
    udf = F.arrow_udf(predict, "struct<lang_pred string, score double>").asNondeterministic()
    return udf(F.when(letter, F.col(text)))


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with the columns lang_pred and score added (columns of those names are replaced).

    Repeated rows get equal results; an empty table gives no rows; texts of any length are read whole.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    (x,) = fresh(docs, "lang")
    d = docs.select(*kept).withColumn(x, language(net, text))
    return d.select(*kept, f"{x}.lang_pred", f"{x}.score")
