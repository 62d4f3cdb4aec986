"""Personal data: patterns for the base spans, and a semi-Markov conditional random field that adds spans.

The base patterns drop a match that fails its check (a card glued to a phone number, say). The random field
scores whole candidate segments of up to SEGMENT blank-separated words with features of the entire span,
and a dynamic program over bounded entities chooses boundaries and types together. What it finds outside
the base spans is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release

KINDS = ("email", "ip", "card", "phone")
TYPES = ("other", *KINDS)
SEGMENT = 5
#: Training: documents with candidate characters that are drawn by hash; of their regions and base spans so many, the
#: first by hash; a training region's words and characters (scoring has no such bounds).
SAMPLE, REGIONS, ENTITIES, REGION_WORDS, REGION_CHARS = 2_000, 1_500, 600, 40, 2_000
#: An added span's posterior odds against the best reading without it, in nats.
MARGIN = 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[Span]:
    """From each @: the longest run before it that no earlier match used, and a dotted domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield "email", lo, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    """Four number parts in a run of digits and dots, whole parts from the left."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, i, at = m.group().split("."), 0, [m.start()]
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield "ip", at[i], at[i + 4] - 1
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    out = [*emails(text), *addresses(text)]
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(found), key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


LEAD, TRAIL = "\"'([{<", "\"')]}>.,;:!?|"
FEATURES = (
    "bias", "words", "one @ and a dotted domain", "an @ otherwise", "letters", "letters only", "digits 1-7", "digits 8-15", "digits 16-19",
    "digits 20 and more", "Luhn and 16-19 digits", "card characters only", "starts with +", "a + inside", "phone characters only",
    "balanced brackets", "four parts to 255", "three dots otherwise", "no digit and no @",
)


def segment_features(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FEATURES of many spans of a text (punctuation around them taken off), from running counts of its characters.

    Only spans that counts alone can't judge are looked at one by one: one @, three dots, 16 to 19 digits.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(code, return_inverse=True)
    chars = [chr(c) for c in kinds]

    def count(test) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(np.array([test(c) for c in chars], np.int64)[at])))
        return running[ends] - running[starts]

    n, size = count("0123456789".__contains__), ends - starts
    letters, n_at, plus, dots = count(str.isalpha), count("@".__eq__), count("+".__eq__), count(".".__eq__)
    card_like, phone_like = count("- 0123456789".__contains__) == size, count(" ().0123456789-+".__contains__) == size
    some = size > 0
    first = code[np.where(some, starts, 0)] if len(code) else np.zeros(len(starts), np.uint32)
    last = code[np.where(some, ends - 1, 0)] if len(code) else first
    leads = some & (first == ord("+"))
    mail, quad, check = np.zeros(len(starts), bool), np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for i in np.flatnonzero(n_at == 1):
        s = text[starts[i] : ends[i]]
        mail[i] = next(emails(s), None) == ("email", 0, len(s))
    for i in np.flatnonzero(dots >= 3):
        s = text[starts[i] : ends[i]]
        quad[i] = next(addresses(s), None) == ("ip", 0, len(s))
    for i in np.flatnonzero((n >= 16) & (n <= 19)):
        check[i] = luhn(only_digits(text[starts[i] : ends[i]]))
    digit = np.array([c.isdigit() for c in chars], bool)[np.searchsorted(kinds, last)] if len(code) else some
    return np.stack([
        np.ones(len(starts)), count(" ".__eq__), mail, (n_at > 0) & ~mail, letters > 0, letters == size, (n >= 1) & (n <= 7), (n >= 8) & (n <= 15),
        (n >= 16) & (n <= 19), n >= 20, check, (n > 0) & card_like, leads, plus - leads > 0, some & digit & phone_like,
        count("(".__eq__) == count(")".__eq__), quad, (dots >= 3) & ~quad, (n == 0) & (n_at == 0),
    ], axis=1).astype(float)


def stripped(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in LEAD and not (text[a] == "(" and ")" in text[a:b]):
        a += 1
    while a < b and text[b - 1] in TRAIL and not (text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words with a digit or @, with one word of context on either side; everything else is 'other'."""
    tokens = [m.span() for m in WORD.finditer(text)]
    hot = [i for i, (a, b) in enumerate(tokens) if any(c in "@0123456789" for c in text[a:b])]
    out: list[list[int]] = []
    for i in hot:
        if out and i - out[-1][1] <= 2:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tokens[max(0, a - 1) : b + 2] for a, b in out]


class SemiMarkov:
    """weights: TYPES x FEATURES; trans: TYPES x TYPES. 'other' segments are single words."""

    def __init__(self, weights: np.ndarray | None = None, trans: np.ndarray | None = None) -> None:
        self.weights = np.zeros((len(TYPES), len(FEATURES))) if weights is None else weights
        self.trans = np.zeros((len(TYPES), len(TYPES))) if trans is None else trans

    def lattice(self, text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
        """features[end, length - 1] of every candidate segment; it has to keep to one line's blanks."""
        out = np.zeros((len(tokens), SEGMENT, len(FEATURES)))
        if not tokens:
            return out
        lo = tokens[0][0]
        where = [(e, n) for e in range(len(tokens)) for n in range(1, min(SEGMENT, e + 1) + 1)]
        bounds = np.array([stripped(text, tokens[e - n + 1][0], tokens[e][1]) for e, n in where]) - lo
        e, n = np.array(where).T
        out[e, n - 1] = segment_features(text[lo : tokens[-1][1]], bounds[:, 0], bounds[:, 1])
        return out

    def potentials(self, lattice: np.ndarray) -> np.ndarray:
        """score[end, length - 1, type]; -inf for 'other' of more than one word."""
        s = lattice @ self.weights.T
        s[:, 1:, 0] = -np.inf
        for e in range(min(SEGMENT - 1, len(s))):
            s[e, e + 1 :] = -np.inf
        return s

    def forward(self, s: np.ndarray) -> np.ndarray:
        """alpha[end + 1, type]: log-sum of the readings of a prefix by the type of the last segment."""
        alpha = np.full((len(s) + 1, len(TYPES)), -np.inf)
        alpha[0, 0] = 0.0
        enter = np.full((len(s) + SEGMENT, len(TYPES)), -np.inf)  # row p + SEGMENT - 1: log-sum of what enters a segment at p
        for e in range(len(s)):
            enter[e + SEGMENT - 1] = np.logaddexp.reduce(alpha[e][:, None] + self.trans, axis=0)
            alpha[e + 1] = np.logaddexp.reduce(enter[e : e + SEGMENT][::-1] + s[e], axis=0)
        return alpha

    def backward(self, s: np.ndarray) -> np.ndarray:
        beta = np.full((len(s) + 1, len(TYPES)), -np.inf)
        beta[len(s)] = 0.0
        length = np.arange(SEGMENT)
        for p in range(len(s) - 1, -1, -1):
            n = length[: len(s) - p]
            leave = np.logaddexp.reduce(s[p + n, n] + beta[p + n + 1], axis=0)
            beta[p] = np.logaddexp.reduce(self.trans + leave[None, :], axis=1)
        return beta

    def log_odds(self, s: np.ndarray, segments: list[tuple[int, int, int]]) -> list[float]:
        """Posterior log-odds of segments (end, length, type): one forward and one backward pass for all of them."""
        alpha, beta = self.forward(s), self.backward(s)
        log_z, out = np.logaddexp.reduce(alpha[-1]), []
        for e, n, kind in segments:
            inside = np.logaddexp.reduce(alpha[e + 1 - n] + self.trans[:, kind]) + s[e, n - 1, kind] + beta[e + 1, kind]
            p = min(1 - 1e-12, float(np.exp(inside - log_z)))
            out.append(float(np.log(p) - np.log1p(-p)) if p > 0 else -np.inf)
        return out

    def posterior(self, s: np.ndarray, e: int, n: int, kind: int) -> float:
        """Log-odds that the segment is part of the reading."""
        return self.log_odds(s, [(e, n, kind)])[0]

    def decode(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """Best reading: (end, length, type) of its entities."""
        k = len(TYPES)
        best = np.full((len(s) + 1, k), -np.inf)
        best[0, 0] = 0.0
        enter = np.full((len(s) + SEGMENT, k), -np.inf)
        came, length, types = np.zeros((len(s) + SEGMENT, k), np.int8), np.zeros((len(s) + 1, k), np.int8), np.arange(k)
        for e in range(len(s)):
            step = best[e][:, None] + self.trans
            top = step.argmax(axis=0)
            enter[e + SEGMENT - 1], came[e + SEGMENT - 1] = step[top, types], top
            total = enter[e : e + SEGMENT][::-1] + s[e]
            length[e + 1] = total.argmax(axis=0)
            best[e + 1] = total[length[e + 1], types]
        out, at, kind = [], len(s), int(best[-1].argmax()) if len(s) else 0
        while at:
            n = int(length[at, kind]) + 1
            if kind:
                out.append((at - 1, n, kind))
            at, kind = at - n, int(came[at - n + SEGMENT - 1, kind])
        return out[::-1]

    def fit(self, data: list[tuple[np.ndarray, list[tuple[int, int, int]]]], epochs: int = 12, rate: float = 0.3) -> SemiMarkov:
        """AdaGrad on the log-likelihood of the gold readings [(end, length, type)], 'other' words included."""
        g_w, g_t = np.full_like(self.weights, 1e-6), np.full_like(self.trans, 1e-6)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                lattice, gold = data[i]
                s = self.potentials(lattice)
                alpha, beta = self.forward(s), self.backward(s)
                log_z = np.logaddexp.reduce(alpha[-1])
                d_w, d_t = np.zeros_like(self.weights), np.zeros_like(self.trans)
                for e in range(len(s)):
                    for n in range(1, min(SEGMENT, e + 1) + 1):
                        p = np.exp(alpha[e + 1 - n][:, None] + self.trans + s[e, n - 1][None, :] + beta[e + 1][None, :] - log_z)
                        d_t -= p
                        d_w -= p.sum(axis=0)[:, None] * lattice[e, n - 1][None, :]
                before = 0
                for e, n, k in gold:
                    d_t[before, k] += 1
                    d_w[k] += lattice[e, n - 1]
                    before = k
                d_w -= 1e-3 * self.weights
                g_w += d_w**2
                g_t += d_t**2
                self.weights += rate * d_w / np.sqrt(g_w)
                self.trans += rate * d_t / np.sqrt(g_t)
        return self


Reading = list[tuple[int, int, int]]


def reading(text: str, tokens: list[tuple[int, int]], base: list[Span], starts: list[int]) -> Reading | None:
    """A region's reading [(end, length, type)] by its base spans; None where they leave many digits or an @ unexplained.

    base is sorted by start, and starts has those.
    """
    a, b = tokens[0][0], tokens[-1][1]
    inside = sorted((x for x in base[bisect_left(starts, a) : bisect_left(starts, b)] if x[2] <= b), key=lambda x: (x[1], x[2]))
    gold, i = [], 0
    while i < len(tokens):
        span = next((x for x in inside if tokens[i][0] <= x[1] < tokens[i][1]), None)
        if span is None:
            word = text[slice(*tokens[i])]
            if "@" in word or len(only_digits(word)) >= 7:
                return None
            gold.append((i, 1, 0))
            i += 1
            continue
        n = next((n for n in range(1, SEGMENT + 1) if i + n <= len(tokens) and stripped(text, tokens[i][0], tokens[i + n - 1][1]) == span[1:]), None)
        if n is None:
            return None
        gold.append((i + n - 1, n, TYPES.index(span[0])))
        i += n
    return gold


def examples(text: str) -> Iterator[tuple[str, Reading | None, str | None]]:
    """(region's text, reading, None) for short regions that the base patterns explain; (span's text, None, kind) of base spans."""
    base = sorted(base_spans(text), key=lambda x: x[1])
    starts = [x[1] for x in base]
    for tokens in regions(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        if len(tokens) <= REGION_WORDS and hi - lo <= REGION_CHARS and (gold := reading(text, tokens, base, starts)):
            yield text[lo:hi], gold, None
    for k, a, b in base:
        if b - a <= REGION_CHARS and "\n" not in text[a:b]:
            yield text[a:b], None, k


def train(found: list[tuple[str, Reading]], entities: list[tuple[str, str]]) -> SemiMarkov:
    """Learns from regions with their readings, and from pairs of entities (kind, text) set side by side."""
    model = SemiMarkov()
    words = lambda t: [m.span() for m in WORD.finditer(t)]
    data = [(model.lattice(t, words(t)), gold) for t, gold in found]
    for (k1, s1), (k2, s2) in pairwise(entities):
        text = f"x {s1} {s2} x"
        tokens = words(text)
        n1, n2 = s1.count(" ") + 1, s2.count(" ") + 1
        if max(n1, n2) <= SEGMENT and len(tokens) == n1 + n2 + 2:
            data.append((model.lattice(text, tokens), [(0, 1, 0), (n1, n1, TYPES.index(k1)), (n1 + n2, n2, TYPES.index(k2)), (n1 + n2 + 1, 1, 0)]))
    return model.fit(data) if data else model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> SemiMarkov:
    """Trains on a bounded sample of the documents that have a digit or @: whole documents drawn by the hash of id and text.

    The tasks cut them into regions and base spans; the driver gets REGIONS and ENTITIES of those, the first by
    hash, each of at most REGION_CHARS characters. Rows that repeat an id are drawn by their texts, equal rows alike.
    Null texts and empty tables give an untrained model, which adds no span.
    """
    d = docs.where(F.col(text).rlike("[@0-9]")).select(F.xxhash64(F.lit("pii"), F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    rate = min(1.0, sample / max(1, d.count()))
    drawn = d.where(F.shiftrightunsigned("h", 12).cast("double") / float(2**52) < rate)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, [v for s in gold or [] for v in s], k) for t in batch.column(0).to_pylist() for x, gold, k in examples(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int32()), pa.string()), strict=True)], ["x", "gold", "kind"])

    parts = drawn.select("t").mapInArrow(cut, "x string, gold array<int>, kind string")
    first = lambda d, n: d.orderBy(F.xxhash64("x"), "x").limit(n).collect()
    found = [(r.x, list(zip(r.gold[::3], r.gold[1::3], r.gold[2::3], strict=True))) for r in first(parts.where("kind is null"), REGIONS)]
    model = train(found, [(r.kind, r.x) for r in first(parts.where("kind is not null"), ENTITIES)])
    del found
    release()
    return model


def added_spans(text: str, base: list[Span], model: SemiMarkov) -> list[Span]:
    """The random field's spans that touch no base span. Linear in the text: every region is gone through once."""
    out: list[Span] = []
    union: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if union and a < union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    ends = [b for _, b in union]

    def touches(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i < len(union) and union[i][0] < b

    for tokens in regions(text):
        if not any("@" in text[a:b] or len(only_digits(text[a:b])) >= 4 for a, b in tokens if not touches(a, b)):
            continue
        s = model.potentials(model.lattice(text, tokens))
        new = [(x, stripped(text, tokens[x[0] - x[1] + 1][0], tokens[x[0]][1])) for x in model.decode(s)]
        new = [(x, (a, b)) for x, (a, b) in new if a < b and not touches(a, b)]
        if new:
            out += [(TYPES[x[2]], a, b) for (x, (a, b)), odds in zip(new, model.log_odds(s, [x for x, _ in new]), strict=True) if odds >= MARGIN]
    return out


def redacted(text: str, found: list[Span]) -> str:
    """Every span's characters replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


RESULT = "struct<n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string>"


def personal_data(model: SemiMarkov, text: str = "text") -> Column:
    """RESULT of a text column; redacted is null where nothing was found."""
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 3
    empty = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", None)

    def one(t: str | None) -> tuple:
        if not t:
            return empty
        base = base_spans(t)
        both = base + added_spans(t, base, model)
        counts = [sum(k == x[0] for x in base) for k in KINDS]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), redacted(t, both) if both else None)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = [one(t) for t in column.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    # texts without a digit or @ stay in the JVM
    return F.arrow_udf(find, RESULT).asNondeterministic()(F.when(F.col(text).rlike("[@0-9]"), F.col(text)))


NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")


def detect(docs: DataFrame, model: SemiMarkov, text: str = "text") -> DataFrame:
    """docs with the fields of RESULT added (columns of those names are replaced).

    n_* count the base spans. Null or empty text: no spans. Positions are code points, ends exclusive.
    Long texts are read whole; repeated rows get equal results; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in NAMES]
    (found,) = fresh(docs, "pii")
    return docs.select(*kept, personal_data(model, text).alias(found)).select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in NAMES])


def redact(docs: DataFrame, model: SemiMarkov, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with every span's characters replaced by its kind; a length column, if there is one, follows the text.

    All rows and columns stay, also rows with a null or repeated id. Null and empty texts stay as they are, with their
    lengths; an empty table gives no rows. Columns of any name pass through.
    """
    (name,) = fresh(docs, "pii")
    d = docs.withColumn(name, personal_data(model, text))
    found = F.col(f"{name}.redacted")
    new = {text: F.coalesce(found, F.col(text))}
    if length in docs.columns:
        new[length] = F.when(found.isNotNull(), F.length(found).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return d.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
