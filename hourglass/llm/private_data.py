"""Operator 10 — personal data: fixed patterns and a linear-chain conditional random field.

The base finds e-mail and IP addresses, card and phone numbers by pattern and
check.  A conditional random field over word-shape features adds spans: runs
of words that it labels with a kind and that touch no base span.  It is
trained by gradient (forward-backward over all sequences together) on a small
labelled table of word windows, and decoded by Viterbi in numpy batches.

A word's shape keeps its marks, turns letters to a and A, digits to 9, and
notes whether its digits pass the card check or make octets.  Features are the
shape, the shape with runs as one, its ends, its number of digits, its marks,
and the shapes of both neighbours.  Only words near a digit or an ``@`` are
decoded (``NEAR`` words to each side); all others are no personal data.

The labelled table is the lines of ``private_examples``, marked by hand, the same
for every input, unless the caller gives one: windows of other lines
(:func:`marked_windows`), or of a corpus with base spans as labels
(:func:`labelled_windows`: at most ``LABELLED_WINDOWS`` windows of each of at most
about ``fit_rows`` documents, chosen by hashes of the id and of the window's
place).  Null texts are empty; texts without personal data have zero counts and
empty spans; rows with equal or null ids are rows of their own; without any
labelled window nothing is added; an empty table gives an empty result; other
columns are passed over (``private_spans``) or kept (``mask_private``).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces, release, sampled, text_bytes, word_spans
from .private_examples import examples
from .sequences import viterbi

#: Kinds in order, patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# (possessive, and from the start of a run of digits: the same matches, without trying a long run from every digit)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]+")

#: Documents that the labelled table is taken from at most (by expectation); words around a digit that are decoded;
#: what a label must gain over none.
FIT_ROWS, NEAR, MARGIN = 2_000, 3, 3.0
STATES = ("", *KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        # more digits than three are no octet; int() refuses very many
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SHAPES = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    digits = NO_DIGIT.sub("", word)
    out = "".join(c if c < "\x7f" else "u" for c in word.translate(SHAPES))
    out = RUNS.sub(lambda m: m.group()[0] if m.group()[0] in "aAu" else m.group(), out)
    checked = "L" if 14 <= len(digits) <= 19 and luhn(digits) else ""
    octets = [p for p in re.split(r"[^0-9]+", word) if p]
    return out + "\0" + checked + ("O" if len(octets) == 4 and all(len(p) < 4 and int(p) < 256 for p in octets) else "")


def shape_features(s: str) -> list[str]:
    plain, flags = s.split("\0")
    short = RUNS.sub(r"\1", plain)
    return ["s" + plain, "r" + short, "<" + short[:2], ">" + short[-2:], f"d{min(plain.count('9'), 20)}", "f" + flags,
            *("c" + c for c in "@.+-()" if c in plain), "1"]


class Field:
    """A linear-chain conditional random field; a word's score is its own features' and its neighbours' shapes'."""

    def __init__(self, sequences: list[tuple[list[str], list[int]]], rounds: int = 40, seed: int = 2):
        self.names: dict[str, int] = {}
        self.cache: dict[str, np.ndarray] = {}
        coded = [[self._coded(w, True) for w in self._views(shapes)] for shapes, _ in sequences]
        k = len(STATES)
        self.weights, self.transition = np.zeros((len(self.names), k)), np.zeros((k, k))
        if not sequences:
            return
        rng, t = np.random.default_rng(seed), 0
        state = [np.zeros_like(self.weights), np.zeros_like(self.transition)]
        second = [np.zeros_like(self.weights), np.zeros_like(self.transition)]
        for _ in range(rounds):
            order = rng.permutation(len(sequences))
            for at in np.array_split(order, max(1, len(order) // 128)):
                t += 1
                grads = self._gradient([coded[i] for i in at], [sequences[i][1] for i in at])
                for j, (w, g) in enumerate(zip((self.weights, self.transition), grads)):
                    state[j] = 0.9 * state[j] + 0.1 * g
                    second[j] = 0.99 * second[j] + 0.01 * g * g
                    w -= 0.05 * (state[j] / (1 - 0.9 ** t)) / (np.sqrt(second[j] / (1 - 0.99 ** t)) + 1e-8)

    @staticmethod
    def _views(shapes: list[str]) -> list[list[str]]:
        own = [shape_features(s) for s in shapes]
        near = [RUNS.sub(r"\1", s.split("\0")[0]) for s in shapes]
        return [[*f, "p" + (near[i - 1] if i else ""), "n" + (near[i + 1] if i + 1 < len(near) else "")] for i, f in enumerate(own)]

    def _coded(self, names: list[str], learn: bool = False) -> list[int]:
        if learn:
            return [self.names.setdefault(n, len(self.names)) for n in names]
        return [self.names[n] for n in names if n in self.names]

    def _gradient(self, coded, labels):
        """Of the mean negative log likelihood, with a little weight decay."""
        k, n, longest = len(STATES), len(coded), max(map(len, coded))
        emit = np.zeros((n, longest, k))
        live = np.zeros((n, longest), bool)
        for i, seq in enumerate(coded):
            for t, f in enumerate(seq):
                emit[i, t] = self.weights[f].sum(0)
            live[i, :len(seq)] = True

        def add(x, axis):
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = add(forward[:, t - 1, :, None] + self.transition[None], 1) + emit[:, t]
            forward[:, t] = np.where(live[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = add(self.transition[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = add(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        g_weights, g_transition = 1e-3 * self.weights, 1e-3 * self.transition
        g_weights, g_transition = g_weights.copy(), g_transition.copy()
        for t in range(1, longest):
            pair = np.exp(forward[:, t - 1, :, None] + self.transition[None] + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            g_transition += (pair * live[:, t, None, None]).sum(0) / n
        for i, (seq, want) in enumerate(zip(coded, labels)):
            for t, f in enumerate(seq):
                d = node[i, t].copy()
                d[want[t]] -= 1
                np.add.at(g_weights, f, d / n)
                if t:
                    g_transition[want[t - 1], want[t]] -= 1 / n
        return g_weights, g_transition

    def emissions(self, sequences: list[list[str]]) -> np.ndarray:
        """Scores of all words of the sequences, one after the other."""
        rows = []
        for shapes in sequences:
            near = [RUNS.sub(r"\1", s.split("\0")[0]) for s in shapes]
            for i, s in enumerate(shapes):
                rows.append(self._own(s) + self._one("p" + (near[i - 1] if i else "")) + self._one("n" + (near[i + 1] if i + 1 < len(near) else "")))
        return np.array(rows).reshape(-1, len(STATES))

    def _own(self, s: str) -> np.ndarray:
        got = self.cache.get(s)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.weights[self._coded(shape_features(s))].sum(0)
            if len(s) <= 256:   # longer shapes hardly come again
                self.cache[s] = got
        return got

    def _one(self, name: str) -> np.ndarray:
        at = self.names.get(name)
        return self.weights[at] if at is not None else np.zeros(len(STATES))


def windows(column: pa.Array):
    """For each row of a text column: (row, text, word windows); a window is a list of (start, end) in characters.

    Rows without a digit and an ``@`` are left out.
    """
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, bounds = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        marked = ((part >= 48) & (part < 58)) | (part == 64)
        if not marked.any():
            continue
        starts, ends, first = word_spans(part, bounds)
        total = np.concatenate(([0], np.cumsum(marked)))
        hot = np.flatnonzero(total[ends] > total[starts])
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        for r in np.unique(row[hot]).tolist():
            a, b = int(first[r]), int(first[r + 1])
            mine = hot[np.searchsorted(hot, a):np.searchsorted(hot, b)]
            near = np.zeros(b - a, bool)
            for k in range(-NEAR, NEAR + 1):
                near[np.clip(mine - a + k, 0, b - a - 1)] = True
            at = np.flatnonzero(near) + a
            base = chars[bounds[r]]
            spans = list(zip((chars[starts[at]] - base).tolist(), (chars[ends[at]] - base).tolist()))
            cuts = [0, *(np.flatnonzero(np.diff(at) > 1) + 1).tolist(), len(at)]
            yield lo + r, part[bounds[r]:bounds[r + 1]].tobytes().decode(), [spans[x:y] for x, y in zip(cuts, cuts[1:])]
    release()


def labelled_windows(docs: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[list[str], list[int]]]:
    """A table for a corpus without hand-made labels: (shapes, states) of the windows of a bounded sample of documents, labelled by the base."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text rlike '[0-9@]'")
    n = rows.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = sampled(rows, "doc_id", share).groupBy("doc_id").agg(F.min("text").alias("text")).select("text")

    def label(batches):
        for batch in batches:
            shapes, states = [], []
            for _, text, found in windows(batch.column(0)):
                base = base_spans(text)
                places = mixed(np.array([w[0][0] for w in found], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                for window in (found[k] for k in np.argsort(places, kind="stable")[:LABELLED_WINDOWS].tolist()):
                    shapes.append([shape(text[a:b]) for a, b in window])
                    states.append([next((k + 1 for s, k, e in base if s < b and e > a), 0) for a, b in window])
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], ["shapes", "states"])

    found = chosen.mapInArrow(label, "shapes array<string>, states array<int>").distinct().collect()
    return sorted((list(r.shapes), list(r.states)) for r in found)


#: Windows of a document that go into the labelled table at most, chosen by a hash of their place.
LABELLED_WINDOWS = 20


def find(column: pa.Array, field: Field):
    """(row, text, base spans, all spans) of the rows that may hold personal data."""
    held = list(windows(column))
    shapes = [[shape(text[a:b]) for a, b in w] for _, text, found in held for w in found]
    scores = field.emissions(shapes)
    scores[:, 0] += MARGIN
    first = np.concatenate(([0], np.cumsum([len(s) for s in shapes]))).astype(np.int64)
    labels, at = viterbi(scores, first, field.transition) if len(scores) else np.zeros(0, np.int16), 0
    for row, text, found in held:
        base = base_spans(text)
        added = []
        for w in found:
            states = labels[at:at + len(w)].tolist()
            at += len(w)
            k = 0
            while k < len(w):
                e = k
                while e + 1 < len(w) and states[e + 1] == states[k]:
                    e += 1
                if states[k]:
                    added.append((w[k][0], states[k] - 1, w[e][1]))
                k = e + 1
        yield row, text, base, sorted(base + [s for s in added if not any(b[0] < s[2] and s[0] < b[2] for b in base)])


def marked_windows(lines=None) -> list[tuple[list[str], list[int]]]:
    """(shapes, states) of the windows of lines marked by hand, (text, spans) each; without any, of this operator's own."""
    lines = examples() if lines is None else lines
    out = []
    for row, text, found in windows(pa.array([text for text, _ in lines], pa.string())):
        spans = lines[row][1]
        for w in found:
            out.append(([shape(text[a:b]) for a, b in w], [next((KINDS.index(k) + 1 for s, k, e in spans if s < b and e > a), 0) for a, b in w]))
    return out


def fit_field(labelled=None) -> Field:
    return Field(marked_windows() if labelled is None else labelled)


def private_spans(docs: DataFrame, labelled=None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (all), n_added of every row."""
    field = docs.sparkSession.sparkContext.broadcast(fit_field(labelled))   # features of a small table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = len(batch)
            counts, sha, spans, added = np.zeros((n, len(KINDS)), np.int64), [empty] * n, [""] * n, np.zeros(n, np.int64)
            for row, _, base, every in find(batch.column(1), field.value):
                for _, k, _ in base:
                    counts[row, k] += 1
                if base:
                    sha[row] = hashlib.sha256(named(base).encode()).hexdigest()
                spans[row], added[row] = named(every), len(every) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(sha), pa.array(spans), pa.array(added)],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in angle brackets."""
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def mask_private(docs: DataFrame, labelled=None) -> DataFrame:
    """All rows and columns, personal data in ``text`` replaced and ``n_chars``, where there is one, counted anew."""
    field = docs.sparkSession.sparkContext.broadcast(fit_field(labelled))
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            new = {row: masked(text, every) for row, text, _, every in find(batch.column(place), field.value) if every}
            columns = list(batch.columns)
            if new:
                texts = columns[place].to_pylist()
                sizes = columns[size].to_pylist() if size is not None else None
                for row, text in new.items():
                    texts[row] = text
                    if sizes is not None:
                        sizes[row] = len(text)
                columns[place] = pa.array(texts, columns[place].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_pii_field(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents."""
    return private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
