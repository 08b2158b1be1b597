"""What is learned from all texts, from lines marked by hand, and how well: word vectors, calibration, the field's additions, base spans."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from hourglass.llm import private_data, quality
from hourglass.llm.private_examples import examples

TEXTS = [None, "", "   ", "one", "One two", "one two one two three", "é ü é\tü\nz", "a b " * 3000, "one two", None]


def brute_sums(texts):
    want = np.zeros((quality.SLOTS, quality.DIM), np.int64)
    for text in texts:
        data = (text or "").encode()
        slots, _ = quality._slots(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for a, b in zip(slots, slots[1:]):
            want[a] += quality.INDEX[b].astype(np.int64)
            want[b] += quality.INDEX[a].astype(np.int64)
    return want


def test_index_vectors_from_their_places():
    assert (np.abs(quality.INDEX).sum(1) <= quality.NONZERO).all() and (np.abs(quality.INDEX).sum(1) % 2 == quality.NONZERO % 2).all()
    assert quality.INDEX[7, quality.PLACES[7, 0]] != 0 or len(set(quality.PLACES[7])) < quality.NONZERO


@pytest.mark.parametrize("parts", [1, 7])
def test_word_vectors_come_from_all_texts(spark, parts):
    """The same sums in any split, equal to brute force; slots without a neighbour keep their index vector."""
    want = brute_sums(TEXTS).astype(float)
    size = np.linalg.norm(want, axis=1)
    want = np.where(size[:, None] > 0, want / np.maximum(size, 1e-9)[:, None], quality.INDEX / 2)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(parts)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)
    assert np.allclose(quality.word_vectors(docs.where("false")), quality.INDEX / 2)


def test_quality_is_calibrated(spark):
    """Held-out rows: in ten groups by score, the mean score and the share of label 1 differ by less than 0.1 on average."""
    sf = SF_MID.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op7_quality(spark, sf).where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "quality").collect()
    score, label = np.array([r.score for r in got]), np.array([r.quality for r in got], float)
    group = np.minimum((score * 10).astype(int), 9)
    gap = sum(abs(score[group == g].sum() - label[group == g].sum()) for g in range(10)) / len(score)
    assert len(score) > 500 and gap < 0.1


def by_rule(text):
    """The base's spans, straight from its statement."""
    out = []
    for kind, pattern, holds in (
            (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and private_data.luhn(re.sub("[^0-9]", "", m))),
            (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if holds(m.group())]
    return sorted(out)


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    seen = [0] * 4
    for _ in range(20_000):
        words = [rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "255.0.256.1", "9.8.7.6.5", "+1 (269) 555-3296", "+44", "a@b.c", "x.y@z",
                             "@", "+", ".", "-", " ", "  ", "7", "é", "(", ")", "12", "a", "5555555555554444", "\n"]) for _ in range(rng.randint(1, 9))]
        text = "".join(words) if rng.random() < 0.6 else " ".join(words)
        got = private_data.base_spans(text)
        assert got == by_rule(text), text
        for _, kind, _ in got:
            seen[kind] += 1
    assert min(seen) > 500


def test_luhn():
    assert private_data.luhn("4111111111111111") and private_data.luhn("79927398713") and not private_data.luhn("79927398710")


def test_marked_lines_hold_what_the_base_finds():
    """Every base span of the lines is marked with its kind, and half of the lines hold nothing."""
    lines = examples()
    for text, spans in lines:
        for a, kind, b in private_data.base_spans(text):
            assert any(k == private_data.KINDS[kind] and s <= a and b <= e for s, k, e in spans), text
    assert 0.4 < np.mean([not spans for _, spans in lines]) < 0.7 and all("[" not in text for text, _ in lines)


def added_spans(folds=5):
    """(hits, wrong, missed) of the spans that the field adds, each line by a field that has not seen it."""
    lines, hits, wrong, missed = examples(), 0, 0, 0
    for fold in range(folds):
        held = lines[fold::folds]
        field = private_data.Field(private_data.marked_windows([line for k, line in enumerate(lines) if k % folds != fold]))
        found = {row: (base, every) for row, _, base, every in private_data.find(pa.array([text for text, _ in held]), field)}
        for row, (_, spans) in enumerate(held):
            base, every = found.get(row, ([], []))
            hard = [(s, private_data.KINDS.index(k), e) for s, k, e in spans if not any(b[0] < e and s < b[2] for b in base)]
            added = set(every) - set(base)

            def meets(x, others):
                return any(y[1] == x[1] and y[0] < x[2] and x[0] < y[2] for y in others)

            hits += sum(meets(x, added) for x in hard)
            missed += sum(not meets(x, added) for x in hard)
            wrong += sum(not meets(x, hard) for x in added)
    return hits, wrong, missed


def test_what_the_field_adds_on_lines_it_has_not_seen():
    hits, wrong, missed = added_spans()
    assert hits + missed > 25 and hits / (hits + wrong) >= 0.9 and hits / (hits + missed) >= 0.7


def test_additions_by_the_marked_lines(spark):
    rows = [(1, "call (628) 555-0161 at once"), (2, "cards 4012888888881881 5500000000000004 on file"), (3, "order 9807915762804490 of page 12"),
            (4, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""), (None, "call (628) 555-0161 at once"), (6, None), (7, ""), (1, "licensed under CC BY-NC 4.0.")]
    got = [(r.doc_id, r.spans, r.n_card, r.n_phone, r.n_added)
           for r in private_data.private_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("other"))).collect()]
    want = [(1, "phone:5:19", 0, 0, 1), (2, "card:6:39", 0, 0, 1), (3, "", 0, 0, 0), (4, "", 0, 0, 0), (None, "phone:5:19", 0, 0, 1), (6, "", 0, 0, 0), (7, "", 0, 0, 0), (1, "", 0, 0, 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))
