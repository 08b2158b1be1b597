"""The training-data operators against brute force, SQL, round trips and held-out accuracy, and on odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourglass.llm import (common, decontamination, katz, language, neighbours, ngram_jaccard, packing, private_data, quality, registry,
                           sequences, token_store, urls)
from hourglass.llm.components import components

SF_MID = "/root/testdata/sf0.01"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(k, n):
    return " ".join(WORDS[(k * 7 + i * i * (k + 3) + i) % len(WORDS)] + str((k * i) % 13) for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeats, ties and columns of clashing names."""
    rows = [(k, text(k, 30 + k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(40)]
    rows += [(100, text(5, 35), "en", "s0"), (101, text(5, 35).upper(), "en", None), (102, text(5, 35) + " more", "en", "s0")]
    rows += [(200, None, "en", None), (201, "", None, None), (202, " \n\t ", "de", "s1"), (203, "one two", "en", "s1"), (204, "ONE two", "en", "s1")]
    rows += [(None, text(9, 50), "en", "s0"), (None, None, None, None), (300, text(11, 20_000), "en", "s0"), (301, "é" * 3000 + " ß 1.2.3.4", "de", "s0")]
    rows += [(7, text(7, 37), "en", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("score", "bucket", "payload", "part", "rank", "token", "digest", "block_id", "length", "spans", "path"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


SPLIT = re.compile(common.WORD)


def lowered(t):
    return SPLIT.findall((t or "").translate(str.maketrans(common.UPPER, common.LOWER)))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf=SF_MID):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- helpers


def test_words_and_hashes_agree_with_python():
    import pyarrow as pa
    texts = ["a b", None, "", "  x\n", "Éa\tB\x0bc", "a", "long " * 900, "b"]
    got = [w for _, _, words, first in common.hashed_words(pa.array(texts)) for w in np.split(words, first[1:-1])]
    want = [lowered(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    seen = {}
    for g, w in zip(got, want):
        for h, word in zip(g.tolist(), w):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pack_round_trip():
    arrays = [np.arange(300, dtype=np.uint64) << np.uint64(40), np.array([True, False]), np.zeros(0), np.array([1.5, -2]), np.zeros(9, np.int32)]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all() and len(a) == len(b)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = [0, 3, 1, 5, 0, 4]
    first = np.concatenate(([0], np.cumsum(lengths)))
    scores, transition = rng.normal(size=(first[-1], 3)), rng.normal(size=(3, 3))
    got = sequences.viterbi(scores, first, transition)
    for a, b in zip(first, first[1:]):
        def value(path):
            return sum(scores[a + i, s] for i, s in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:]))
        assert not b > a or value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(b - a)))))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 11), (2, 1)] + [(50, k) for k in range(60, 99)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 11: 8, 50: 50, **{k: 50 for k in range(60, 99)}}
    assert components(links.where("false")).count() == 0


# --- 1 url templates

def test_urls_and_rules(spark):
    cases = [(1, "http://A.Example.org/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "x://example.org", "example.org", "", None, "allow"),
             (3, "http://b.org/en/1", "b.org", "/en/1", "org/", "allow"), (4, "https://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
             (5, None, "", "", None, "allow"), (6, "no scheme/de/", "", "", None, "allow"), (7, "http://u.com/de/x://y", "u.com", "/de/x://y", "com/de/", "block"),
             (8, "http://notcom/de/1", "notcom", "/de/1", None, "allow"), (9, "", "", "", None, "allow"), (5, None, "", "", None, "allow")]
    pages = spark.createDataFrame([(c[0], c[1], "x") for c in cases], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_urls(pages).collect())
    assert got == sorted((c[0], c[2], c[3], c[4] or "", c[5]) for c in cases)
    assert urls.judge_urls(pages.where("false")).count() == 0


def test_bad_templates_are_blocked(spark):
    """Labelled rows of one branch are bad: its unlabelled pages go, the other branch's stay."""
    rows = [(k, f"http://h.net/{'bad' if k % 2 else 'good'}/{k}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, bool(k % 2)) for k in range(200)], "page_id long, bad boolean")
    got = rows_of(urls.judge_urls(pages, rules=[], labels=labels))
    assert len(got) == 400 and all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)
    assert {r["template"] for r in got} == {"/bad/*", "/good/*"}


def test_a_bad_section_is_blocked_among_many(spark):
    """Ten sections of which one is bad, and two years of which one is: the wildcard takes the alike and unlabelled ones only."""
    rows = [(k, f"http://h.net/{'abcdefghij'[k % 10]}/{k}") for k in range(1000)] + [(k, f"http://y.net/{2019 + k % 2}/{k}") for k in range(1000, 1400)]
    rows += [(1400 + k, f"http://h.net/new{k}/x") for k in range(20)]
    bad = {k for k, u in rows if "/d/" in u or "/2020/" in u}
    labels = spark.createDataFrame([(k, k in bad) for k, _ in rows if k < 600 or 1000 <= k < 1200], "page_id long, bad boolean")
    got = rows_of(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[], labels=labels))
    assert len(got) == len(rows) and {r["page_id"] for r in got if r["verdict"] == "block"} == bad
    assert {r["template"] for r in got if r["page_id"] in bad} == {"/d/*", "/2020/*"}


def test_all_levels_of_a_path_count(spark):
    """What differs from the fifth segment on has branches of its own; a very long path alone takes no level each."""
    rows = [(k, f"http://h.net/a/b/c/d/{'spam' if k % 2 else 'ok'}/e/{'x' if k % 4 < 2 else 'y'}/{k}") for k in range(400)]
    rows += [(400, "http://h.net/a/b/c/d/" + "/".join(f"s{k}" for k in range(500))), (401, "http://h.net/a"), (402, "http://h.net")]
    labels = spark.createDataFrame([(k, bool(k % 2)) for k in range(200)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in rows_of(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[], labels=labels))}
    assert len(got) == 403 and {k for k, r in got.items() if r["verdict"] == "block"} == set(range(1, 400, 2))
    assert {r["template"] for k, r in got.items() if k < 400} == {f"/a/b/c/d/{a}/e/~/*" for a in ("spam", "ok")}
    assert got[400]["template"] == "/a/b/c/d/~/" + "/".join(f"s{k}" for k in range(1, 500)) and (got[401]["template"], got[402]["template"]) == ("/a", "")
    assert got[400]["purity"] < 0.8


def test_chance_does_not_empty_the_wildcard(spark):
    """Ids with three labelled pages of four bad, at random: their wildcard keeps that share, and new ids are not blocked."""
    rng = np.random.default_rng(8)
    rows = [(k, f"http://h.net/u{k // 2}/{k % 2}") for k in range(4000)]
    labels = spark.createDataFrame([(k, bool(rng.random() < 0.75)) for k in range(3600)], "page_id long, bad boolean")
    got = rows_of(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[], labels=labels))
    assert all(r["verdict"] == "allow" for r in got if r["page_id"] >= 3600)


# --- 2 Katz

def katz_brute(docs, train):
    end = object()
    seqs = [lowered(t) + [end] for t in docs]
    one, two = collections.Counter(), collections.Counter()
    for s, learn in zip(seqs, train):
        if learn:
            one.update(s)
            two.update(zip([end, *s[:-1]], s))

    def discounts(counts):
        total, distinct = sum(counts.values()), len(counts)
        hist = [sum(v == r for v in counts.values()) for r in range(1, katz.LARGEST + 2)]
        return katz.Discounts([*hist, total, distinct])

    d1, d2 = discounts(one), discounts(two)
    mass = lambda d, c: c * (d.d[c - 1] if c <= katz.LARGEST else 1.0)
    n = sum(one.values())
    freed = n - sum(mass(d1, c) for c in one.values())
    extra = 0 if freed > 1e-9 * n else 1
    p1 = {w: mass(d1, c) / (n + extra) for w, c in one.items()}
    unknown = (freed + extra) / (n + extra)
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c

    def p2(w, h):
        low = p1.get(w, unknown)
        if h not in after:
            return low
        total = one[h]
        held = sum(mass(d2, c) for c in after[h].values())
        more = 1 if total - held < 1e-9 * total else 0
        if w in after[h]:
            return mass(d2, after[h][w]) / (total + more)
        return (total + more - held) / (total + more) / (1 - sum(p1[x] for x in after[h])) * low

    for h in list(after)[:25]:   # exactly normalised over the vocabulary and the unknown word
        assert sum(p2(w, h) for w in one) + p2("never seen", h) == pytest.approx(1, abs=1e-9)
    return [sum(math.log10(p2(w, h)) for h, w in zip([end, *s[:-1]], s)) for s in seqs], one, seqs


def test_katz_equals_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 300)   # many buckets, so that some contexts are dealt over all of them
    docs = odd.where("doc_id is null or doc_id != 300")
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    crc = lambda i: zlib.crc32(str(i).encode() if i is not None else b"")
    want, one, seqs = katz_brute([t for _, t in source], [crc(i) % 7 != 2 for i, _ in source])
    got = rows_of(katz.katz_scores(docs, common.remainder("doc_id", 7) != 2))
    n, v = sum(one.values()), len(one)
    expect = sorted((str(i), crc(i) % 7 == 2, len(s), sum(one[w] > 0 for w in s), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s), 6), round(x, 6))
                    for (i, _), s, x in zip(source, seqs, want))
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert have == expect


def test_katz_orders_and_empty(spark, odd, none):
    assert katz.katz_scores(none, F.lit(True)).count() == 0
    score = [katz.katz_scores(odd, F.lit(True), order=k).agg(F.sum("score")).first()[0] for k in (1, 2, 3)]
    assert score[0] < score[1] <= score[2] + 1e-6


# --- 3 packing

def test_packing_equals_item_by_item(spark):
    rng = np.random.default_rng(0)
    sizes = (16, 32, 64)
    for _ in range(20):
        lengths = sorted(rng.choice([1, 2, 3, 5, 8, 13, 21, 33, 64], 200).tolist(), reverse=True)
        open_bins = []
        for n in lengths:
            fits = [(s - u, k) for k, (s, u) in enumerate(open_bins) if s - u >= n]
            k = min(fits)[1] if fits else len(open_bins)
            if not fits:
                open_bins.append([packing.opening_size(n, sizes), 0])
            open_bins[k][1] += n
        _, bins = packing.plan_bins(collections.Counter(lengths), sizes)
        assert [(s, u) for _, count, s, u in bins for _ in range(count)] == [tuple(b) for b in open_bins]


def test_packing_loses_and_overlaps_nothing(spark, odd, none):
    got = rows_of(packing.pack_lengths(packing.word_lengths(odd)))
    want = collections.Counter(len(lowered(r.text)) + 1 for r in odd.select("text").collect())
    whole = collections.defaultdict(list)
    assert sum(r["length"] for r in got) == sum(n * c for n, c in want.items())
    for r in got:
        whole[r["bin_id"]].append(r)
    for rows in whole.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["bin_used"] for r in rows} == {at} and {r["bin_capacity"] for r in rows} == {min(s for s in packing.SIZES if s >= at)}
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] == 300] == [4096 * k for k in range(5)]
    assert packing.pack_lengths(packing.word_lengths(none)).count() == 0


# --- 4 token files

def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5, 5, 5], np.sort(rng.integers(0, 10**6, 5000)).tolist(), [0, 10**12], [3] * 1000):
        ef, at = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, np.int64)).to_bytes())
        assert ef.all().tolist() == list(values)
        assert [ef.select(i) for i in range(0, len(values), 7)] == list(values)[::7]
    ef = token_store.EliasFano.of(np.sort(rng.integers(0, 10**6, 5000)))
    assert len(ef.to_bytes()) * 8 / 5000 < 3 + math.log2(10**6 / 5000) + 1


def test_token_files_round_trip(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    strange = spark.createDataFrame([(900, "İstanbul. it's they've a\x1cb x\u00a0y <|endoftext|> a<|endoftext|>b 'S ß. 日本語。 ﬁ, ª. ''d .a\u0301"), (-5, "Z z")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(strange)
    out = common.scratch_path(spark, "tokens-test")
    token_store.write_tokens(docs, open(path).read(), out)
    got = rows_of(token_store.read_tokens(spark, out))
    plain = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert last is None or (r["doc_id"] is not None and r["doc_id"] >= last)
        last = r["doc_id"]
    block = token_store.TokenBlock(bytes(spark.read.parquet(out).select("block").first()[0]))
    assert block.tokens(0)[-1] == 2
    out = common.scratch_path(spark, "tokens-test")
    token_store.write_tokens(none, open(path).read(), out)
    assert token_store.read_tokens(spark, out).count() == 0


# --- 5 languages

def test_languages_on_held_out_rows(spark):
    docs = documents(spark)
    got = language.identify(docs, common.remainder("doc_id", 4) != 2, spans=True)
    both = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in both) / len(both) > 0.97
    assert all(0 <= r.score <= 1 for r in both)
    mixed = spark.createDataFrame([(1, "The that with this reing and onthe. Der die und einenlich keit schung verlich nicht heit. 12 3")], "doc_id long, text string")
    model = docs.select("doc_id", "text", "lang").unionByName(mixed.withColumn("lang", F.lit(None).cast("string")))
    row = language.identify(model, F.col("lang").isNotNull(), spans=True).where("held_out").first()
    assert [s.lang for s in row.spans] == ["en", "de"]


def test_languages_of_odd_rows(spark, odd, none):
    got = collections.defaultdict(list)
    for r in language.identify(odd, F.lit(True), spans=True).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert all(got[k][0].lang_pred == "und" and got[k][0].score == 0 and not got[k][0].spans for k in (200, 201, 202))
    assert language.identify(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, F.lit(False)).collect()} == {"und"}
    kept = language.keep_languages(odd, F.lit(True))
    assert kept.columns == odd.columns and kept.count() == odd.where("text is not null and text rlike '[a-zA-Zé]'").count()


# --- 6 similarity join

def brute_groups(rows, width, percent):
    def shingles(t):
        w = lowered(t)
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted((str(i), len(s), str(min(least[find(k)]) if s and least[find(k)] else i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_similarity_groups_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_jaccard, "RUN_ROWS", 7)   # index lists in parts
    rng = np.random.default_rng(width * percent)
    base = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 120))] for _ in range(12)]
    rows = []
    for k in range(260):
        words = list(base[int(rng.integers(12)) if k % 3 else 0])
        for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
            at = int(rng.integers(len(words)))
            words[at:at + 1] = [[], ["new%d" % rng.integers(5)], [words[at], "x%d" % k]][int(rng.integers(3))]
        rows.append((k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a"), (5, rows[5][1]), (None, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard.similarity_groups(docs, width, percent).collect())
    assert got == brute_groups(rows, width, percent)


def test_similarity_of_odd_rows(spark, odd, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard.similarity_groups(odd).collect())
    assert got == brute_groups([(r.doc_id, r.text) for r in odd.collect()], 3, 90)
    assert ngram_jaccard.similarity_groups(none).count() == 0
    kept = ngram_jaccard.keep_one_of_each(odd)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i is not None) == sorted({
        int(c) for i, _, c in brute_groups([(r.doc_id, r.text) for r in odd.collect()], 5, 80) if i != "None"})
    assert ids.count(None) == 2


def test_similarity_join_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF_MID}/documents.parquet'")
    got = sorted(tuple(r) for r in ngram_jaccard.op6_ngram_jaccard(spark, SF_MID).collect())
    assert got == sorted(con.sql(registry.SQL["op6_ngram_jaccard"]).fetchall())


# --- 7 quality

def test_quality_on_held_out_rows(spark):
    sf = SF_MID.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op7_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = (np.array([r.score for r in got if r.quality == q]) for q in (1, 0))
    assert np.mean(good[:, None] > bad[None]) > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    labels = odd.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    got = quality.quality_scores(odd, labels, F.lit(True)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality_scores(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(odd, labels.where("quality = 1"), F.lit(True)).collect()} == {1.0}


# --- 8 neighbours

def test_neighbours_recall_and_order(spark):
    sf = SF_MID.replace("0.01", "0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    got = neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, probes=3).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = x @ x[ids == q][0]
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, score[part.vec_id], atol=1e-12) and list(part.score) == sorted(part.score, reverse=True)
        score[ids == q] = -np.inf
        hits += len(set(part.vec_id) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hits / len(got) > 0.85


def test_neighbours_of_odd_rows(spark):
    v = [0.5, 1.0, -1.0]
    rows = [(k, v) for k in range(45)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 1.0]),
                                          (180, [float("inf"), 1.0, 1.0]), (200, [1.0]), (220, [2.0, 0.0, 0.0]), (20, v), (None, v)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "vec_id long, embedding array<double>, score double")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    lists = collections.defaultdict(list)
    for r in got:
        lists[r.query_id].append((r["rank"], r.vec_id))
    assert sorted(lists) == [0, 20, 40, 220]
    assert [i for _, i in sorted(lists[0])] == [220, *range(1, 20)] or [i for _, i in sorted(lists[0])] == [*range(1, 21)]
    assert 20 not in [i for _, i in lists[20]]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


# --- 9 decontamination

def test_planted_items_are_found(spark):
    rng = np.random.default_rng(3)
    items = {k: [f"i{x}" for x in rng.integers(0, 5000, n)] for k, n in enumerate([1, 3, 6, 9, 15, 24, 40, 60] * 4)}
    docs, want = [], set()
    for d in range(300):
        words = [f"i{x}" if rng.random() < 0.2 else f"z{x}" for x in rng.integers(0, 5000, 120)]
        if d % 2:
            item = int(rng.integers(len(items)))
            cut, most = list(items[item]), int(0.2 * len(items[item]))
            for _ in range(int(rng.integers(0, most + 1)) if d % 4 == 1 else 0):
                cut[int(rng.integers(len(cut)))] = "edited"
            at = int(rng.integers(len(words)))
            words[at:at] = cut
            want.add((d, item))
        docs.append((d, "  ".join(w.upper() if d % 3 else w + "," for w in words)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    table = spark.createDataFrame(docs + [(None, None), (999, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, ""), (91, None)], "item_id long, text string")
    got = rows_of(decontamination.contaminated(table, bench))
    assert {(r["doc_id"], r["item_id"]) for r in got} >= want
    texts = dict(docs)
    for r in got:   # every find is one: the stated window is at the stated distance
        words = re.findall(r"[a-z0-9]+", texts[r["doc_id"]].lower())
        item = items[r["item_id"]]
        assert distance(words[r["start_word"]:r["start_word"] + len(item)], item) == r["distance"] <= int(0.2 * len(item))
    kept = decontamination.keep_uncontaminated(table, bench)
    assert kept.count() == len(docs) + 2 - len({r["doc_id"] for r in got})
    assert decontamination.contaminated(table, bench.where("false")).count() == 0
    assert decontamination.contaminated(table.where("false"), bench).count() == 0


def test_items_with_words_missing_or_added_are_found(spark):
    """At the largest distance: words deleted, inserted, or an end cut off, inside a text and as a document of its own."""
    rng = np.random.default_rng(12)
    items = [[f"i{x}" for x in rng.integers(0, 10**6, n)] for n in (6, 10, 24, 60) for _ in range(12)]
    docs = []
    for k, item in enumerate(items):
        most = int(0.2 * len(item))
        for kind in ("one", "tail", "head", "deleted", "inserted"):
            cut = {"one": item[:3] + item[4:], "tail": item[:-most], "head": item[most:]}.get(kind, list(item))
            for _ in range(most if kind in ("deleted", "inserted") else 0):
                at = int(rng.integers(len(cut)))
                cut[at:at + (kind == "deleted")] = [] if kind == "deleted" else [f"new{rng.integers(10**6)}"]
            for around in (0, 30):
                a, b = ([f"z{x}" for x in rng.integers(0, 10**6, around)] for _ in range(2))
                docs.append((len(docs), " ".join(a + cut + b), k, kind, 1 if kind == "one" else most))
    # one word too many cut off, also when another item's beginning is the next row
    over = [(10_000 + k, " ".join(item[int(0.2 * len(item)) + 1:])) for k, item in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([d[:2] for d in docs] + over, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows_of(decontamination.contaminated(table, bench))}
    assert {(d, k) for d, _, k, _, _ in docs} >= set(got)
    for kind in ("one", "tail", "head", "deleted", "inserted"):
        assert np.mean([(d, k) in got for d, _, k, x, _ in docs if x == kind]) >= 0.95, kind
    assert all(got[d, k] <= most for d, _, k, _, most in docs if (d, k) in got)
    assert decontamination.keep_uncontaminated(table, bench).count() == len(docs) + len(over) - len(got)


def test_keys_meet_at_the_largest_distance():
    rng = np.random.default_rng(5)
    for n in (10, 30, 60):
        a = rng.integers(0, 1 << 62, (500, n)).astype(np.uint64)
        b = a.copy()
        for r in b:
            r[rng.choice(n, int(0.2 * n), replace=False)] = rng.integers(0, 1 << 62, int(0.2 * n))
        assert (decontamination.keys(a) == decontamination.keys(b)).any(1).mean() >= 0.95
        assert (decontamination.edit_distances(a, b, int(0.2 * n))[0] <= int(0.2 * n)).all()


# --- 10 personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans():
    for t in ["a@b.c", "x@@a.b", "a@b.c@d.e", "@a.b a.@b.c. +@-.-", "..%a@b é@c.d zz@f.g.h@i.j", "a@b", "a@b.c.@d.e"]:
        assert [(a, b) for a, k, b in private_data.base_spans(t) if k == 0] == [m.span() for m in EMAIL.finditer(t)], t
    card = "4111 1111 1111 1111"
    assert private_data.base_spans(f"é {card}, 1.2.3.4 256.1.1.1 +1 (269) 555-3296 +") == [(2, 2, 21), (23, 1, 30), (41, 3, 58)]
    assert not private_data.base_spans("4111 1111 1111 1112, 1.2.3 555-3296")
    assert private_data.masked("a b c d", [(0, 0, 3), (2, 3, 5), (6, 1, 7)]) == "<EMAIL> <IP>"


def test_very_many_digits_are_no_address(spark):
    texts = ["1" * 5000 + ".1.1.1", "0" * 5000 + "1.2.3.04", "1.2.3." + "9" * 5000]
    assert [private_data.base_spans(t) for t in texts] == [[], [(0, 1, len(texts[1]))], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in private_data.private_spans(docs).collect()} == {0: 0, 1: 1, 2: 0}
    assert private_data.mask_private(docs).count() == 3


def test_private_data_rows(spark, none):
    docs = documents(spark)
    got = {r.doc_id: r for r in private_data.private_spans(docs).collect()}
    for r in docs.collect():
        base = private_data.base_spans(r.text)
        names = private_data.named(base)
        row = got[r.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert row.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(row.spans.split(","))
    masked = private_data.mask_private(docs)
    assert masked.columns == docs.columns
    assert all(not private_data.base_spans(r.text) and r.n_chars == len(r.text) for r in masked.collect())
    assert private_data.private_spans(none).count() == 0


def test_the_field_adds_what_the_patterns_miss(spark):
    """Trained on numbers with and without a plus sign, the field finds one that no pattern does."""
    table = []
    for k in range(60):
        words = ["call", f"({200 + k})", f"555-{1000 + k}", "now"]
        table.append(([private_data.shape(w) for w in words], [0, 4, 4, 0]))
        table.append(([private_data.shape(w) for w in ("page", str(k), "of", str(100 + k))], [0, 0, 0, 0]))
    docs = spark.createDataFrame([(1, "please call (312) 555-7788 today"), (2, "page 17 of 230"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_phone, r.n_added) for r in private_data.private_spans(docs, table).collect()}
    assert got == {1: ("phone:12:26", 0, 1), 2: ("", 0, 0), 3: ("", 0, 0)}


def test_the_field_sees_whole_words(spark):
    """What stands after the 64th character of a word counts."""
    path = "http//x/" + "ab-" * 30
    table = []
    for k in range(60):
        table.append(([private_data.shape(w) for w in ("see", f"{path}tel={3125550000 + k}", "now")], [0, 4, 0]))
        table.append(([private_data.shape(w) for w in ("see", f"{path}page={k + 10}", "now")], [0, 0, 0]))
    docs = spark.createDataFrame([(1, f"see {path}tel=3125557788 now"), (2, f"see {path}page=77 now")], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_added) for r in private_data.private_spans(docs, table).collect()}
    assert got == {1: (f"phone:4:{4 + len(path) + 14}", 1), 2: ("", 0)}


def test_labelled_windows_come_from_all_parts_of_a_text(spark):
    """Only the second half of a long text holds addresses; some of its windows are labelled."""
    gap = " word" * 20 + " "
    text = gap.join([f"page {k}" for k in range(100)] + [f"host 10.0.0.{k}" for k in range(100)])
    got = private_data.labelled_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert 0 < len(got) <= private_data.LABELLED_WINDOWS and any(any(states) for _, states in got) and not all(any(states) for _, states in got)


def test_private_data_of_odd_rows(spark, odd):
    got = private_data.private_spans(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: r.n_ip for r in got}[301] == 1
    assert private_data.mask_private(odd).count() == odd.count()


# --- pipeline

def test_pipeline_stages(spark, odd, none):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.stored(stage(spark, docs, SF_MID), "pipeline-test")
        assert new.columns == docs.columns and new.count() <= docs.count()
        docs = new
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_MID).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF_MID).count() == 0


def test_pipeline_equals_brute_force(spark):
    """Language by its score, groups and passages by brute force, masking by the base patterns; then all words are packed."""
    docs = documents(spark).where("n_chars < 6000")
    kept = {r.doc_id: r.text for r in language.identify(docs, F.lit(True)).where("lang_pred != 'und' and score >= 0.4").join(docs, "doc_id").collect()}
    groups = brute_groups(sorted(kept.items()), 5, 80)
    kept = {int(i): kept[int(i)] for i, _, c in groups if i == c}
    bench = [re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", r.text.lower()).strip() for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    clean = {i: t for i, t in kept.items() if not any(b in re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower()) for b in bench)}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.stored(stage(spark, out, SF_MID), "pipeline-test")
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == set(clean)
    assert sum(t != clean[i] for i, t in got.items()) == sum(bool(private_data.base_spans(t)) for t in clean.values())
    packed = corpus_pipeline.STAGES[4][1](spark, out, SF_MID)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(SPLIT.findall(t)) + 1 for t in got.values())


def test_queries_are_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
