"""Links through rows without an id, texts that share one, samples at any size, long inputs, letters by code point, token runs."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups

from hourglass.llm import common, decontamination, language, neighbours, ngram_jaccard, private_data, quality, token_store


def chain(k, n=60, moved=2):
    """Texts of which neighbours are alike (95 %) and others are not."""
    return " ".join(f"word{i + k * moved}" for i in range(n))


def rows_of_groups(rows, got):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_groups(rows, 3, 90)


def test_links_through_rows_without_an_id(spark):
    rows = [(5, chain(0)), (None, chain(1)), (3, chain(2)), (None, chain(3)), (None, chain(4)), (8, chain(5)), (None, "alone in the world of words"), (None, None)]
    assert rows_of_groups(rows, ngram_jaccard.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    only = [(None, chain(0)), (None, chain(1))]
    assert rows_of_groups(only, ngram_jaccard.similarity_groups(spark.createDataFrame(only, "doc_id long, text string")).collect())


def brute_kept(rows, percent=80, width=5):
    """One row of each group: the least (no id, id, hash of text); rows equal in id and text once."""
    texts = [r[:2] for r in dict.fromkeys((i, t, h) for i, t, h in rows)]
    hashes = {(i, t): h for i, t, h in rows}
    sets = []
    for _, t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k, (i, t) in enumerate(texts):
        key = (i is None, i or 0, hashes[i, t])
        g = find(k) if sets[k] else ("empty", k)
        best[g] = min(best.get(g, (key, k)), (key, k))
    return sorted(str(texts[k]) for _, k in best.values())


def test_texts_that_share_an_id_are_kept(spark):
    rows = [(1, chain(0, 80)), (1, chain(500, 40)), (1, chain(1, 80)), (2, chain(500, 40)), (2, chain(900, 30)), (2, chain(900, 30)), (None, chain(900, 30)),
            (None, chain(2000, 50)), (None, chain(2001, 50, 1)), (None, chain(2000, 50)), (4, ""), (4, ""), (4, None), (None, None), (7, chain(900, 30).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("rows", F.lit(1)).repartition(3)
    hashed = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    got = ngram_jaccard.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == brute_kept(hashed)


def test_samples_do_not_round_to_nothing(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    for share in (0.2, 0.01):
        assert common.sampled(ids, "doc_id", share).count() == pytest.approx(200_000 * share, rel=0.1)
    assert common.sampled(ids, "doc_id", 1.0).count() == 200_000
    # as for a table of 10^11 rows, of which 20,000 are taken: the bound is far from nothing
    text = common.sampled(ids, "doc_id", 20_000 / 1e11)._jdf.queryExecution().optimizedPlan().toString()
    assert str(int(20_000 / 1e11 * 2.0 ** 63)) in text and int(20_000 / 1e11 * 2.0 ** 63) > 10 ** 12


def test_quotas_deal_a_bound_evenly():
    assert common.quota([100, 100], 1000) == 100 and common.quota([], 5) == 0
    assert common.quota([10 ** 9, 10 ** 9, 30], 1030) == 500
    assert common.quota([5, 5, 5, 5], 4) == 1


def test_rare_languages_stay_in_the_model(spark):
    words = {"aa": "mano pane vino", "bb": "hund katze maus", "rare": "zyx qwv xkz"}
    rows = [(k, f"{words['aa' if k % 2 else 'bb']} {k % 7}", "aa" if k % 2 else "bb") for k in range(4000)] + [(5000 + k, words["rare"], "rare") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.lit(True), fit_rows=60)
    assert model.names == ["aa", "bb", "rare"]
    assert model.predict(pa.array(["qwv zyx"]))[0] == ["rare"]
    assert language.fit_languages(docs.where("false"), F.lit(True)).names == []


def test_letters_are_counted_not_bytes(spark):
    word, script = language._letters(np.frombuffer("aé—😀Ω नमस्ते ไทย x7́ß".encode(), np.uint8))
    text = "aé—😀Ω नमस्ते ไทย x7́ß"
    assert int((script > 0).sum()) == sum(c.isalpha() for c in text)
    latin, cyrillic = "the house and the tree", "дом и дерево стоят"
    rows = [(k, latin if k % 2 else cyrillic, "en" if k % 2 else "ru") for k in range(40)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    mixed = latin + " " + latin + " " + cyrillic   # more Latin letters, but fewer bytes of them than twice the others
    names, scores, spans = model.predict(pa.array([mixed, "— … 😀", "123", None]), spans=True)
    letters = [sum(c.isalpha() for c in x) for x in (latin + latin, cyrillic)]
    assert names == ["en", "und", "und", "und"] and scores[0] == pytest.approx(letters[0] / sum(letters)) and scores[1:] == [0, 0, 0]
    assert [mixed[s["start"]:s["end"]] for s in spans[0]] == [latin + " " + latin, cyrillic]


def test_long_items_and_digits_take_no_long_time():
    item = [f"w{(i * 7919) % 5003}" for i in range(200)]
    words = [x for _, _, x, _ in common.hashed_words(pa.array([" ".join(item)]), True, decontamination.SEPARATORS)][0]
    index = decontamination.ItemIndex([1], [words], 0.2)
    for edited in (item[:100] + ["other"] + item[101:], item[:50] + item[60:], item[:30] + ["x", "y", "z"] + item[30:]):
        start = time.time()
        found = index.search(pa.array([" ".join(["before"] * 7 + edited + ["after"] * 9)]))
        assert time.time() - start < 5
        assert list(found.values()) == [({200: 1, 201: 1, 190: 10, 203: 3}[len(edited)], 7)]
    start = time.time()
    assert private_data.base_spans("1" * 1_000_000) == [] and private_data.base_spans("7." * 3 + "8" * 200_000) == []
    assert time.time() - start < 10
    assert private_data.base_spans("a 1.2.3.4.5.6.7.8 999.1.1.1.1") == [(2, 1, 9), (10, 1, 17)]


def test_edit_tables_equal_brute_force():
    def brute(a, b, slack):
        best = (10 ** 9, 0)
        for start in range(slack + 1):
            rest = b[start:]
            row = list(range(len(rest) + 1))
            for x in a:
                new = [row[0] + 1]
                for j, y in enumerate(rest):
                    new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
                row = new
            best = min(best, (min(row), start))
        return best

    rng = np.random.default_rng(0)
    for _ in range(200):
        n, most = int(rng.integers(1, 12)), int(rng.integers(0, 4))
        a, b = rng.integers(0, 4, (3, n)).astype(np.uint64), rng.integers(0, 4, (3, n + 3 * most)).astype(np.uint64)
        at = int(rng.integers(0, 2 * most + 1))
        b[0, at:at + n] = a[0, :b.shape[1] - at]
        for x, y, d, s in zip(a.tolist(), b.tolist(), *decontamination.edit_distances(a, b, most, 2 * most)):
            want = brute(x, y, 2 * most)
            assert (d, s) == want if want[0] <= most else d > most


def test_runs_encode_like_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    encoder, whole = token_store.WordEncoder(model), Tokenizer.from_str(model)
    rnd = random.Random(1)
    signs = list("aBz é'ßΣσİ1²٣…—.,*́ ﬁ字かナ한하‍😀\x1c\x85\t#$_-<|>")
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["don't We'll 's It'S <|endoftext|> x<|startoftext|>Y <|ENDOFTEXT|>", " ", "", None, "a" * 3000 + "12" * 300]
    data, offsets = common.text_bytes(pa.array(texts))
    for _ in range(2):   # the second time all is known
        for lo, hi in common.pieces(offsets, 5000):
            part = data[offsets[lo]:offsets[hi]]
            starts, ends, first = common.word_spans(part, offsets[lo:hi + 1] - offsets[lo])
            ids, count = encoder(part, starts, ends)
            at = np.concatenate(([0], np.cumsum(count)))[first]
            for i in range(lo, hi):
                assert ids[at[i - lo]:at[i - lo + 1]].tolist() == whole.encode(texts[i] or "", add_special_tokens=False).ids, texts[i]


def test_numbers_and_selected_ranges():
    rng = np.random.default_rng(1)
    numbers, known = token_store.Numbers(8), {}
    for _ in range(30):
        new = np.setdiff1d(rng.integers(0, 2 ** 63, 400).astype(np.uint64) >> np.uint64(int(rng.integers(0, 50))), np.array(list(known), np.uint64))
        for h in new.tolist():
            known[h] = len(known)
        numbers.add(new)
        asked = np.concatenate([rng.choice(np.array(list(known), np.uint64), 300), rng.integers(0, 2 ** 62, 50).astype(np.uint64)])
        assert numbers.get(asked).tolist() == [known.get(h, -1) for h in asked.tolist()]
    values = np.sort(rng.integers(0, 10 ** 6, 3000))
    packed, _ = token_store.EliasFano.from_bytes(token_store.EliasFano.of(values).to_bytes())
    for a, b in [(0, 0), (0, 3000), (255, 257), (256, 512), (2999, 3000), (700, 1900)]:
        assert packed.select_range(a, b).tolist() == values[a:b].tolist()
    with pytest.raises(IndexError):
        packed.select_range(5, 3001)


def test_pooled_features_equal_word_by_word():
    texts = ["One two two, three!", "", None, "a", "x " * 9000, "Zwei 22 zwei 22"]
    vectors = np.random.default_rng(0).normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    x = np.concatenate([f for _, _, f in quality.features(pa.array(texts), vectors)])
    for k, t in enumerate(texts):
        data, offsets = common.text_bytes(pa.array([t]))
        slots, shapes, _, words = quality._read(data, offsets)
        want = np.zeros(2 * quality.DIM) if not len(slots) else np.concatenate([vectors[slots].mean(0, dtype=float), quality.SHAPE_INDEX[shapes].mean(0)])
        assert np.allclose(x[k, :2 * quality.DIM], want, atol=1e-4)
        assert x[k, -2] == pytest.approx(len(set(words.tolist())) / max(1, len(words)))


def test_op6_sql_takes_rows_without_an_id(spark, tmp_path):
    """The registered statement agrees where ids are there."""
    rows = [(k, chain(k % 4)) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in ngram_jaccard.op6_ngram_jaccard(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ngram_jaccard.OP6_SQL).fetchall())


# --- neighbours with the registered settings

def clustered(n, dim=32, centres=60, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dim))


def recall_and_share(spark, x, ids, **settings):
    """(recall, share of rows compared, rows found for each query) of a search against brute force."""
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>").repartition(8)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, **settings).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    hits = 0
    for q in asked:
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[:20]])
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, score[np.searchsorted(ids, mine.vec_id)], atol=1e-9)
        hits += len(true & set(mine.vec_id))
    rows, dim = neighbours.usable(df)
    index = neighbours.fit_partition(rows, dim, len(x))
    placed = spark.createDataFrame([(int(i), int(p), r.tobytes()) for i, p, r in zip(ids, index.home(x), x)], neighbours.FORM)
    probes = neighbours.measured_probes(placed, index, dim, len(x), 20)
    sizes = np.bincount(index.home(x), minlength=index.parts)
    share = sizes[index.order(x[asked], probes)].sum(1).mean() / len(x)
    return hits / (20 * len(asked)), share, index.parts


@pytest.mark.parametrize("n", [6_000, 24_000])
def test_neighbours_prune_clustered_vectors(spark, n):
    recall, share, parts = recall_and_share(spark, clustered(n), np.arange(n))
    assert recall >= 0.9 and share <= 0.3 and parts >= n / 2000


def test_neighbours_of_random_vectors_reach_recall(spark):
    recall, _, _ = recall_and_share(spark, np.random.default_rng(1).normal(size=(3000, 32)), np.arange(3000))
    assert recall >= 0.9


def test_neighbours_fill_up_from_other_parts(spark):
    x = clustered(3000, centres=40)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, probes=1, part_rows=30).groupBy("query_id").count().collect()
    assert len(got) == 30 and all(r["count"] == 20 for r in got)
