"""Vector codes, WARC archives and whitening against brute force, SQL and round trips, and on odd rows."""

import gzip

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.llm import codes, warc, whitening

SF_MID = "/root/testdata/sf0.01"


def vectors(spark, rows, **columns):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def odd_rows(dim=8, n=60, seed=1):
    """Vectors with repeats, nulls, other lengths, null ids and labels."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(int(k), [float(v) for v in x[k]], int(k % 3)) for k in range(n)]
    rows += [(k, rows[k][1], None) for k in (3, 3, 5)] + [(None, rows[7][1], 1), (None, [0.5] * dim, None)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * (dim - 1) + [None], 1), (903, [float("nan")] * dim, 1), (904, [float("inf")] + [0.0] * (dim - 1), 2), (905, [1.0] * (dim + 1), 2)]
    return rows, bad


# --- 11 vector codes

def brute_codes(rows, parts, entries, rounds, scale=1024):
    """(code and error of each row in the order given, codebooks): every distance of every round, in Python integers."""
    x = np.floor(scale * np.array([r[1] for r in rows], float)).astype(np.int64)
    x = np.hstack([x, np.zeros((len(x), -x.shape[1] % parts), np.int64)]).reshape(len(x), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].reshape(-1).tolist()))
    books = x[order[:entries]].transpose(1, 0, 2).copy()

    def near():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        at, _ = near()
        for p in range(parts):
            for k in range(books.shape[1]):
                mine = x[at[:, p] == k, p]
                if len(mine):
                    books[p, k] = mine.sum(0) // len(mine)
    at, error = near()
    return [bytes(a.astype(np.uint8)).hex() for a in at], error.tolist(), books


@pytest.mark.parametrize("dim,entries,rounds", [(8, 16, 4), (10, 5, 3), (8, 200, 2), (4, 1, 1), (8, 16, 0)])
def test_codes_equal_brute_force_on_odd_rows(spark, dim, entries, rounds):
    good, bad = odd_rows(dim)
    got, books, _ = codes.encode(vectors(spark, good + bad, code="x", error=1, x=2, state="y", kind=3), entries=entries, rounds=rounds)
    code, error, want = brute_codes(good, 4, entries, rounds)
    assert (books == want).all()
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got.collect()], key=key) == sorted(
        [(r[0], None if r[2] is None else str(r[2]), c, e) for r, c, e in zip(good, code, error)], key=key)


def test_codes_of_many_rows_and_ties(spark):
    """Clusters, where the bounds settle most parts, and a grid, where many entries are equally near."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    clustered = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    grid = rng.integers(0, 2, (3000, 16)) / 1024
    for x, entries in ((clustered, 64), (grid, 16)):
        rows = [(k, [float(np.float32(v)) for v in x[k]], None) for k in range(len(x))]
        got, books, log = codes.encode(vectors(spark, rows).repartition(5), entries=entries)
        code, error, want = brute_codes(rows, 4, entries, 4)
        assert (books == want).all()
        assert [(r.code, r.error) for r in got.orderBy("vec_id").collect()] == list(zip(code, error))
        assert len(log) == 4
    rows = [(k, [float(np.float32(v)) for v in clustered[k]], None) for k in range(len(clustered))]
    _, _, log = codes.encode(vectors(spark, rows), entries=64)
    settled = sum(d[1] for d in log[-1].values()) / sum(sum(d) for d in log[-1].values())
    assert settled > 0.5   # nothing but the own entry was compared


def test_codes_of_large_entries_and_empty_tables(spark):
    rows = [(k, [float(k) * 1e5, -3.0, 2.0 ** 20, float(k % 2)], 1) for k in range(9)]
    got, books, _ = codes.encode(vectors(spark, rows), entries=3)
    code, error, want = brute_codes(rows, 4, 3, 4)
    assert (books == want).all() and [(r.code, r.error) for r in got.orderBy("vec_id").collect()] == list(zip(code, error))
    assert codes.encode(vectors(spark, rows).where("false"))[0].count() == 0
    assert codes.encode(vectors(spark, [(1, None, 1)]))[0].count() == 0
    with pytest.raises(ValueError):
        codes.encode(vectors(spark, rows), entries=257)


def test_codes_round_trip_and_half_bounds(spark):
    good, _ = odd_rows(8)
    got, books, _ = codes.encode(vectors(spark, good), entries=16)
    back = codes.decode(got, books).orderBy("vec_id", "error").collect()
    source = {}
    for r in good:
        source.setdefault(r[0], []).append(np.floor(1024 * np.array(r[1])))
    for r in back:
        assert min(abs(((v - 1024 * np.array(r.decoded)) ** 2).sum() - r.error) for v in source[r.vec_id]) < 1e-6
    x = np.random.default_rng(1).uniform(0, 70000, 1000)
    assert (codes.down(x) <= x).all() and np.isfinite(codes.down(np.array([np.inf]))).all()


def test_op11_equals_sql(spark):
    got = codes.op11_vector_codes(spark, SF_MID).toPandas().sort_values("vec_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_MID}/embeddings.parquet'")
    want = con.execute(codes.OP11_SQL).df().sort_values("vec_id").reset_index(drop=True)
    assert got[want.columns].equals(want) and len(got) == 500


# --- 12 WARC

MARK = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def page_rows():
    rows = [(k, f"http://a.org/{k}", f"<p>page {k % 7}</p>" + "é" * (k % 7)) for k in range(3, 40)]
    rows += [(100, None, None), (101, "http://b.org/ x\r\nX-Row-ID: 1", ""), (102, "http://b.org/", MARK), (2, "", MARK), (103, "http://c.org", "z" * 300_000)]
    rows += [(None, "http://d.org", "<p>page 1</p>é"), (None, None, "only here"), (7, "http://a.org/7", "<p>page 0</p>"), (7, "http://a.org/7", "<p>page 0</p>")]
    return rows + [(-5, "u", "neg"), (9_100_000_000_000_000_000, "u", "neg")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit("v")).withColumn("kind", F.lit("k")).withColumn("place", F.lit(1))


def expected(rows, min_bytes=0):
    """Brute force: (row id, bytes, digest, kind, refers to), sorted."""
    groups = {}
    for id_, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(id_)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            revisit = k and len(payload) >= min_bytes
            out.append((i, len(payload), warc.payload_digest(payload), "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 14, 10 ** 9])
def test_archives_equal_brute_force_on_odd_rows(spark, tmp_path, monkeypatch, min_bytes):
    if min_bytes:
        monkeypatch.setattr(warc, "SENT_ROWS", 0)   # decisions meet archives by name
    rows = page_rows()
    warc.write_archives(pages(spark, rows).repartition(3), f"file://{tmp_path}/raw", archive_bytes=4000)
    warc.deduplicate(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/new", min_bytes, archive_bytes=3000)
    got = warc.read_records(spark, f"file://{tmp_path}/new").collect()
    assert sorted([(r.row_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_row) for r in got], key=str) == expected(rows, min_bytes)
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(rows)
    for r in got:   # a revisit's reference is a response of the same payload
        if r.kind == "revisit":
            assert by_id[r.refers_to].kind == "response" and by_id[r.refers_to].payload_digest == r.payload_digest
    full = warc.restored(spark, f"file://{tmp_path}/new").collect()
    assert sorted((str(r.row_id), bytes(r.payload)) for r in full) == sorted((str(i), (h or "").encode()) for i, _, h in rows)
    assert all(warc.payload_digest(bytes(r.payload)) == r.payload_digest for r in full)
    old = {r.record_id for r in warc.read_records(spark, f"file://{tmp_path}/raw").collect()}
    assert not old & set(by_id)


def test_a_second_pass_keeps_revisits(spark, tmp_path):
    rows = page_rows()
    for source, target in ((None, "a"), ("a", "b"), ("b", "c")):
        if source is None:
            warc.write_archives(pages(spark, rows), f"{tmp_path}/{target}")
        else:
            warc.deduplicate(spark, f"{tmp_path}/{source}", f"{tmp_path}/{target}")
    got = warc.restored(spark, f"{tmp_path}/c").collect()
    assert sorted((str(r.row_id), bytes(r.payload)) for r in got) == sorted((str(i), (h or "").encode()) for i, _, h in rows)
    assert sorted([(r.row_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_row) for r in got], key=str) == expected(rows)


def test_foreign_archives(spark, tmp_path):
    """Plain files, a gzip member for each record, other record types, no digest, no HTTP head."""
    parts = [warc.record("warcinfo", [("Content-Type", "application/warc-fields")], b"software: x\r\n"),
             warc.record("response", [("WARC-Record-ID", "<urn:1>"), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"),
             warc.record("response", [("WARC-Record-ID", "<urn:2>"), ("Content-Type", "text/plain")], b"body")]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(p + warc.END) for p in parts))
    (folder / "b.warc").write_bytes(b"".join(p + warc.END for p in parts[:2]))
    got = sorted(warc.read_records(spark, str(folder), payloads=True).collect(), key=lambda r: (r.archive, r.place))
    assert [(r.record_id, bytes(r.payload), r.payload_bytes, r.row_id) for r in got] == [("urn:1", b"body", 4, None), ("urn:2", b"body", 4, None), ("urn:1", b"body", 4, None)]
    assert {r.payload_digest for r in got} == {warc.payload_digest(b"body")}


def test_archive_files_are_bounded_and_gzipped(spark, tmp_path):
    warc.write_archives(pages(spark, page_rows()).coalesce(1), f"{tmp_path}/raw", archive_bytes=2000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "raw").glob("part-*")]
    assert len(sizes) > 5 and sum(s > 2000 + 4 for s in sizes) == 1   # the long page alone
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in (tmp_path / "raw").glob("part-*"))


def test_op12_equals_sql(spark, tmp_path):
    warc.write_archives(pages(spark, page_rows()).where("false"), f"{tmp_path}/none")
    warc.deduplicate(spark, f"{tmp_path}/none", f"{tmp_path}/none2")
    assert warc.read_records(spark, f"{tmp_path}/none2").count() == 0
    rows = pd.DataFrame(page_rows(), columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    folder = tmp_path / "sf"
    folder.mkdir()
    rows.to_parquet(folder / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.execute(warc.OP12_SQL).fetchall()
    got = [tuple(r) for r in warc.op12_warc_revisits(spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


# --- 13 whitening

def brute_whitening(rows, components=16):
    """(x, n, S, whitened, eigenvalues, trace) by the covariance's eigenvectors."""
    x = np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    a = (n * fit - s) / n
    values, w = np.linalg.eigh(a.T @ a / n)
    values, w = values[::-1], w[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum())) if n > 1 else 0
    return x, n, s, ((n * x - s) / n) @ (w[:, :k] / np.sqrt(values[:k])), values[:k], values.sum()


def check_whitening(spark, good, bad, components=16):
    frame, dim = whitening.whole_vectors(vectors(spark, good + bad, n=1, x=2, component=3, whitened="w").repartition(3))
    model = whitening.fit_whitening(frame, dim, components)
    got = whitening.whitened(frame, dim, model).toPandas()
    x, n, s, w, values, trace = brute_whitening(good, components)
    k = len(values)
    assert len(got) == len(good) * k
    if not k:
        return
    assert (got.n == n).all() and got.identity_error.iloc[0] < 1e-9
    deviation = ((n * x - s) ** 2).sum(1)
    def of(frame_ids, deviations, values):
        return sorted(zip([str(i) for i in frame_ids], deviations, map(tuple, np.round(np.abs(values), 6))))
    rows = got.groupby(np.arange(len(got)) // k)
    assert (got.component.to_numpy().reshape(-1, k) == np.arange(1, k + 1)).all()
    ids = [None if pd.isna(v) else int(v) for v in rows.vec_id.first()]
    mine = of(ids, rows.deviation.first().tolist(), got.whitened.to_numpy().reshape(-1, k))
    want = of([r[0] for r in good], deviation.tolist(), w)
    assert [m[:2] for m in mine] == [v[:2] for v in want]
    assert np.allclose([m[2] for m in mine], [v[2] for v in want], atol=3e-6)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k)[0], values / trace, rtol=1e-9)


def test_whitening_equals_eigenvectors_on_odd_rows(spark):
    good, bad = odd_rows(8, 60)
    check_whitening(spark, good, bad)
    check_whitening(spark, good, bad, components=3)


def test_whitening_without_full_rank(spark):
    good, _ = odd_rows(6, 40)
    flat = [(i, [*v[:4], 2.5, v[0] + 0.0], label) for i, v, label in good]   # a constant dimension and a repeated one
    check_whitening(spark, flat, [])
    check_whitening(spark, flat[:3], [])                                      # fewer rows than dimensions
    check_whitening(spark, [flat[0], flat[0]], [])                            # nothing varies
    frame, dim = whitening.whole_vectors(vectors(spark, flat).where("false"))
    assert whitening.whitened(frame, dim, whitening.fit_whitening(frame, dim)).count() == 0


def test_whitening_of_ill_conditioned_rows(spark):
    """Directions 10^4 apart in spread, far from the origin: beyond what the covariance's own factor would bear."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * [3e3, 1e3, 300, 30, 3, 0.3]
    mixed = x @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    check_whitening(spark, [(k, [float(np.float32(v)) for v in r], 0) for k, r in enumerate(mixed)], [], components=6)


def test_op13_on_the_whole_table(spark):
    table = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()
    got = whitening.op13_embedding_whitening(spark, SF_MID).toPandas().sort_values(["vec_id", "component"])
    _, n, _, w, values, trace = brute_whitening([(r.vec_id, r.embedding) for r in table])
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(mine * np.sign((mine * w).sum(0)), w, atol=1e-9) and (got.n == n).all() and got.identity_error.max() < 1e-10
