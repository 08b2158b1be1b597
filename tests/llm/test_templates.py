"""The template tree against a recursion of one segment a step, and long shared paths in few rounds."""

import math
import random

import pytest

from hourglass.llm import urls


def brute_templates(rows, children, z, weight):
    """{(host, path): (template, purity)} of (host, path, known, bad) rows."""
    out = {}

    def walk(members, template, purity):
        kids = {}
        for host, path, segments, known, bad in members:
            if segments:
                kids.setdefault(segments[0], []).append((host, path, segments[1:], known, bad))
            else:
                out[host, path] = (template, purity)
        known = {s: sum(m[3] for m in ms) for s, ms in kids.items()}
        bad = {s: sum(m[4] for m in ms) for s, ms in kids.items()}
        every, blocked, labelled = sum(known.values()), sum(bad.values()), sum(k > 0 for k in known.values())
        strict = math.sqrt(z * z + 2 * math.log(max(labelled / children, 1)))
        variable = len(kids) >= children or (len(kids) >= 2 and all(any(c.isdigit() for c in s) for s in kids))
        nodes = {}
        for s, ms in kids.items():
            others, p = every - known[s], blocked / every if every else 0
            differs = (known[s] > 0 and others > 0 and 0 < blocked < every and abs(bad[s] / known[s] - (blocked - bad[s]) / others)
                       >= strict * math.sqrt(p * (1 - p) * (1 / known[s] + 1 / others)))
            name = s if differs else "*" if variable else s if len(kids) == 1 else "~"
            nodes.setdefault(name, []).extend(ms)
        for name, ms in nodes.items():
            walk(ms, f"{template}/{name}", (sum(m[4] for m in ms) + weight * purity) / (sum(m[3] for m in ms) + weight))

    overall = (sum(r[3] for r in rows) + 1) / (sum(r[2] for r in rows) + 2)
    for host in {r[0] for r in rows}:
        mine = [(h, p, [s for s in p.split("/") if s], k, b) for h, p, k, b in rows if h == host]
        walk(mine, "", (sum(m[4] for m in mine) + weight * overall) / (sum(m[3] for m in mine) + weight))
    return out


@pytest.mark.parametrize("seed, children, weight", [(1, 8, 8.0), (2, 3, 2.0), (3, 1, 8.0)])
def test_templates_equal_a_recursion(spark, seed, children, weight):
    rng = random.Random(seed)
    rows = {}
    for _ in range(700):
        host, depth = f"h{rng.randrange(3)}.net", rng.randrange(8)
        segments = ["shared", "way"] if host == "h0.net" and depth > 1 else []
        for level in range(depth):
            fixed = level in (1, 2, 5) and rng.random() < 0.98
            segments.append("same" if fixed else rng.choice(["spam", "ok", "new", *(f"id{k}" for k in range(rng.choice([2, 12])))]))
        path = "/" + "/".join(segments) + rng.choice(["", "/"])
        known = rng.randrange(4)
        rows[host, path] = (host, path, known, known if "spam" in segments else rng.randrange(known + 1) if rng.random() < 0.1 else 0)
    rows = [*rows.values(), ("alone.net", "/a/b//c", 2, 1), ("bare.net", "", 0, 0)]
    df = spark.createDataFrame([(h, p, 1, k, b) for h, p, k, b in rows], "host string, path string, n long, known long, bad long")
    got = {(r.host, r.path): (r.template, r.purity) for r in urls.path_templates(df, children, 1.96, weight).collect()}
    want = brute_templates(rows, children, 1.96, weight)
    assert got.keys() == want.keys() and len(got) == len(rows)
    for key, (template, purity) in want.items():
        assert got[key][0] == template and abs(got[key][1] - purity) < 1e-12, key


def test_shared_segments_take_no_round_each(spark, monkeypatch):
    """Two urls alike in 500 segments, and a third that leaves them half-way."""
    way, rounds, stored = "/".join(f"s{k}" for k in range(500)), [], urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    pages = spark.createDataFrame([(1, f"http://h.net/{way}/x"), (2, f"http://h.net/{way}/y"), (3, "http://h.net/" + "/".join(way.split("/")[:250]))], "page_id long, url string")
    got = {r.page_id: r.template for r in urls.judge_urls(pages, rules=[]).collect()}
    assert got == {1: f"/{way}/~", 2: f"/{way}/~", 3: "/" + "/".join(way.split("/")[:250])}
    assert len(rounds) <= 6
