"""Operators on conversations, URLs and vectors against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from heddle.llm import chat_format, topk_search, url_filter
from heddle.llm.common import cut, running_total
from heddle.llm.components import connected_components
from tests.llm.cases import with_clashes

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    r = random.Random(3)
    bits = ["hello", "</s>", "[INST]", "[/INST] ", "␛", "␛c", "␛e", "␛n", "<", "<|im_end|>\n", "<|im_sep|>", "é漢", "\n", " ", "<<SYS>>", "[", "<|im_start|>user\n"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(r.choice([1, 2, 5, 9])):
            text = "".join(r.choice(bits) for _ in range(r.randrange(6)))
            rows.append((conv, turn, r.choice(["user", "assistant", "assistant", "system", None, "odd\nrole"]), r.choice([text, text, None, ""])))
    rows += [(40, t, "assistant" if t % 3 else "user", "x" * (t % 50)) for t in range(700)]
    rows += [(41, 0, "user", "long " * 50_000), (42, 1, "user", "tie"), (42, 1, "user", "tie"), (42, 1, "assistant", "tie"), (42, None, "user", "no turn")]
    return rows


def test_chat_format_reads_back(spark):
    rows = conversations()
    df = with_clashes(spark.createDataFrame(rows, TURNS))
    chats = chat_format.format_chats(df)
    read = chats.select(
        "conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    assert len(read) == len({r[0] for r in rows})
    for r in read:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        groups = sum(i == 0 or (own[i - 1][2] or "") != (x[2] or "") for i, x in enumerate(own))
        assert r.formatted.count(chat_format.START) == groups == r.formatted.count(chat_format.END)
        inside = "".join(r.formatted[s.start : s.end] for s in r.loss_spans)
        assert not any(c in inside for c in chat_format.CONTROLS)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_running_total_and_cut(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        sizes = [(i * 7) % 11 for i in range(n)]
        df = spark.createDataFrame([(sizes,)], "x array<long>")
        assert df.select(running_total(F.col("x"))).first()[0] == [int(v) for v in np.cumsum([0, *sizes])[:-1][:n]]
    text = "".join(chr(200 + i % 300) for i in range(5000))
    spans = [(i * 9, i * 9 + i % 8) for i in range(500)]
    df = spark.createDataFrame([(text, spans), ("", [])], "t string, s array<struct<start:long,end:long>>")
    assert [r[0] for r in df.select(cut(F.col("t"), F.col("s"))).collect()] == [[text[a:b] for a, b in spans], []]


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
        tail = rest[stop:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if r[0] and r[1] is not None and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[0] + r[1], r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("shapes,broadcast", [(500, 100_000), (3, 100_000), (500, 2), (3, 2)])
def test_url_filter(spark, monkeypatch, shapes, broadcast):
    monkeypatch.setattr(url_filter, "MOST_SHAPES", shapes)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    r = random.Random(4)
    rules = [*url_filter.OP8_RULES, ("com", "", "block"), ("a.b.c", "/p", "allow"), ("c", "/path/x", "block"), ("dup.com", "/", "allow"), ("dup.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("x.org", None, "block"), ("m.ex", "ample.net/de/", "block"), ("example", "com", "block"), ("example.com/en", "/7", "block")]
    hosts = ["example.com", "EXAMPLE.com", "m.example.net", "a.b.c", "z.a.b.c", "x.org", "org", "ample.com", "dup.com", "ÄÖ.com", "a..com", "com.", "example.com:80", ""]
    paths = ["", "/", "/en/7", "/en/71/x", "/de/8", "/de/", "/es/", "/path/xyz", "/p?q=/en/", "#/en/", "?://x/en/", "/EN/", "/" + "a" * 5000]
    urls = [r.choice(["http://", "https://", "://", "", "ftp:/"]) + r.choice(hosts) + r.choice(paths) for _ in range(400)] + [None, "", "://", "x", "http://example.com\n/en/"]
    rows = [(r.choice([None, *range(50)]), u) for u in urls] + [(1, "http://example.com/en/7")] * 3
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string"))
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, url_filter.RULES_SCHEMA))
    key = lambda x: repr(x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *brute_verdict(u, rules)) for i, u in rows), key=key)
    none = spark.createDataFrame([], url_filter.RULES_SCHEMA)
    assert {x.verdict for x in url_filter.filter_urls(df, none, default="block").collect()} == {"block"}
    assert url_filter.filter_urls(df.limit(0), none).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 2])
def test_url_filter_of_long_urls_with_many_shapes(spark, monkeypatch, broadcast):
    """More than 500 shapes, a rule of 3,000 characters, URLs of 100,000 characters in host or path."""
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    path = "/" + "abc/" * 30_000
    rules = [("example.com", path[:n], "block" if n % 2 else "allow") for n in range(1, 600)] + [("example.com", path[:3000], "allow"), ("a.a", "", "block"), ("b", "/x", "block"), ("x.y." * 50 + "org", "/", "block")]
    rows = [
        (1, "http://example.com" + path[:100_000]), (2, "http://www.EXAMPLE.com" + path[:2500]), (3, "http://" + "a." * 50_000 + "a/abc"), (4, "http://" + "a." * 50_000 + "b/x" + "y" * 100_000),
        (5, "http://" + "h" * 100_000 + ".b/x"), (6, "http://" + "x.y." * 50 + "org/z"), (7, "http://" + "b" * 100_000), (8, "http://" + "." * 100_000), (None, None), (None, "http://example.com/a"), (9, ""),
    ]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, url_filter.RULES_SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *brute_verdict(u, rules)) for i, u in rows), key=repr)


def brute_search(rows, k):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in {(i, tuple(v)) for i, v in ok if i % 4 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("pivots,block", [(32, 4096), (3, 7), (1, 2)])
def test_topk_search(spark, pivots, block):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300, None), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (308, [float("nan")] * 6), (312, [float("inf")] * 6)]
    rows += [(316, [1.0, 2.0]), (317, [3.0, -1.0]), (None, rows[1][1]), (320, [0.0] * 6), (324, [1e5] * 6)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.search(df, lambda i: i % 4 == 0, k=5, n_pivots=pivots, block_rows=block)
    assert {tuple(x) for x in got.collect()} == brute_search(rows, 5)
    assert got.count() == len(brute_search(rows, 5))


def test_topk_search_empty_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e7, 1e7]), (1, [1e7, 1e7 + 1]), (2, [1e7, 1e7 - 1])], "vec_id long, embedding array<double>")
    got = topk_search.search(df, lambda i: i == 0, k=2).collect()
    assert {tuple(x) for x in got} == {x for x in brute_search([(r.vec_id, r.embedding) for r in df.collect()], 2)}
    assert topk_search.search(df.limit(0), lambda i: i == 0).count() == 0


def test_connected_components(spark):
    r = random.Random(7)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(x.node, x.component) for x in got.collect()} == {(x, find(x)) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("pivots,block", [(1, 4096), (4, 4096), (4, 64)])
def test_topk_search_fills_all_places_from_the_own_block(spark, pivots, block):
    r = np.random.default_rng(2)
    centres = 20 * np.eye(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)]  # equal
    rows += [(1000 + i, (centres[i % 4] + 0.05 * r.normal(size=4)).tolist()) for i in range(240)]  # tight clusters
    rows += [(1000, rows[130][1]), (1000, rows[134][1])]  # one id, several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk_search.search(df, lambda i: i % 4 == 0, n_pivots=pivots, block_rows=block).collect()]
    want = brute_search(rows, 20)
    assert set(got) == want and len(got) == len(want)


def test_best_of_block_has_k_rows_beside_the_own_one():
    data = pd.DataFrame({"id": np.arange(100), "v": [[1, 2]] * 100, "copies": 1})
    queries = pd.DataFrame({"query_id": [0, 50], "qhash": [1, 2], "qv": [[1, 2]] * 2})
    got = topk_search.best_of_block(queries, data, 20)
    assert sorted(got[got.query_id == 0].vec_id) == list(range(1, 21)) and sorted(got[got.query_id == 50].vec_id) == list(range(20))


@pytest.mark.parametrize("pivots", [2, 8, None])
def test_topk_search_of_clusters_with_repeats(spark, pivots):
    r = np.random.default_rng(3)
    rows = [(i, (c + 0.02 * r.normal(size=3)).tolist()) for i, c in enumerate(np.repeat([[30.0, 0, 0], [0, 30.0, 0]], 200, axis=0))]
    rows += [rows[8]] * 30 + [(12, rows[3][1])] * 25 + [(16, (np.array(rows[16][1]) + 0.01 * n).tolist()) for n in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk_search.search(df, lambda i: i % 4 == 0, n_pivots=pivots).collect()]
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in ok if i % 4 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def test_summaries_of_clusters_exclude_cells():
    r = np.random.default_rng(5)
    centres = 3000 * r.normal(size=(40, 8))
    points = np.floor(np.repeat(centres, 100, axis=0) + 5 * r.normal(size=(4000, 8)))
    near, distance = topk_search._nearest(points, centres)
    of = [np.flatnonzero(near == c) for c in range(40)]
    rows = [dict(cell=c, n=len(o), radius=distance[o].max(), norm=np.sqrt((points[o] ** 2).sum(axis=1)).max(), query_radius=distance[o].max()) for c, o in enumerate(of)]
    cells = topk_search._Cells([Row(**x) for x in rows], centres, 20, 1, 4096)
    assert cells.reach.mean() < 0.1
    scores = points @ points.T
    np.fill_diagonal(scores, -np.inf)
    kth = np.sort(scores, axis=1)[:, -20]
    assert (kth >= cells.floors[near]).all()
    needed = cells.needed(points, near, np.full(len(points), np.nan))
    assert needed.mean() < 0.1
    for q in range(0, len(points), 37):
        found = {near[x] for x in np.flatnonzero(scores[q] >= kth[q])}
        assert found <= set(np.flatnonzero(needed[q])) | {near[q]}


def test_of_a_cell_only_the_rows_that_a_group_needs_are_sent(spark, monkeypatch):
    """A shell of rows far out and many near the origin, in few cells: near ones cannot be among the best of any query."""
    r = np.random.default_rng(6)
    way = r.normal(size=(1200, 6))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    rows = [(i, (way[i] * (40 if i % 4 == 0 else 4 * r.random())).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counted, found = [], topk_search._sent

    def spy(targets, data):
        sent = found(targets, data)
        whole = data.join(targets.select("dim", "cell", "sub", "group").distinct(), ["dim", "cell", "sub"]).count()
        counted.append((sent.count(), whole))
        return sent

    monkeypatch.setattr(topk_search, "_sent", spy)
    got = topk_search.search(df, lambda i: i % 4 == 0, k=5, n_pivots=3)
    assert {tuple(x) for x in got.collect()} == brute_search(rows, 5)
    (home, all_home), (sent, whole) = counted
    assert home == all_home and 0 < sent < 0.5 * whole


def test_pivots_grow_with_the_rows():
    assert [topk_search.choose_pivots(n) for n in (0, 10_000, 1_000_000, 10**12)] == [32, 32, 125, 1024]
