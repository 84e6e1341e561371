"""Operators on embeddings and pages, against brute force, with the odd cases of every table."""

import math

import numpy as np
import pytest

from txrisk.llm import ann, collisions, url_filter

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, score string, rank int, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", 1, 2) for i, v, lab in rows], EMBEDDINGS)


def clustered(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[: n // 3] = x[0] + 0.03 * rng.standard_normal((n // 3, d))  # a large group of near copies
    for k in range(n // 3, n // 2):  # pairs on both sides of the threshold
        x[k] = x[k + n // 4] + rng.uniform(0.1, 0.6) * rng.standard_normal(d)
    x[-3:] = x[-4]
    return x.astype(np.float32)


ODD = [(9_000, None, 1), (9_001, [0.0] * 16, 1), (9_002, [1.0] * 15 + [None], 1), (9_003, [float("nan")] * 16, 1), (9_004, [float("inf")] * 16, 1), (9_005, [], 1)]


@pytest.mark.parametrize("cell", [10_000, 40])
def test_near_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(collisions, "CELL", cell)
    monkeypatch.setattr(collisions, "BLOCK", cell)
    x = clustered()
    lab = np.array([k % 5 // 4 for k in range(len(x))])
    rows = [(i, x[i], None if i % 50 == 7 else int(lab[i])) for i in range(len(x))]
    got = {r["vec_id"]: r for r in collisions.near_vectors(table(spark, rows + ODD)).collect()}
    assert len(got) == len(rows) + len(ODD)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([-1 if i % 50 == 7 else lab[i] for i in range(len(x))])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & (label >= 0)[:, None]
    np.fill_diagonal(near, False)
    top = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(top[i], *top[near[i]]) if near[i].any() else top[i] for i in range(len(x))])
        if (new == top).all():
            break
        top = new
    assert near.sum() > 1000
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), top[i], top[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in ODD)


def test_near_vectors_of_odd_tables(spark):
    assert collisions.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in collisions.near_vectors(table(spark, ODD[:1])).collect()] == [(9_000, 0, 9_000, True)]
    big = 2**60 + 1
    same = table(spark, [(big, [1, 2], 1), (big + 2, [2, 4], 1), (None, [1, 2], 1), (big, [1, 2], 1), (5, [1, 2, 3], 1)])
    got = sorted(collisions.near_vectors(same).collect(), key=lambda r: r["vec_id"] or 0)
    assert [r["n_links"] for r in got] == [3, 0, 3, 3, 3]
    assert {r["component_id"] for r in got if r["vec_id"] != 5} == {big}


def test_calibration_keeps_pairs_at_the_threshold():
    angle = math.acos(0.93)
    window, least = collisions.least_collisions(64, angle, 32)
    axes, rng = collisions.orthogonal(64, 32), np.random.default_rng(2)
    a = collisions.unit(rng.standard_normal((4000, 64)))
    b = at_cosine(a, 0.93, rng)
    assert ((np.abs((a - b) @ axes) <= window).sum(1) >= least).mean() > 0.999
    c = collisions.Cells(64, angle, 10**6)
    k = np.full(4000, c.k)
    met = np.any([c.of(a, k, r) == c.of(b, k, r) for r in range(1, c.rounds + 1)], 0)
    assert c.k > 4 and met.mean() > 0.998


def at_cosine(a, cosine, rng):
    b = rng.standard_normal(a.shape)
    b = collisions.unit(b - (a * b).sum(1, keepdims=True) * a)
    return cosine * a + math.sin(math.acos(cosine)) * b


@pytest.mark.parametrize("radius", [0.0, 0.1])
def test_only_the_count_rejects_pairs(radius):
    angle, rng, n = math.acos(0.93), np.random.default_rng(4), collisions.PROJECTIONS
    window, least = collisions.least_collisions(64, angle, n)
    a = collisions.unit(rng.standard_normal((2000, 64)))
    b = at_cosine(a, math.cos(math.acos(0.9301) + 2 * radius), rng)
    p = collisions.projected(np.concatenate([a, b]), collisions.orthogonal(64, n), window)
    wide = math.ceil(2 * math.sin(angle / 2 + radius) * collisions.STEPS / (2 * math.sin(angle / 2))) + 1
    counted = (np.abs(p[:2000].astype(int) - p[2000:].astype(int)) <= wide).sum(1) >= least
    got = collisions.collisions(p, np.full(4000, radius), angle, window, least)
    found = {tuple(sorted(x)) for x in got.tolist()}
    assert len(found) == len(got) and counted.mean() > 0.999
    assert {(int(i), int(i) + 2000) for i in np.flatnonzero(counted)} <= found


def test_planted_links_under_default_parameters(spark):
    rng = np.random.default_rng(12)
    x = collisions.unit(rng.standard_normal((6000, 32)))
    x[1000:1300] = at_cosine(x[:300], 0.9305, rng)
    x[2000:2300] = at_cosine(x[300:600], 0.97, rng)
    x[3000:3600] = collisions.unit(x[3000] + 0.06 * rng.standard_normal((600, 32)))  # near copies about a centre: linked, ringed and apart
    x = x.astype(np.float32)
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_vectors(table(spark, [(i, v, 1) for i, v in enumerate(x)])).collect()}
    u = collisions.unit(x.astype(float))
    links = (u @ u.T >= 0.93).sum(1) - 1
    assert links.max() > 200 and (links[1000:1300] >= 1).all() and links[3000:3600].std() > 1
    assert [got[i] for i in range(6000)] == links.tolist()


def brute_top(ids, x, q, k):
    s = x[ids.index(q)] @ x.T
    order = sorted((-v, i) for v, i in zip(s, ids) if i != q)
    return [(i, -v) for v, i in order[:k]]


def test_search_that_aims_at_all_neighbours_finds_them(spark):
    x = clustered(130, 16, 3)
    x[50] *= 3
    rows = [(i, x[i]) for i in range(130)] + [(None, x[0]), (3, x[3]), (40, x[41])]
    got = {}
    for r in ann.search(table(spark, [(i, v, 1) for i, v in rows] + ODD + [(9_020, [1.0] * 4, 1)]), recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(130) if i % 20 == 0} and len(got[40]) == 40
    for q in set(got) - {40}:  # 40 stands in two rows, and each asks
        score = [(-float(x[q].astype(float) @ v.astype(float)), i is None, i or 0, n) for n, (i, v) in enumerate(rows) if n != q]
        want = sorted(score)[:20]
        assert np.allclose([s for _, _, s in sorted(got[q])], [-w[0] for w in want], rtol=0, atol=1e-12)
        exact = [(float((x[q].astype(float) * v.astype(float)).sum()), i) for n, (i, v) in enumerate(rows) if n != q]
        exact.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in exact[:20]]


def test_search_of_odd_tables(spark):
    assert ann.search(table(spark, [])).count() == 0 and ann.search(table(spark, ODD)).count() == 0
    few = ann.search(table(spark, [(20, [1, 0], 1), (21, [0.5, 0], 1), (22, [0.5, 0], 1)]), recall=1.0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(few)] == [(20, 1, 21, 0.5), (20, 2, 22, 0.5)]


@pytest.mark.parametrize("groups", [2400, 60])
def test_recall_with_the_default_aim(spark, monkeypatch, groups):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((groups, 24)).repeat(2400 // groups, 0) + 0.3 * rng.standard_normal((2400, 24))).astype(np.float32)
    ids = list(range(2400))
    df = table(spark, [(i, x[i], 1) for i in ids])
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 120
    recall = np.mean([len(got[q] & {i for i, _ in brute_top(ids, x.astype(float), q, 20)}) / 20 for q in got])
    assert recall >= 0.9
    # The index leaves rows out, few where the vectors have groups.
    index, _ = ann.indexed(df)
    assert index.counts.sum() == 2400 and index.visits < (2400 if groups == 2400 else 600)


def test_recall_of_the_table(spark, data):
    from txrisk.llm.common import table as read

    e = read(spark, data.replace("0.001", "0.01"), "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in e], float), [r["vec_id"] for r in e]
    got = {}
    for r in ann.search(read(spark, data.replace("0.001", "0.01"), "embeddings")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(got[q] & {i for i, _ in brute_top(ids, x, q, 20)}) / 20 for q in got])
    assert len(got) == sum(i % 20 == 0 for i in ids) and recall >= 0.9


def test_walk_goes_down_the_sums():
    rng = np.random.default_rng(1)
    x = ann.MultiIndex(rng.standard_normal((5, 3)), rng.standard_normal((7, 2)), np.ones((5, 7), int), 12)
    q = rng.standard_normal(5)
    walked = [(s, i[0], j[0]) for s, n, i, j in x.walk(q) if n == 1]
    sums = [x.first[i] @ q[:3] + x.second[j] @ q[3:] for _, i, j in walked]
    assert np.allclose(sums, [w[0] for w in walked])
    assert len(sums) == 35 and (np.diff(sums) <= 1e-12).all() and len({w[1:] for w in walked}) == 35
    assert np.isclose(x.least_sum(q), sums[11])


def test_walk_by_runs_visits_every_cell_once():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 5, (100, 90))
    x = ann.MultiIndex(rng.standard_normal((100, 4)), rng.standard_normal((90, 4)), counts, 500)
    q = rng.standard_normal(8)
    seen = np.zeros((100, 90), int)
    for s, n, i, j in x.walk(q):
        assert n == counts[np.ix_(i, j)].sum()
        seen[np.ix_(i, j)] += 1
    assert (seen == 1).all()
    a, b = x.sums(q[None])
    assert counts[a[0][:, None] + b[0][None, :] >= x.least_sum(q)].sum() >= 500


def test_blocks_share_and_split():
    first, parts = ann.blocks_of(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert parts.tolist() == [1, 1, 3, 1, 1, 1] and first.tolist() == [0, 0, 1, 4, 4, 5]


URLS = [
    None, "", "nothing", "http://A.B.NET/x?y", "x://net", "x://net/", "x://xnet/", "http://WWW.Example.Net/en/a#b", "http://example.net/EN/", "http://é.ORG/fr/?q=1&r",
    "https://m.example.com/de/1", "https://m.example.com/en/1?a=b&c=d", "a://b://c/d", "ftp://example.org?x/fr/", "http://example.org/fr", "http://" + "a" * 5000 + ".net/" + "b/" * 2000,
]


def brute_rule(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, rule string")


def test_rules(spark):
    more = [f"https://h{i}.example.{'net' if i % 2 else 'org'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(200)]
    urls = [*URLS, *more, more[0], more[0]]
    got = {r["page_id"]: r for r in url_filter.judge(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages(spark, [])).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages(spark, ["x", None])).collect()} == {"allow"}


def test_trees_learn_lexical_labels():
    rng = np.random.default_rng(3)
    urls, y = [], []
    for i in range(1200):
        bad = rng.random() < 0.4
        host = f"{'x' * int(rng.integers(3, 9))}{int(rng.integers(0, 10**9)) if bad else 'abc'}.example.com"
        path = "/p" * int(rng.integers(1, 4))
        urls.append((f"http://{host}{path}", host, path))
        y.append(float(bad))
    y = np.array(y)
    x, k = url_filter.described(urls)
    model = url_filter.train(x[:800], k[:800], y[:800])
    assert ((model.raw(model.features(x[800:], k[800:])) > 0) == (y[800:] == 1)).mean() > 0.97


def test_suffix_statistics_do_not_leak_labels():
    rng = np.random.default_rng(5)
    urls = [(f"http://h.own{i}/x", f"h.own{i}", "/x") for i in range(600)]  # every suffix stands once
    y = (rng.random(600) < 0.5).astype(float)
    x, k = url_filter.described(urls)
    x[:] = 0  # nothing else to learn from
    model = url_filter.train(x[:400], k[:400], y[:400])
    assert ((model.raw(model.features(x[400:], k[400:])) > 0) == (y[400:] == 1)).mean() < 0.65


def test_trees_of_the_table_hold_out(spark, data):
    from txrisk.llm.common import table as read

    p = url_filter.parsed(read(spark, data.replace("0.001", "0.01"), "pages"))
    x, k, y = url_filter.labelled_sample(p)
    assert len(y) > 100 and 0 < y.mean() < 1
    test = np.arange(len(y)) % 4 == 0
    model = url_filter.train(x[~test], k[~test], y[~test])
    right = ((model.raw(model.features(x[test], k[test])) > 0) == (y[test] == 1)).mean()
    assert right >= max(y[test].mean(), 1 - y[test].mean())
