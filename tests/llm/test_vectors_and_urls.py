"""Vector searches against brute force; URL rules and link propagation on small graphs."""

import numpy as np
import pytest

from kinewave.llm import ann, topk, url_filter


def exact(rows, every, k, measure):
    """The k best of all rows by brute force, ties to smaller ids."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted(((-measure(v, w), i) for i, w in rows if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(6).round(2).tolist()
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(300)] + [(i, same) for i in range(300, 420)]
    rows += [(500, None), (520, [0.0] * 6), (540, [float("nan")] + same[1:]), (560, [None] + same[1:]), (580, [float("inf")] + same[1:]), (None, same), (600, [1.0, 2.0]), (601, [2.0, 1.0])]
    return rows, spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, dim int, ids int")


def good(rows, zero):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and ok(v)]


def test_top_k_is_exact(odd):
    rows, frame = odd
    whole = [(i, np.floor(v * 256)) for i, v in good(rows, True)]
    want = exact(whole, 50, 5, lambda a, b: int(a @ b))
    assert by_query(topk.top_k(frame, size=64).collect()) == {q: x for q, x in want.items() if x}


def test_top_k_over_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.floor(np.array(r.embedding, float) * 256)) for r in frame.collect()]
    assert by_query(topk.top_k(frame).collect()) == exact(rows, 50, 5, lambda a, b: int(a @ b))


def test_neighbours_recall_and_ties(odd):
    rows, frame = odd
    want = exact(good(rows, False), 20, 20, lambda a, b: float((a * b).sum()))
    got = by_query(ann.neighbours(frame, size=64).collect())
    assert got.keys() == {q for q, x in want.items() if x}
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got])
    assert hits >= 0.98
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("longer", [1.0, 1e4, 1e8])
def test_neighbours_over_shards_of_a_large_table(spark, longer):
    """Recall over 12,000 vectors of 64 dimensions in several shards; one of them may be far longer than all others."""
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 1, (10, 64))
    all_ = (centres[rng.integers(0, 10, 12_000)] * 0.3 + rng.normal(0, 1, (12_000, 64))).astype(np.float32).astype(float)
    all_[77] *= longer
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>").repartition(8)
    got = by_query(ann.neighbours(frame, every=480, size=4096).collect())
    recall = []
    for q, found in got.items():
        s = all_ @ all_[q]
        s[q] = -np.inf
        recall.append(np.mean([x >= np.sort(s)[-20] - 1e-9 * abs(x) for _, x in found]))
        assert len(found) == 20
    assert len(got) == 25 and np.mean(recall) >= 0.9


def test_graph_is_built_in_rounds_and_finds_far_clusters(monkeypatch):
    """Every node is found from the entry, in tight clusters far apart as well; links are of others, each once."""
    rng = np.random.default_rng(9)
    for centres, spread in ((1, 1.0), (40, 0.01)):
        v = ann.lifted((rng.normal(0, 1, (centres, 16))[rng.integers(0, centres, 3000)] + spread * rng.normal(0, 1, (3000, 16))))
        rounds, nearest = [], ann.nearest
        monkeypatch.setattr(ann, "nearest", lambda *a: rounds.append(a[3]) or nearest(*a))
        graph = ann.Graph.built(v)
        monkeypatch.setattr(ann, "nearest", nearest)
        assert {64, 128, 256, 512, 1024, 2048, 3000} <= set(rounds) and len(rounds) < 40  # nodes are linked many at a time
        for row, own in enumerate(graph.links[0].tolist()):
            own = [x for x in own if x >= 0]
            assert own and row not in own and len(own) == len(set(own))
        hits = [len(set(graph.search(q, 10)) & set(np.argsort(-(v @ q))[:10].tolist())) / 10 for q in v[::50]]
        assert np.mean(hits) >= 0.95
    for n in (0, 1, 2, 3, 65):
        graph = ann.Graph.built(v[:n])
        assert n == 0 or sorted(graph.search(v[0], n)) == list(range(n))


def test_neighbours_of_huge_vectors(spark):
    rows = [(0, [1e200] * 8), (20, [2.8] + [0.0] * 7), (1, [0.28] * 8), (2, [1.5] * 8), (3, [-1e200] * 8), (4, [1e100] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann.neighbours(frame).collect())
    assert [i for i, _ in got[0]] == [4, 2, 20, 1, 3] and got[20][0] == (0, pytest.approx(2.8e200))


def test_top_k_of_products_beyond_double_precision(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**12, 0.0]), (2, [2.0**12, 1 / 256]), (3, [2.0**12, -1 / 256]), (4, [2.0**90, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(topk.top_k(frame).collect())
    assert got[0] == [(4, (1 << 63) - 1), (2, (1 << 58) + 256), (1, 1 << 58), (3, (1 << 58) - 256)]


def test_cover_tree_holds_its_levels():
    """Covering and separation at every level, and radii that hold; clusters are told apart, and pairs are pruned."""
    rng = np.random.default_rng(4)
    points = np.floor(np.concatenate([rng.normal(c, 20, (300, 8)) for c in rng.normal(0, 2000, (12, 8))]))
    tree = topk.CoverTree.built(points, leaf=16)
    width = {0: np.linalg.norm(points - points[0], axis=1).max()}
    for n, (a, b) in enumerate(tree.slice):
        d = np.linalg.norm(points[tree.order[a:b]] - tree.centres[n], axis=1)
        assert d.max() <= tree.radii[n] + 1e-9 and tree.radii[n] <= width[n] + 1e-9
        below = tree.children[n]
        for child in below:
            width[child] = width[n] / 2
            assert a <= tree.slice[child][0] and tree.slice[child][1] <= b
        if len(below) > 1:
            apart = np.linalg.norm(tree.centres[below][:, None] - tree.centres[below][None], axis=2)
            assert apart[~np.eye(len(below), dtype=bool)].min() > width[n] / 2
    assert sorted(tree.order.tolist()) == list(range(len(points))) and max(map(len, tree.children)) > 2
    queries = topk.CoverTree.built(points[::50])
    best = topk.dual_search(queries, tree, np.arange(len(points)), 5)
    assert best.scored < 0.5 * len(points) * len(queries.points)
    assert (best.score == -np.sort(-(points[::50] @ points.T), axis=1)[:, :5]).all()
    kth = best.score[:, -1].copy()
    assert (topk.dual_search(queries, tree, np.arange(len(points)), 5, kth).score == best.score).all()


def test_cover_trees_of_the_table_have_nodes(spark, sf):
    """In 64 dimensions, where no ball is half as wide, levels hold as well, and no query group loses a neighbour."""
    points = np.unique(np.floor(np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float) * 256), axis=0)
    tree = topk.CoverTree.built(points, leaf=8, base=topk.BASE)
    inner = [n for n, below in enumerate(tree.children) if len(below) > 1]
    assert inner and max(len(tree.children[n]) for n in inner) < len(points)
    for n, (a, b) in enumerate(tree.slice):
        own = points[tree.order[a:b]]
        assert np.linalg.norm(own - tree.centres[n], axis=1).max() == pytest.approx(tree.radii[n])
        cosines = own @ tree.centres[n] / np.linalg.norm(own, axis=1) / tree.norms[n]
        assert np.arccos(np.clip(cosines.min(), -1, 1)) == pytest.approx(tree.nodes["angle"][n], abs=1e-6)
    queries = topk.CoverTree.built(points[::7], leaf=8, base=topk.BASE)
    best = topk.dual_search(queries, tree, np.arange(len(points)), 5)
    assert (best.score == -np.sort(-(points[::7] @ points.T), axis=1)[:, :5]).all()


def test_cones_prune_what_balls_do_not():
    """Narrow beams of very unequal lengths: balls around them are wide, cones are not."""
    rng = np.random.default_rng(6)
    beams = rng.standard_normal((16, 24))
    points = np.unique(np.floor(np.concatenate([(b / np.linalg.norm(b) + rng.normal(0, 0.004, (200, 24))) * rng.uniform(500, 2000, (200, 1)) for b in beams])), axis=0)
    tree, queries = topk.CoverTree.built(points, leaf=16, base=topk.BASE), topk.CoverTree.built(points[::40], leaf=4, base=topk.BASE)
    best = topk.dual_search(queries, tree, np.arange(len(points)), 5)
    assert (best.score == -np.sort(-(points[::40] @ points.T), axis=1)[:, :5]).all()
    flat = topk.CoverTree(tree.points, tree.order, tree.nodes.copy())
    flat.nodes["angle"] = np.pi
    balls = topk.dual_search(queries, flat, np.arange(len(points)), 5)
    assert (balls.score == best.score).all() and best.scored < 0.8 * balls.scored


@pytest.mark.parametrize("size", [2.0**24, 2.0**29, 2.0**33, 2.0**60])
def test_top_k_of_large_vectors_by_trees(size):
    """Whole numbers beyond double precision, below and beyond a long, with ties: as Python's integers give them."""
    rng = np.random.default_rng(8)
    points = np.floor(rng.standard_normal((400, 16)) * size)
    points[:50] = np.floor(points[:50] / size * 1000)
    points[60:90] = points[60]
    points[60:90, 0] += np.repeat(np.arange(10), 3)
    ids = rng.permutation(400)
    tree, queries = topk.CoverTree.built(points, leaf=8, base=topk.BASE), topk.CoverTree.built(points[::9], base=topk.BASE)
    whole = [[int(x) for x in v] for v in points]
    want = []
    for q in whole[::9]:
        products = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))) for v in whole]
        want.append(sorted((-s, int(i)) for s, i in zip(products, ids, strict=True))[:6])
    best = topk.exact_search(queries, tree, ids, 6)
    assert [[(-int(s), int(i)) for s, i in zip(*x, strict=True)] for x in zip(best.score, best.id, strict=True)] == want
    kth = np.nextafter(np.array(best.score[:, -1], float), -np.inf)
    again = topk.exact_search(queries, tree, ids, 6, kth)
    assert (again.score == best.score).all() and (again.id == best.id).all()


PAGES = [
    (1, "https://WWW.Example.NET/en/1?x", None), (2, "http://a.net/z", ""), (3, "http://example.com/de/1#t", ""), (4, "http://example.com/de", ""), (5, "x.org/fr/", ""),
    (6, None, "<p>"), (7, "http://b.org/fr/1", ""), (8, "http://annet/", ""), (9, "://net", ""), (10, "a://b://c.net/en/", ""), (11, "http://EXAMPLE.com?q=/de/", ""), (1, "http://net/", ""),
]


def test_url_rules(spark):
    """example.com has one page that a rule blocks, and no page that one allows: its distrust decides over its other pages."""
    frame = spark.createDataFrame([(i, u, h, "s", "t") for i, u, h in PAGES], "page_id long, url string, html string, src string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(frame).collect())
    assert got == sorted([
        (1, "www.example.net", "/en/1", "example.net/en/", "allow"), (2, "a.net", "/z", "net/", "block"), (3, "example.com", "/de/1", "example.com/de/", "block"),
        (4, "example.com", "/de", "", "block"), (5, "", "", "", "allow"), (6, "", "", "", "allow"), (7, "b.org", "/fr/1", "org/fr/", "allow"),
        (8, "annet", "/", "", "allow"), (9, "net", "", "", "block"), (10, "b:", "//c.net/en/", "", "allow"), (11, "example.com", "", "", "block"), (1, "net", "/", "net/", "block"),
    ])


def test_links_are_resolved(spark):
    page = lambda *hrefs: "<base target=x>" + "".join(f"<a x=1 HREF={h}>l</a>" for h in hrefs)
    pages = [
        (1, "http://a.io/x", page('"/y"', "z", "'?q'", '"#top"', '"mailto:a@b.io"', '"JavaScript:f()"', '""', '"//B.io/x"', '"https://c.io?x"', '"http:next"')),
        (2, "http://d.io/", '<base href="https://E.io/x/"><a href="y">l</a><a href="/z">l</a><a href="ftp://f.io:21/">l</a>'), (3, None, page('"http://a.io"')), (4, "http://g.io", None),
    ]
    edges = url_filter.host_edges(url_filter.parsed(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert sorted(map(tuple, edges.collect())) == [("a.io", "a.io", 3), ("a.io", "b.io", 1), ("a.io", "c.io", 1), ("d.io", "e.io", 2), ("d.io", "f.io:21", 1)]


def test_verdicts_over_a_planted_table_are_those_of_power_iteration(spark):
    """A table with hubs, hosts without links, relative links and partly ruled hosts, recomputed with NumPy."""
    rng = np.random.default_rng(8)
    names = [f"h{i}.{rng.choice(['net', 'org', 'io', 'io', 'io', 'example.com'])}" for i in range(80)]
    pages = []
    for k in range(600):
        i = int(80 * rng.random() ** 2)
        targets = [names[int(80 * rng.random() ** 3)] for _ in range(rng.integers(0, 4))] if i % 7 else []
        html = "".join(f'<a href="http://{t}/p">l</a>' for t in targets) + '<a href="/more">l</a>' * int(rng.integers(0, 2) if i % 5 else 0)
        pages.append((k, f"http://{names[i]}/{rng.choice(['de', 'fr', 'en'])}/{k}", html, targets, i))
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    rows = url_filter.judge(frame).collect()
    assert all(r.verdict == ("allow" if r.rule.startswith("org") else "block") for r in rows if r.rule)

    hosts = sorted({r.host for r in rows})
    at = {h: n for n, h in enumerate(hosts)}
    at |= {t: len(at) + n for n, t in enumerate(sorted({t for p in pages for t in p[3]} - set(at)))}
    links = np.zeros((len(at), len(at)))
    for _, url, html, targets, _ in pages:
        src = at[url.split("/")[2]]
        for t in targets:
            links[src, at[t]] += 1
        links[src, src] += html.count("/more")
    score = {}
    for kind, graph, says in (("trust", links, "allow"), ("distrust", links.T, "block")):
        seed = np.zeros(len(at))
        for h in hosts:
            own = [r for r in rows if r.host == h]
            seed[at[h]] = sum(bool(r.rule) and r.verdict == says for r in own) / len(own)
        seed /= seed.sum()
        out = graph.sum(axis=1)
        walk = np.divide(graph, out[:, None], out=np.zeros_like(graph), where=out[:, None] > 0)
        x = seed
        for _ in range(400):
            x = 0.85 * (x @ walk + x[out == 0].sum() * seed) + 0.15 * seed
        score[kind] = x
    limit = url_filter.LEAST_DISTRUST / len(hosts)
    want = {h: "block" if score["distrust"][at[h]] > score["trust"][at[h]] and score["distrust"][at[h]] >= limit else "allow" for h in hosts}
    close = {h for h in hosts if min(abs(score["distrust"][at[h]] - score["trust"][at[h]]), abs(score["distrust"][at[h]] - limit)) < 0.01 * limit}
    free = [r for r in rows if not r.rule and r.host not in close]
    assert len(free) > 200 and {r.verdict for r in free} == {"allow", "block"} and all(r.verdict == want[r.host] for r in free)


def test_distrust_goes_against_links_and_trust_along(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">l</a>' for h in hosts)
    pages = [(1, "http://bad.net/", ""), (2, "http://feeder.io/", link("bad.net", "bad.net")), (3, "http://good.org/fr/", link("friend.io")), (4, "http://friend.io/", link("good.org"))]
    pages += [(10 + i, f"http://other{i}.io/", link(f"other{i + 1}.io")) for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filter.judge(frame).collect()}
    assert got["feeder.io"] == "block" and got["friend.io"] == "allow" and got["other3.io"] == "allow" and got["bad.net"] == "block"


def test_distrust_reaches_hosts_of_a_long_chain(spark):
    pages = [(0, "http://bad.net/", "")] + [(k, f"http://h{k}.io/", f'<a href="https://{"bad.net" if k == 1 else f"h{k - 1}.io"}/">l</a>') for k in range(1, 13)]
    pages += [(100 + i, f"http://other{i}.io/", "") for i in range(120)]
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.net", *(f"h{k}.io" for k in range(1, 13))}


def test_spread_settles(spark):
    edges = url_filter.shares(spark.createDataFrame([("a", "b", 2), ("a", "c", 2), ("b", "a", 1), ("c", "a", 1)], "src string, dst string, n long"))
    seeds = spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, seed double")
    got = {r.host: r.score for r in url_filter.spread(edges, seeds, tolerance=1e-5).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1.2e-4 and abs(sum(got.values()) - 1) < 1.2e-4


def test_spread_keeps_the_seeds_mass(spark):
    edges = url_filter.shares(spark.createDataFrame([("a", "b", 2), ("a", "c", 2), ("b", "a", 1), ("c", "a", 1)], "src string, dst string, n long"))
    seeds = spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, seed double")
    got = {r.host: r.score for r in url_filter.spread(edges, seeds, 60).collect()}
    assert abs(sum(got.values()) - 1) < 1e-3 and abs(got["b"] - got["c"]) < 1e-9
    assert abs(got["a"] - (0.15 + 0.85 * (got["b"] + got["c"]))) < 1e-3
