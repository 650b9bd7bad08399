"""Centroid clustering, WARC archives and importance resampling against brute force, whole archives and DuckDB."""

import gzip
import hashlib
import io
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kinewave.llm import centroids, queries, resampling, warc
from kinewave.llm.common import joined_back

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_warc", "op13_resampling"])
def test_query_against_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and got


# centroids


def clustered(rows, k, rounds, dim):
    """(id, cluster, distance, cluster_inertia, inertia, digest) in Python's integers."""
    top = (1 << 63) - 1
    own = [(i, [int(x) * 256 if abs(x) > 2**60 else math.floor(x * 256) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    cents = [v for _, v, _ in sorted(own, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        best = [near(v)[1] for _, v, _ in own]
        for j in range(len(cents)):
            if mine := [v for (_, v, _), b in zip(own, best, strict=True) if b == j]:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v, _ in own]
    each = Counter()
    for _, d, j in found:
        each[j] += d
    return sorted([(i, j, min(d, top), min(each[j], top), min(sum(each.values()), top), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found], key=str)


@pytest.mark.parametrize("scale", [1, 2**14, 2**24, 2**70])
def test_clusters_at_every_magnitude(spark, scale):
    """BLAS, 64-bit and Python's integers give the same as plain integers; one row is far larger than the others."""
    rng = np.random.default_rng(scale % 97)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 3, (120, 4)))]
    rows += [(500, [float(scale)] * 4), (501, [-float(scale), 0.0, 1.0, float(scale)]), (7, rows[7][1]), (None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [(600, None), (601, [1.0] * 3), (602, [1.0, None, 0.0, 0.0]), (603, [1.0, float("nan"), 0.0, 0.0]), (604, [float("inf")] * 4), (605, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = centroids.clusters(frame, k=6, rounds=3, dim=4)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, 6, 3, 4)


def test_squared_distances_stay_exact_at_the_bound():
    """Just under and over 2^53, where a double sum would round."""
    for reach in (2**22, 2**23, 2**24, 2**26, 2**28, 2**31, 2**40):
        x, c = np.array([[reach - 1, -reach, 1, reach]], object), np.array([[1 - reach, reach, 0, -reach + 1], [reach, -1, reach, 3]], object)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
        assert centroids.squared(x.astype(np.int64), c.astype(np.int64)).tolist() == want


def test_few_and_no_vectors(spark):
    some = spark.createDataFrame([(3, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r.distance for r in centroids.clusters(some, dim=2).collect()] == [0, 0]
    assert centroids.clusters(some.where("false"), dim=2).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    rows = spark.createDataFrame([(i, [float(i % 2)] * 2) for i in range(8)], "vec_id long, embedding array<float>")
    got = centroids.clusters(rows, k=8, rounds=2, dim=2).collect()
    assert len({r.cluster for r in got}) == 2 and all(r.distance == 0 for r in got)
    order = sorted(range(8), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    assert {r.cluster for r in got} == {min(order.index(i) for i in range(8) if i % 2 == p) for p in (0, 1)}


# archives


def pages_of(spark):
    """Hot payload, payloads just under and at the bound, nulls, repeated rows and ids, long and awkward texts."""
    hot, rng = "<p>hot</p>" * 30, np.random.default_rng(3)
    rows = [(i, f"http://a{i}.example/x y?%20=\r\n", hot if i % 3 == 0 else f"<p>{i}</p>" * 20) for i in range(60)]
    rows += [(100, None, "x" * 99), (101, "http://b", "x" * 99), (102, "é://", "é" * 50), (103, "http://c", "é" * 50), (104, "http://d", None), (105, "http://e", "")]
    rows += [(106, "f", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (107, "g", "".join(map(chr, rng.integers(32, 0x2FFF, 700_000))))]
    rows += [(3, "twice", hot), (200, "h", "<b>1</b>" * 20), (200, "h", "<b>1</b>" * 20), (201, "h", "<b>1</b>" * 20), (None, "i", hot), (None, "j", "only null" * 20), (None, "k", "only null" * 20)]
    return rows, spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, digest int, refers_to string")


def expected(rows):
    first: dict = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, url, html in rows:
        b = (html or "").encode()
        to = first.get(b) if len(b) >= 100 and first.get(b) != i else None
        out.append((i, url and url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    rows, frame = pages_of(spark)
    folder = str(tmp_path_factory.mktemp("warc"))
    manifest = warc.write(warc.classified(frame.repartition(3)), f"{folder}/streams", size=1 << 18)
    return rows, folder, manifest, warc.normalise(manifest, f"{folder}/streams", f"{folder}/records")


def test_records_come_back(spark):
    rows, frame = pages_of(spark)
    assert sorted(map(tuple, warc.archived(frame).collect()), key=str) == expected(rows)
    assert warc.archived(frame.where("false")).collect() == []


def test_streams_are_one_member_and_records_are_one_each(spark, archives):
    rows, folder, manifest, done = archives
    assert manifest.count() > 3 and done.count() == manifest.count()
    for r in manifest.collect():
        data = open(f"{folder}/streams/{r.file}", "rb").read()
        whole = zlib.decompressobj(warc.GZIP)
        whole.decompress(data)
        assert whole.eof and not whole.unused_data
    index = warc.index_of(spark, done, f"{folder}/records").collect()
    assert len(index) == len(rows)
    for file in {r.file for r in index}:
        data, mine = open(f"{folder}/records/{file}", "rb").read(), sorted((r for r in index if r.file == file), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()] and mine[-1].offset + mine[-1].length == len(data)
        for r in mine:
            one = zlib.decompress(data[r.offset : r.offset + r.length], warc.GZIP)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and r.id.encode() in one


def test_payloads_and_files_of_lost_tasks(spark, archives):
    rows, folder, _, done = archives
    name = done.first().file
    for end in ("", ".idx"):  # what an attempt that did not end has left
        open(f"{folder}/records/lost.warc.gz{end}", "wb").write(open(f"{folder}/records/{name}{end}", "rb").read().replace(name.encode(), b"lost.warc.gz"))
    got = warc.read(warc.index_of(spark, done, f"{folder}/records"), f"{folder}/records", payloads=True).collect()
    assert len(got) == len(rows)
    texts = Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response")
    assert texts == Counter((i, (html or "").encode()) for (i, _, html), (j, *_, to) in ((r, next(e for e in expected([*rows]) if e[0] == r[0] and e[3] == hashlib.sha256((r[2] or "").encode()).hexdigest())) for r in rows) if to is None)


def test_normaliser_takes_members_chunks_and_refuses_damage():
    made = [warc.record(i, f"http://{i}", bytes([65 + i]) * n, "0" * 64, None, warc.DATE) for i, n in enumerate((0, 1, 700_000, 5))]
    for data in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made)), gzip.compress(b"\r\n".join(made[:2])) + gzip.compress(made[2] + made[3])):
        sink = io.BytesIO()
        found = list(warc.members(io.BytesIO(data), sink))
        out = sink.getvalue()
        assert [zlib.decompress(out[e["offset"] : e["offset"] + e["length"]], warc.GZIP) for e in found] == made
    for bad in (b"not a record\r\n\r\n", made[2][:5000], made[0][:-4] + b"WARC/1.1\r\nxx"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.members(io.BytesIO(gzip.compress(bad)), io.BytesIO()))
    assert list(warc.members(io.BytesIO(b""), io.BytesIO())) == []
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(gzip.compress(made[1]))


# resampling


def drawn(docs, target, n, buckets, percent, least, seed):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    each, aim = [feats(t) for _, t in docs], [feats(t)[1] for t in target]
    s, t = Counter(b for _, f in each for b in f), Counter(b for f in aim for b in f)
    alls, allt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (alls + buckets)) / ((s[b] + 1.0) * (allt + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, f) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((words >= least, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), i, len(f), w))
    full = sorted((r for r in out if r[0]), key=lambda r: (-r[1], r[2] is None, r[2] or 0))
    k = len(full) * percent // 100
    ranked = [(i, m, w, score, at + 1 if at < k else None) for at, (_, score, i, m, w) in enumerate(full)]
    return sorted([*ranked, *((i, m, w, score, None) for ok, score, i, m, w in out if not ok)], key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vocabulary = ["Straße", "été", "Alpha", "beta", "GAMMA9", "x", "中文", "İI", "delta_e", "ö"]
    say = lambda m: " ".join(rng.choice(vocabulary, m)) + "!?"
    hot = say(30)
    docs = [(i, hot if i % 3 == 0 else say(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "...,, \x00\x1f"), (None, say(40)), (None, say(25)), (5, docs[5][1]), (5, docs[5][1]), (303, "w" * 200_000 + " " + say(5000))]
    target = [say(50), say(3), None, "", "alpha Alpha ALPHA"]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, weight int, digest string").repartition(5)
    aim = spark.createDataFrame([(t, 0) for t in target], "text string, copies int")
    got = resampling.resampled(frame, aim, n=n, buckets=97, percent=30, least_words=20, seed=11)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(docs, target, n, 97, 30, 20, 11)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.where("false")
    assert resampling.resampled(none, docs.select("text")).collect() == []
    got = resampling.resampled(docs, none.select("text"), least_words=1, percent=100).collect()
    assert sorted(map(tuple, got)) == drawn([(1, "a b c")], [], 1, 10_000, 100, 1, 2024)


def test_joined_back_spreads_hot_keys_and_keeps_rows(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 2500) end as k", "id * 2 as n")
    classes = rows.where("k is not null").groupBy("k").count().selectExpr("k", "count as copies", "concat(k, '!') as say").where("k <> 'k1'")
    got = joined_back(rows, classes, "k")
    assert got.columns == ["id", "k", "n", "say"]
    want = {r.id: None if r.k in (None, "k1") else f"{r.k}!" for r in rows.collect()}
    assert {r.id: r.say for r in got.collect()} == want and got.count() == 5000
