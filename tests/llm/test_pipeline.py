"""Near-duplicates by similarity, and the pipeline's stages, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinewave.llm import secrets, simhash, toxicity

from test_text_operators import EDGE, brute_repeats


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows, least=0.8):
    """(doc_id, text) to the smallest doc_id of the group, by all pairs; and the linked pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        if s := shingles(t):
            sets[s].append(i)
    keys = list(sets)
    root, links = {k: k for k in keys}, []

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if min(len(a), len(b)) >= least * max(len(a), len(b)):
                both = len(a & b)
                if both >= least * (len(a) + len(b) - both):
                    links.append((sets[a][0], sets[b][0], both / (len(a) + len(b) - both)))
                    root[find(a)] = find(b)
    smallest = {}
    for k, ids in sets.items():
        known = [i for i in ids if i is not None]
        smallest[find(k)] = min([*known, *([smallest[find(k)]] if find(k) in smallest else [])], default=None)
    return {i: smallest[find(k)] for k, ids in sets.items() for i in ids}, links


@pytest.mark.parametrize("large", [3, 64])
def test_similar_groups(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(40):
        text = rng.choices(words, k=rng.choice([20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 6, 30])):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.3 else "  ".join(copy), group))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    want, links = brute_groups([r[:2] for r in rows])
    assert got.keys() == want.keys()
    assert all(want[got[i]] == want[i] for i in got)  # no link that is not similar enough
    assert len(links) > 200 and all(got[a] == got[b] for a, b, _ in links)


def test_all_similar_pairs_of_a_whole_table(spark):
    """Over 10,000 documents every pair of a similarity of 0.8 or more is joined, and nothing else; pairs by an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    holders, root, n_links = defaultdict(list), {i: i for i, s in sets if s}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    size = {}
    for i, own in sets:
        both = Counter(j for s in own for j in holders[s])
        for j, n in both.items():
            if n >= 0.8 * (len(own) + size[j] - n):
                n_links += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for s in own:
            holders[s].append(i)
        size[i] = len(own)
    assert n_links > 500 and got == {i: find(i) for i in root}


def test_similar_pairs_within_a_family_of_a_template(spark, monkeypatch):
    """All of 1,000 texts have a similarity of 0.778, but planted pairs 0.81: links that are rejected hide none of these."""
    if hasattr(simhash, "BLOCK"):
        monkeypatch.setattr(simhash, "BLOCK", 300)
    core, rows = [f"core{i}" for i in range(179)], []
    for i in range(1000):
        own = [f"own{i}x{k}" for k in range(25)]
        if i < 60:
            own[:4] = [f"both{i // 2}x{k}" for k in range(4)]
        rows.append((i, " ".join(core + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == {i: i - i % 2 if i < 60 else i for i in range(1000)}


def test_pairs_of_keys_are_all_pairs_of_different_groups():
    rng = np.random.default_rng(5)
    keys, node = rng.integers(0, 4, 600).astype(np.uint64), np.arange(600)
    group, size, most = rng.integers(0, 200, 600), rng.integers(10, 20, 600), rng.integers(8, 20, 600)
    group[rng.random(600) < 0.5] = 7
    none = np.full((600, simhash.EARLIER), simhash.NOTHING)
    want = {(i, j) for j in range(600) for i in range(j) if keys[i] == keys[j] and group[i] != group[j] and size[i] <= most[j] and size[j] <= most[i]}
    for large in (3, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "LARGE", large)
            assert set(zip(*map(np.ndarray.tolist, simhash.pairs_of_keys(keys, node, group, size, most, none)), strict=True)) == want


def test_next_of_keys_pairs_neighbours_of_different_groups():
    keys, node, group, size = np.array([1, 1, 1, 2, 2, 3], np.uint64), np.arange(6), np.array([0, 0, 5, 7, 8, 9]), np.array([30, 10, 20, 5, 5, 1])
    assert set(zip(*map(np.ndarray.tolist, simhash.next_of_keys(keys, node, group, size)), strict=True)) == {(1, 2), (0, 2), (3, 4)}


def test_pairs_are_left_to_the_bucket_of_an_earlier_shingle():
    """A pair of the same shingles in a row is made at the first of them alone; one that only meets later, there."""
    own = {0: [1, 2, 3, 4, 5, 6, 7], 1: [1, 2, 3, 4, 5, 6, 7], 2: [9, 11, 12, 13, 14, 15, 7], 3: [8, 2, 3]}
    entries = [(k, n, [own[n][i - back] if i >= back else simhash.NOTHING for back in range(1, simhash.EARLIER + 1)]) for n in own for i, k in enumerate(own[n])]
    made = []
    for key in range(1, 16):
        here = [e for e in entries if e[0] == key]
        if here:
            node, n = np.array([e[1] for e in here]), np.full(len(here), 10)
            before = np.array([e[2] for e in here], np.uint32)
            made += [(key, a, b) for a, b in zip(*map(np.ndarray.tolist, simhash.pairs_of_keys(np.full(len(here), key, np.uint64), node, node, n, n, before)), strict=True)]
    assert made == [(1, 0, 1), (2, 0, 3), (2, 1, 3), (7, 0, 2), (7, 1, 2)]


def test_long_texts_that_share_a_passage_each_make_no_pairs(spark, monkeypatch):
    """Any two of 60 texts of 650 words share a passage of their own, and most of a text is nowhere else."""
    rows = []
    for i in range(60):
        parts = [[f"both{min(i, j)}and{max(i, j)}x{k}" for k in range(5)] + [f"own{i}x{j}x{k}" for k in range(6)] for j in range(60) if j != i]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(60 + i, " ".join(t.split()[:-20])) for i, t in rows[:3]]
    made, likely = [], simhash.likely

    def counted(pairs, *rest):
        made.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "likely", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i % 60 for i in range(63)} and made[0] < 10


def test_shared_shingles_are_counted_over_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PREFIX_ENTRIES", 40)
    rng = np.random.default_rng(8)
    sets = {(k % 3 << 33) + 4000 + k: np.unique(rng.integers(0, 400, 30)).astype(np.uint32) for k in range(60)}
    rows = [(k, len(v), bytearray(v.tobytes()), bytearray((v % 7).astype(np.uint8).tobytes())) for k, v in sets.items()]
    nodes = spark.createDataFrame(rows, "number long, n long, shingles binary, more binary").repartition(3)
    for slots in ([], [5, 9]):
        seen = defaultdict(dict)
        for r in simhash.shared_shingles(nodes, np.array(slots, np.int64), np.full(len(slots), 1000)).collect():
            numbers, keys, often = (np.frombuffer(x, kind).tolist() for x, kind in ((r.numbers, np.uint16), (r.keys, np.uint64), (r.often, np.uint32)))
            for n, k, c in zip(numbers, keys, often, strict=True):
                seen[r.chunk * simhash.CHUNK + n][k & 0xFFFFFFFF] = c
        total = Counter(x for v in sets.values() for x in v.tolist())
        assert seen == {k: x for k, v in sets.items() if (x := {s: 1000 if s in slots else total[s] for s in v.tolist() if total[s] > 1 or s in slots})}


def test_parities_never_rule_out_similar_sets():
    rng, ruled_out = np.random.default_rng(2), Counter()
    for n in (1, 5, 90, 399, 400, 3000, 30_000):
        for changed in (0.02, 0.1, 0.12, 0.5):
            x = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
            y = np.unique(np.concatenate([x[: int(len(x) * (1 - changed))], rng.integers(0, 1 << 32, int(n * changed * rng.random()), dtype=np.uint64).astype(np.uint32)]))
            if len(y):
                both = len(np.intersect1d(x, y))
                bits = np.stack([simhash.parities_of(v) for v in (x, y)]).view(np.uint64)
                may = simhash.may_be_similar(bits, np.array([0]), np.array([1]), np.array([len(x) + len(y)]), 0.8)[0]
                assert may or both < 0.8 * (len(x) + len(y) - both)
                ruled_out[n] += not may
    assert ruled_out[90] and ruled_out[399]


def test_pairs_do_not_depend_on_the_number_of_buckets(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for entries in (2_000_000, 500):
        monkeypatch.setattr(simhash, "PREFIX_ENTRIES", entries)
        found.append({r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()})
    assert found[0] == found[1] and len(found[0]) > len(set(found[0].values()))


def test_similar_groups_of_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in EDGE], "doc_id long, text string, sketch int, shingles string, component_id string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect())
    want, _ = brute_groups(EDGE)
    assert got == Counter((i, want[i]) for i, t in EDGE if shingles(t))
    assert simhash.similar_groups(docs.limit(0)).collect() == []


def test_stages(spark, sf):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 30000")
    names = docs.columns
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        tables.append(docs)
    assert all(t.columns == names for t in tables[:-1])
    first = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 30000")
    texts = lambda t: {r.doc_id: r.text or "" for r in t.select("doc_id", "text").collect()}
    before, clean, single, cut, safe = texts(first), *map(texts, tables[:-1])

    rejected = {r.doc_id for r in toxicity.scored(first, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert clean == {i: t for i, t in before.items() if i not in rejected}
    want, _ = brute_groups(sorted(clean.items()))
    assert single == {i: t for i, t in clean.items() if want.get(i, i) == i}
    gone = brute_repeats([single[i] for i in sorted(single)])
    assert {i: len(t.encode()) for i, t in cut.items()} == {i: n - removed for i, (n, removed, *_) in zip(sorted(single), gone, strict=True)}
    spans = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in secrets.secret_spans(tables[2]).collect()}
    for i, text in cut.items():
        out, at = "", 0
        for a, b in spans[i]:
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        assert safe[i] == out + text[at:]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, filled = defaultdict(list), Counter()
    for r in tables[-1].collect():
        pieces[r.doc_id].append(r)
        filled[r.sequence_id] += r.length
    assert pieces.keys() == safe.keys() and max(filled.values()) <= 1024
    assert all(n == 1024 or n & (n - 1) == 0 for n in filled.values())
    for i, text in safe.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_near_duplicate_stage_tells_rows_apart(spark, sf):
    """Null, repeated and shared ids: one row of each group stays, and what is in no group."""
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcde")
    rows = [(None, a), (None, a), (1, b), (1, b), (5, c), (2, c + " more"), (5, d), (None, c), (7, e), (None, e), (8, None), (8, None), (None, " "), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect())
    assert got == Counter([(None, a), (1, b), (2, c + " more"), (5, d), (7, e), (8, None), (8, None), (None, " "), (9, "")])


def test_stages_of_empty_tables(spark, tmp_path):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5), (2, text, 7), (3, "other words altogether here now", 9)], "doc_id long, text string, _row long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted((r.doc_id, r._row) for r in got.collect()) == [(1, 5), (3, 9)]
