"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, small_batches, text_of, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants that a task spells out and sorts at a time.
VARIANTS = 4_000_000
#: Fingerprints that one bucket may hold, and variants that are spelled out in it, a task's work; while all fit, a fingerprint
#: goes to each of 2**LEAST_BITS buckets once.
BUCKET_FPS, BUCKET_VARIANTS, LEAST_BITS = 1 << 24, 1 << 27, 5
#: Bytes that a fingerprint may add to the shuffle of one pass; the buckets are dealt to passes accordingly.
PASS_BYTES = 1024
#: Shingles are counted in so many slots; a slot is common from COMMON + 8 times the mean count of a task on.
SLOTS, COMMON = 1 << 20, 16
#: Entries (a shingle of a node) that one task compares at a time, and those of one shingle that are dealt to one block.
PREFIX_ENTRIES, BLOCK = 2_000_000, 20_000
#: Buckets of shingles at least.
LEAST_BUCKETS = 1
#: Bits by whose parities two sets are compared before they meet, and the largest sets that send them: in larger ones, about
#: half of the bits differ for any two sets, which rules out nothing.
PARITIES, SMALL = 256, 576
#: Bits by whose parities a pair is compared before its whole sets are, at most.
MOST_PARITIES = 1 << 15
#: Shingles before its own that an entry names, so that a pair that shares one of them is left to that one's bucket.
EARLIER = 3
#: Nodes whose shared shingles are put in order together.
CHUNK = 1 << 12
#: Shingles of a node by which the first, inexact looks for similar nodes go.
LOOKS = (4, 16)
#: Members of a shingle beyond which pairs are made row by row; pairs whose earlier shingles are compared at a time.
LARGE, CHECKED = 64, 1 << 20
#: Stands for no earlier shingle; a shingle of this hash leaves no pair to its bucket, so some pairs are made twice.
NOTHING = np.uint32(0xFFFFFFFF)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle, repeats included; one of the whole sequence for fewer words, none for none."""
    import xxhash

    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes, as one unsigned number; zero for none."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for a in range(0, n, 65_536):
        counts += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the text's shingles; zero for a text without words."""
    return int(majority(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in cols["text"]], np.uint64).view(np.int64).tolist()}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of up to `radius` of `bits` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def masks_of(radius: int) -> np.ndarray:
    """The ball of half the radius around a fingerprint: of two that differ in `radius` bits at most, it holds a common variant."""
    return ball(64, radius // 2)


@cache
def _bytes_hash(bits: int) -> np.ndarray:
    """For each of the 8 bytes and its values, the exclusive or of random numbers of `bits` bits that belong to its set bits."""
    own = np.random.default_rng(17).integers(0, 1 << bits, (8, 8, 1), dtype=np.int64)
    on = np.arange(256)[None, None, :] >> np.arange(8)[None, :, None] & 1
    return np.bitwise_xor.reduce(own * on, axis=1)


def linear(fps: np.ndarray, bits: int) -> np.ndarray:
    """A hash of which linear(a ^ b) is linear(a) ^ linear(b), so the bucket of a variant follows from fingerprint and mask."""
    own = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    table, out = _bytes_hash(bits), np.zeros(len(own), np.int64)
    for k in range(8):
        out ^= table[k, own[:, k]]
    return out


class Sets:
    """Disjoint sets of the numbers below n; each is known by its smallest member."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        x, y = self.top[x], self.top[y]
        while (apart := x != y).any():
            x, y = x[apart], y[apart]
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
            while (up := self.top[self.top] != self.top).any():
                self.top[up] = self.top[self.top[up]]
            x, y = self.top[x], self.top[y]


    def spanning(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of links, of those given, that join all that they connect and that is not joined yet."""
        out, at = [np.empty(0, np.int64)], np.arange(len(a))
        while len(at):
            x, y = self.top[a[at]], self.top[b[at]]
            at, x, y = at[x != y], x[x != y], y[x != y]
            low, high = np.minimum(x, y), np.maximum(x, y)
            high, first = np.unique(high, return_index=True)  # each set joins one smaller set, so there is no circle
            out.append(at[first])
            self.join(low[first], high)
        return np.concatenate(out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of those given, enough to connect what they all connect."""
    ends, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    kept = Sets(len(ends)).spanning(number[: len(a)], number[len(a) :])
    return a[kept], b[kept]


def bucket_links(fps: np.ndarray, bucket: int, masks: np.ndarray, low: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Direct links among distinct fps that share a variant of this bucket, enough to connect all that do.

    The variants are spelled out in 2**low parts of the bucket, so that as many are sorted at a time as memory allows.
    All that share a variant lie within twice the ball's radius of each other, so each of them is linked to one of them.
    """
    classes = linear(masks, bits)
    order = np.argsort(classes, kind="stable")
    classes, masks = classes[order], masks[order]
    own, which = np.unique(linear(fps, bits), return_inverse=True)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in range(1 << low):
        wanted = own ^ (bucket << low | part)
        first = np.searchsorted(classes, wanted)
        counts = (np.searchsorted(classes, wanted, side="right") - first)[which]
        owner = np.repeat(np.arange(len(fps)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        variant = fps[owner] ^ masks[first[which][owner] + within]
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        new = np.concatenate([[True], variant[1:] != variant[:-1]]) if len(variant) else np.empty(0, bool)
        head = owner[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        a, b = np.concatenate([a, head[~new]]), np.concatenate([b, owner[~new]])
        if len(a) > VARIANTS or part == (1 << low) - 1:
            a, b = forest(a, b)
    return fps[a], fps[b]


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: verified links between distinct fingerprints (column fp), enough to connect all that are within the radius.

    Meet in the middle: every fingerprint stands for all its variants within half the radius (2,081 at a radius of 4), and
    two within the radius have one in common. Variants are shuffled by a linear hash, so that a fingerprint goes once to
    each bucket that holds variants of it, and they are spelled out there; equal variants are always in one bucket. Members
    of a variant are within the radius of each other, however many they are (2,081 at most); each link is checked again.
    n is the number of fingerprints: buckets become more with their variants (BUCKET_VARIANTS each) and beyond BUCKET_FPS
    fingerprints, up to one for each variant of a fingerprint, and are dealt to
    passes, each written before the next, so that the shuffle of a pass is bounded by PASS_BYTES a fingerprint.
    """
    if radius not in (0, 2, 4, 6):
        raise ValueError("the radius has to be 0, 2, 4 or 6")
    small_batches(fps.sparkSession)
    masks = masks_of(radius)
    top = LEAST_BITS
    while n * min(1.0, len(masks) / 2**top) > BUCKET_FPS or n * len(masks) > BUCKET_VARIANTS << top:
        top += 1
    low = max(0, (n * len(masks) // VARIANTS).bit_length() - top)
    bits = top + low
    moves = np.unique(linear(masks, bits) >> low)
    passes = -(-8 * len(moves) // PASS_BYTES)
    schema = pa.schema([("bucket", pa.int64()), ("fps", pa.binary())])

    def step(turn: int) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for s in range(0, len(every), 1 << 14):
                    some = every[s : s + (1 << 14)]
                    bucket = (linear(some, bits) >> low)[:, None] ^ moves[None, :]
                    owner, move = np.nonzero(bucket % passes == turn)
                    bucket = bucket[owner, move]
                    order = np.argsort(bucket, kind="stable")
                    bucket, owner = bucket[order], owner[order]
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
                    ends = [*cuts[1:].tolist(), len(bucket)]
                    yield pa.RecordBatch.from_pydict({"bucket": bucket[cuts], "fps": [some[owner[a:b]].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)]}, schema=schema)

        def join(table: pa.Table) -> pa.Table:
            own = np.unique(np.frombuffer(b"".join(table["fps"].to_pylist()), np.uint64))
            a, b = bucket_links(own, table["bucket"][0].as_py(), masks, low, bits)
            ok = np.bitwise_count(a ^ b) <= radius
            return pa.table({"a": a[ok].view(np.int64), "b": b[ok].view(np.int64)})

        return fps.select("fp").mapInArrow(emit, "bucket long, fps binary").groupBy("bucket").applyInArrow(join, "a long, b long")

    if passes == 1:
        return step(0).distinct()
    parts = [written(step(turn), "ball-links") for turn in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def common_slots(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of shingles that many nodes have, with their counts; SLOTS / COMMON a task at most, whatever the corpus.

    A task passes on the slots that are common among its own nodes, so a count may be too small. The counts only decide in
    which order shingles are looked at, never which pairs are found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            total += np.bincount(every & np.uint32(SLOTS - 1), minlength=SLOTS)
        slot = np.flatnonzero(total >= COMMON + 8 * total.mean())
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "n": pa.array(total[slot], pa.int64())})

    counts = nodes.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("n").desc(), "slot").limit(SLOTS // COMMON).toArrow()
    return found["slot"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)


def next_of_keys(keys: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes that share a key each with the next by size, if that is of another group."""
    order = np.lexsort((node, size, keys))
    keys, node, group = keys[order], node[order], group[order]
    on = (keys[1:] == keys[:-1]) & (group[1:] != group[:-1])
    x, y = node[:-1][on], node[1:][on]
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def share_earlier(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows of two tables (n, EARLIER) name a shingle in common; NOTHING is none."""
    out = np.zeros(len(mine), bool)
    for i in range(mine.shape[1]):
        for j in range(other.shape[1]):
            out |= (mine[:, i] == other[:, j]) & (mine[:, i] != NOTHING)
    return out


def pairs_of_keys(keys: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, most: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of nodes of different groups that share a key, each no larger than the other allows (`most`).

    Two entries that name a shingle in common (`earlier`: what came just before, in each node's own order) make no pair: both
    nodes have an entry for that shingle as well, with more room, and so are a pair there or, in turn, at one yet earlier.
    """
    order = np.lexsort((group, keys))
    keys, node, group, size, most, earlier = (x[order] for x in (keys, node, group, size, most, earlier))
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(keys)))
    left = np.repeat(heads + sizes, sizes) - np.arange(len(keys))
    mixed = np.repeat(group[heads] != group[heads + sizes - 1], sizes)
    out = [np.empty((0, 2), np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        first = np.concatenate([np.empty(0, bool), *(~share_earlier(earlier[x[s : s + CHECKED]], earlier[y[s : s + CHECKED]]) for s in range(0, len(x), CHECKED))])
        x, y = x[first], y[first]
        out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
        if sum(map(len, out[1:])) > PREFIX_ENTRIES:
            out[:] = [np.unique(np.concatenate(out), axis=0), np.empty((0, 2), np.int64)]

    live, step = np.flatnonzero(mixed & np.repeat(sizes <= LARGE, sizes) & (left > 1)), 1
    while len(live):
        x, y = live, live + step
        ok = (group[x] != group[y]) & (size[y] <= most[x]) & (size[x] <= most[y])
        keep(x[ok], y[ok])
        step += 1
        live = live[left[live] > step]
    for g in np.flatnonzero((sizes > LARGE) & mixed[heads]):
        at = np.arange(heads[g], heads[g] + sizes[g])
        at = at[most[at] >= size[at].min()]
        ends = np.searchsorted(group[at], group[at], "right")  # members are in order of group: the rest begins after one's own
        for s in range(0, len(at), 256):
            some, rest = at[s : s + 256], at[ends[s] :]
            if len(rest):
                ok = (group[some][:, None] < group[rest][None]) & (size[rest][None] <= most[some][:, None]) & (size[some][:, None] <= most[rest][None])
                x, y = np.nonzero(ok)
                keep(some[x], rest[y])
    found = np.unique(np.concatenate(out), axis=0)
    return found[:, 0], found[:, 1]


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % buckets


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cuts = [*np.flatnonzero(np.diff(values, prepend=values[:1] - 1)).tolist(), len(values)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def shared_shingles(nodes: DataFrame, slots: np.ndarray, counts: np.ndarray) -> DataFrame:
    """chunk, numbers, keys, often: the shingles of each node (number) that another node has too, and how many have them.

    A shingle goes with two bytes for its node to a bucket of about PREFIX_ENTRIES, where it is counted; one that no other
    node has ends there, as it makes no pair. Within a bucket 32 bits tell shingles apart, and the bucket is drawn by 40, so
    chance makes as few of them equal in many buckets as in one. Shingles of common slots count as often as their slot, and
    are not gathered. numbers are those within the chunk.
    """
    buckets = max(LEAST_BUCKETS, (nodes.agg(F.sum("n")).first()[0] or 0) // PREFIX_ENTRIES + 1)
    small = np.uint16 if buckets < 1 << 16 else np.int64  # short whole numbers are sorted in one pass

    def gathered(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        number, shingles, more = batch.column(0).to_numpy(), batch.column(1).to_pylist(), b"".join(batch.column(2).to_pylist())
        own = np.frombuffer(b"".join(shingles), np.uint32)
        owner = np.repeat(number, [len(x) // 4 for x in shingles])
        table = np.zeros(SLOTS, np.uint32)
        table[slots] = np.minimum(counts, 0xFFFFFFFF)
        often = table[own & np.uint32(SLOTS - 1)]
        return owner, own, key_bucket(own.astype(np.uint64) << np.uint64(8) | np.frombuffer(more, np.uint8), buckets), often

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, own, bucket, often = gathered(batch)
            owner, own, bucket = (x[often == 0] for x in (owner, own, bucket))
            order = np.argsort(bucket.astype(small), kind="stable")
            owner, own, bucket = owner[order], own[order], bucket[order]
            base = owner >> 16
            cuts = list(runs_of(np.cumsum((np.diff(bucket, prepend=bucket[:1]) != 0) | (np.diff(base, prepend=base[:1]) != 0))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[x]) for x, _ in cuts], pa.int64()),
                    pa.array([int(base[x]) for x, _ in cuts], pa.int64()),
                    pa.array([(owner[x:y] & 0xFFFF).astype(np.uint16).tobytes() for x, y in cuts], pa.binary()),
                    pa.array([own[x:y].tobytes() for x, y in cuts], pa.binary()),
                ],
                names=["bucket", "base", "numbers", "shingles"],
            )

    def chunks(owner: np.ndarray, keys: np.ndarray, often: np.ndarray) -> pa.Table:
        order = np.argsort(owner // CHUNK, kind="stable")
        owner, keys, often = owner[order], keys[order], often[order]
        cuts = list(runs_of(owner // CHUNK))
        columns = [pa.array([int(owner[x] // CHUNK) for x, _ in cuts], pa.int64())]
        for values, kind in ((owner % CHUNK, np.uint16), (keys, np.uint64), (often, np.uint32)):
            columns.append(pa.array([values[x:y].astype(kind).tobytes() for x, y in cuts], pa.binary()))
        return pa.table(columns, names=["chunk", "numbers", "keys", "often"])

    def count(table: pa.Table) -> pa.Table:
        base, numbers = table["base"].to_numpy(), table["numbers"].to_pylist()
        own = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint32)
        owner = (np.repeat(base, [len(x) // 2 for x in numbers]) << 16) + np.frombuffer(b"".join(numbers), np.uint16)
        order = np.argsort(own, kind="stable")
        own, owner = own[order], owner[order]
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])), len(own)))
        often = np.repeat(sizes, sizes)
        twice = often > 1
        return chunks(owner[twice], np.uint64(table["bucket"][0].as_py()) << np.uint64(32) | own[twice].astype(np.uint64), often[twice])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, own, bucket, often = gathered(batch)
            here = np.flatnonzero(often)
            yield from chunks(owner[here], bucket[here].astype(np.uint64) << np.uint64(32) | own[here].astype(np.uint64), often[here]).combine_chunks().to_batches()

    told, sets = "chunk long, numbers binary, keys binary, often binary", nodes.select("number", "shingles", "more")
    rare = sets.mapInArrow(emit, "bucket long, base long, numbers binary, shingles binary").groupBy("bucket").applyInArrow(count, told)
    return rare.unionByName(sets.mapInArrow(known, told))


ENTRIES = {"shingle": np.uint64, "salts": np.uint32, "nodes": np.int64, "groups": np.int64, "sizes": np.int32, "most": np.int32, "earlier": np.uint64, "parities": np.uint8}


def packed_entries(node: np.ndarray, group: np.ndarray, parities: list[bytes], entries: tuple[np.ndarray, ...], buckets: int, few: int | None) -> pa.RecordBatch:
    """A row a bucket of entries: shingle, place of the node, most, size, shingles before, how many nodes have it."""
    key, owner, most, size, earlier, often = entries
    blocks, salt = -(-often.astype(np.int64) // BLOCK), np.zeros(len(key), np.uint64)
    hot = np.flatnonzero(blocks > 1)
    if len(hot):
        times = blocks[hot] if few is None else np.ones(len(hot), np.int64)
        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        again = np.repeat(hot, times)
        mine = ((node[owner[again]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks[again]
        other = other if few is None else mine
        alone = np.flatnonzero(blocks <= 1)
        place = np.concatenate([alone, again])
        salt = np.concatenate([salt[alone], (np.minimum(mine, other) << 16 | np.maximum(mine, other)).astype(np.uint64)])
        key, owner, most, size, earlier = (x[place] for x in (key, owner, most, size, earlier))
    bucket = key_bucket(key * np.uint64(0x9E3779B97F4A7C15) ^ salt, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, key, salt, owner, most, size, earlier = (x[order] for x in (bucket, key, salt, owner, most, size, earlier))
    rows: dict[str, list] = {name: [] for name in ("bucket", *ENTRIES)}
    for a, b in runs_of(bucket):
        at = owner[a:b]
        less = at[size[a:b] <= SMALL]
        own = less[np.unique(node[less], return_index=True)[1]]
        values = (key[a:b], salt[a:b], node[at], group[at], size[a:b], most[a:b], earlier[a:b] if few is None else np.empty(0))
        packed = [x.astype(kind).tobytes() for x, kind in zip(values, ENTRIES.values(), strict=False)]
        for column, value in zip(rows.values(), (int(bucket[a]), *packed, b"".join(parities[k] for k in own)), strict=True):
            column.append(value)
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ENTRIES)]))


def prefix_pairs(nodes: DataFrame, groups: DataFrame | None, least: float, few: int | None = None) -> DataFrame:
    """a, b: every pair of nodes (node, shingles) of different groups (node, root) that may have a similarity of `least`.

    Exact, by a prefix filter: shingles have one order, rare ones first, by how many nodes have them. If a pair's first
    common shingle is the i-th of n, at most n - i are common, so the other set has at most (n - i)(1 + least) / least - n.
    A node has an entry for each shingle that leaves room for a set of least * n and that another node has too; those of one
    node only come first, so a node with enough of them has no entry. Two that share such a shingle are a pair if each fits
    the other, and if parities do not rule it out: a bit says whether a node has an odd number of shingles in a part of the
    hashes, and where d bits differ, sets of n and m shingles have at most (n + m - d) / 2 in common. What goes to a bucket
    has one size for each entry, however many buckets there are, and a pair is made in about one of the buckets that it
    shares. Nothing is joined here. A shingle of more than BLOCK nodes is dealt to salted blocks, and each two blocks meet.

    With `few`, only so many of a node's shingles count, in an order by common slots, blocks meet no others, and each node is
    paired with the next by size only: a cheap first look, not an exact one, that makes few pairs of a large family of copies.
    """
    slots, counts = common_slots(nodes)
    longest = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(longest * (1 - least)) // PREFIX_ENTRIES + 1)
    columns = ("number", "node", "n", "parities") if few is None else ("node", "shingles", "parities")
    grouped = nodes.select(*columns, F.col("node").alias("group"))
    if groups is not None:
        grouped = nodes.select(*columns).join(groups, "node", "left").select(*columns, F.coalesce("root", "node").alias("group"))

    def room(n: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.floor((n - at) * ((1 + least) / least) - n + 1e-6).astype(np.int64)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.uint64)
        table[slots] = counts.astype(np.uint64)
        for batch in batches:
            node, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            made: list[tuple] = []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint32)
                n = len(own)
                often = table[own & np.uint32(SLOTS - 1)]
                order = np.argsort(np.minimum(often, np.uint64(0xFFFFFFFF)) << np.uint64(32) | own.astype(np.uint64))
                most = room(n, np.arange(n))
                first = order[: int((most >= least * n - 1e-6).sum())][:few]
                made.append((own[first].astype(np.uint64), np.full(len(first), k), most[: len(first)], np.full(len(first), n), np.zeros(len(first)), often[first]))
            if made:
                yield packed_entries(node, group, batch.column(2).to_pylist(), tuple(np.concatenate(x) for x in zip(*made, strict=True)), buckets, few)

    def entries(table: pa.Table, shared: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        node, n, group = (table[k].to_numpy() for k in ("node", "n", "group"))
        numbers, keys, often = (np.frombuffer(b"".join(shared[k].to_pylist()), kind) for k, kind in (("numbers", np.uint16), ("keys", np.uint64), ("often", np.uint32)))
        owner = np.searchsorted(table["number"].to_numpy() % CHUNK, numbers)
        order = np.lexsort((keys, often, owner))
        owner, keys, often = owner[order], keys[order], often[order]
        has = np.bincount(owner, minlength=len(node))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(has) - has, has)
        most = room(n[owner], rank + (n - has)[owner])
        before = np.full((len(owner), EARLIER), NOTHING, np.uint64)
        for back in range(1, EARLIER + 1):
            there = np.flatnonzero(rank >= back)
            before[there, back - 1] = keys[there - back]
        fit = np.flatnonzero(most >= least * n[owner] - 1e-6)
        out = packed_entries(node, group, table["parities"].to_pylist(), tuple(x[fit] for x in (keys, owner, most, n[owner], before, often)), buckets, None)
        return pa.Table.from_batches([out])

    def join(table: pa.Table) -> pa.Table:
        whole = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), ENTRIES[name])
        keys = np.unique(whole("shingle"), return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | whole("salts")
        node, group, size, most = whole("nodes"), whole("groups"), whole("sizes"), whole("most")
        a, b = pairs_of_keys(keys, node, group, size, most, whole("earlier").reshape(-1, EARLIER)) if few is None else next_of_keys(keys, node, group, size)
        order = np.argsort(node, kind="stable")
        of = lambda x: size[order[np.searchsorted(node, x, sorter=order)]].astype(np.int64)
        small = [np.frombuffer(x, np.int64)[np.frombuffer(n, np.int32) <= SMALL] for x, n in zip(table["nodes"].to_pylist(), table["sizes"].to_pylist(), strict=True)]
        own = np.concatenate([np.unique(x) for x in small])  # as each row has the parities of its nodes
        x, y, fit = placed(own, a), placed(own, b), np.ones(len(a), bool)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        fit[both] = may_be_similar(whole("parities").view(np.uint64).reshape(-1, PARITIES // 64), x[both], y[both], of(a[both]) + of(b[both]), least)
        return pa.table({"a": a[fit], "b": b[fit]})

    small_batches(nodes.sparkSession)
    schema = "bucket long, " + ", ".join(f"{k} binary" for k in ENTRIES)
    if few is None:
        chunked = grouped.withColumn("chunk", F.expr(f"number div {CHUNK}"))
        packed = chunked.groupBy("chunk").cogroup(shared_shingles(nodes, slots, counts).groupBy("chunk")).applyInArrow(entries, schema)
    else:
        packed = grouped.mapInArrow(first_look, schema)
    return packed.groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def placed(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A place of each wanted value in own, -1 if it has none."""
    if not len(own):
        return np.full(len(wanted), -1)
    order = np.argsort(own, kind="stable")
    at = order[np.minimum(np.searchsorted(own, wanted, sorter=order), len(own) - 1)]
    return np.where(own[at] == wanted, at, -1)


def parities_of(shingles: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """So many bits (a power of two): whether the set has an odd number of the hashes that leave this remainder."""
    return np.packbits(np.bincount(shingles & np.uint32(bits - 1), minlength=bits) & 1)


def fine_bits(n: int) -> int:
    """Parities by which a set of n shingles is compared once it is in a pair: as many as shingles, MOST_PARITIES at most."""
    return min(max(PARITIES, 1 << (n - 1).bit_length()), MOST_PARITIES)


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs a, b that fine parities (a bit a shingle, where the set itself has 32) do not rule out.

    pairs is a table of written(), distinct, which is removed here; what is returned is one as well.
    """

    def same():
        def each(cols: dict) -> dict:
            ok = []
            for x, y, total in zip(cols["x"], cols["y"], cols["total"], strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                differ = int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())
                ok.append(total - differ >= 2 * least / (1 + least) * total - 1e-6)
            return {"a": cols["a"], "b": cols["b"], "ok": ok}

        return each

    small_batches(pairs.sparkSession)
    of = lambda side, name: nodes.select(F.col("node").alias(side), F.col("fine").alias(name), F.col("n").alias(f"n{side}"))
    full = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("total"))
    return written(map_rows(full, same, "a long, b long, ok boolean").where("ok").select("a", "b"), "likely", pairs)


def may_be_similar(parities: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (rows a and b of parities, of `total` shingles together) may have a similarity of `least`.

    Each shingle that only one of the two sets has turns one bit, so as many bits differ as there are such shingles at most.
    """
    out = np.ones(len(a), bool)
    for s in range(0, len(a), CHECKED):
        here = slice(s, s + CHECKED)
        differ = np.bitwise_count(parities[a[here]] ^ parities[b[here]]).sum(axis=1, dtype=np.int64)
        out[here] = total[here] - differ >= 2 * least / (1 + least) * total[here] - 1e-6
    return out


def similar_enough(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The links a, b whose sets of shingles (column shingles of nodes) have a similarity of `least` or more.

    pairs is a table of written(), distinct, which is removed here; what is returned is one as well.
    """

    def same():
        def each(cols: dict) -> dict:
            ok = []
            for x, y in zip(cols["x"], cols["y"], strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.sort(np.concatenate([x, y]))
                both = int((both[1:] == both[:-1]).sum())
                ok.append(both >= least * (len(x) + len(y) - both))
            return {"a": cols["a"], "b": cols["b"], "ok": ok}

        return each

    small_batches(pairs.sparkSession)
    of = lambda side, name: nodes.select(F.col("node").alias(side), F.col("shingles").alias(name))
    full = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    return written(map_rows(full, same, "a long, b long, ok boolean").where("ok").select("a", "b"), "similar", pairs)


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between nodes (node, fp) by ball hashing, two for each linked node at most, none verified on its set.

    Nodes of one fingerprint are linked to the smallest of them. A node keeps its smallest partner and one by chance: what
    that leaves apart is found by prefix_pairs(), so nothing hangs on it.
    """
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fps")
    rep = lambda side: fps.select(F.col("fp").alias(side), F.col("rep").alias(f"r{side}"))
    between = links(fps, fps.count(), radius).join(rep("a"), "a").join(rep("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    within = nodes.select("node", "fp").join(fps, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    found = written(between.unionByName(within), "ball-links", fps)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    two = both.groupBy("a").agg(F.array(F.min("b"), F.min_by("b", F.xxhash64("a", "b"))).alias("b")).select("a", F.explode("b").alias("b"))
    return written(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links", found)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): the smallest node that it reaches.

    Large-star and small-star rounds, written to the shared folder, until no edge changes; a star's centre is found by
    min() with partial sums, so that no task gathers a group. Rounds grow with the logarithm of the longest path; beyond
    `rounds` an error is raised.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    count = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    state = now.select(F.count("*"), count).first()
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, large.b == least.u).select("m", F.col("a"), F.col("b"))
        out = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x")).select("x.a", "x.b")
        now = written(out.where("a < b").distinct(), "edges", now)
        before, state = state, now.select(F.count("*"), count).first()
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out._written_at = now._written_at
    return out


def clustered(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text).

    Fingerprints at `radius` or fewer differing bits are linked, and component_id is the smallest doc_id reachable. Texts
    without words have fingerprint zero and are linked like any other; null texts count as empty; rows with a null
    doc_id get the component's smallest id, null if there is none. Equal fingerprints are one node, so copies are joined by a sum
    before any linking, and no pairs of documents are made.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes, nodes.count(), radius)
    roots = components(edges)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; see clustered()."""
    return clustered(docs, radius, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_rows(docs: DataFrame, shingle: int = 5, least: float = 0.8, key: str | None = None) -> DataFrame:
    """doc_id, root for every row of docs (doc_id, text) that has words, and the column `key` if one is named.

    Texts whose sets of word shingles have a similarity (intersection over union) of `least` or more are linked, and rows
    that are connected have one root. Ball hashing of fingerprints comes first, and joins most; no fingerprint of 64 bits
    is sure to be near at such a similarity, so looks at a few shingles join more of large families, and all pairs that are
    still apart then come from an exact filter on rare shingles (prefix_pairs()). Every link is verified on the whole sets before it joins anything. Texts of equal sets are
    one node. Null, empty and blank texts have no row.
    """
    small_batches(docs.sparkSession)
    keys = [key] if key else []

    def make():
        import xxhash

        def each(cols: dict) -> dict:
            out: dict[str, list] = {name: [] for name in ("doc_id", *keys, "node", "fp", "parities", "fine", "shingles", "more")}
            own = zip(*(cols[name] for name in ("doc_id", *keys)), strict=True)
            for ids, text in zip(own, cols["text"], strict=True):
                hashes = shingle_hashes(text, shingle)
                if len(hashes):
                    distinct = np.unique(hashes)
                    short, first = np.unique((distinct >> np.uint64(32)).astype(np.uint32), return_index=True)
                    more = (distinct[first] >> np.uint64(24)).astype(np.uint8)
                    fp = int(majority(hashes).view(np.int64)[0])
                    for column, value in zip(out.values(), (*ids, xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63), fp, parities_of(short).tobytes(), parities_of(short, fine_bits(len(short))).tobytes(), short.tobytes(), more.tobytes()), strict=True):
                        column.append(value)
            return out

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text_of().alias("text"))
    sketches = written(map_rows(texts, make, f"doc_id long, {''.join(f'{k} long, ' for k in keys)}node long, fp long, parities binary, fine binary, shingles binary, more binary"), "sketches")
    rows = written(sketches.select("doc_id", *keys, "node"), "rows")
    sets = sketches.select("node", "fp", "parities", "fine", (F.octet_length("shingles") / 4).cast("long").alias("n"), "shingles", "more").dropDuplicates(["node"])
    nodes = written(sets.withColumn("number", F.monotonically_increasing_id()), "nodes", sketches)
    found = similar_enough(near_links(nodes), nodes, least)
    for few in (*LOOKS, None):
        roots = components(found)
        pairs = written(prefix_pairs(nodes, roots, least, few), "candidates")
        more = similar_enough(likely(pairs, nodes, least) if few is None else pairs, nodes, least)
        known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        found = written(more.unionByName(known), "verified", more, roots, found)
    roots = components(found)
    out = written(rows.join(roots, "node", "left").select("doc_id", *keys, F.coalesce("root", "node").alias("root")), "rooted", rows, nodes, roots, found)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text) that has words; see similar_rows().

    component_id is the smallest doc_id of the connected rows. Rows with a null doc_id get their group's smallest id, null
    if there is none; repeated rows are copies.
    """
    rows = similar_rows(docs, shingle, least)
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root").select("doc_id", "component_id")
