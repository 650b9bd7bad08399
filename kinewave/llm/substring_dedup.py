"""Repeated substrings of at least 200 bytes: samples of a difference cover, then open suffixes block by block.

In place of a rank, a cover sample has a name of 96 bits (two hashes of its bytes) that is equal for equal strings. A rank
settles a tie of two suffixes at the one offset that both have a sample at, and that offset depends on both: a suffix would
have to carry the ranks of all its 12 samples to its bucket, 48 to 96 bytes where an entry now has 16.
"""

from __future__ import annotations

import hashlib
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, partitions, text_of, written

LENGTH = 200
#: A perfect difference cover: every difference modulo PERIOD is that of two of its members.
PERIOD = 133
COVER = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
SHARD_BYTES = 4 << 20
#: Shards in a bucket of the written table at most; one task reads them one after the other.
BUCKET_SHARDS = 256
#: Entries that one task sorts, and suffixes of a block as a share of all bytes.
BUCKET_ENTRIES = 3_000_000
BLOCK_SHARE = 0.07
REPEATED = np.uint32(1 << 31)

#: Of the two hashes of a string: an odd number whose powers weigh its bytes, and the number for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
#: An entry: 64 bits of one hash, 32 of the other, and the position.
ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("p", "<u4")])
#: What is left of it where a chance equality only means that more suffixes stay open.
SHORT = np.dtype([("g", "<u4"), ("p", "<u4")])


WINDOW_BYTES = 1 << 16


@cache
def powers(base: int) -> np.ndarray:
    x = np.full(WINDOW_BYTES + PERIOD + LENGTH + 1, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


def packed(positions: np.ndarray) -> bytes:
    """Ascending positions as gaps of a byte each; 255 stands for a gap that follows behind, in four bytes."""
    gaps = np.diff(positions, prepend=0).astype(np.uint32)
    long = gaps >= 255
    return np.uint32(len(gaps)).tobytes() + np.minimum(gaps, 255).astype(np.uint8).tobytes() + gaps[long].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, np.uint32, -1, 4 + n)
    return np.cumsum(gaps)


class Hashes:
    """Two hashes, of 64 and 32 bits, of the substrings of a buffer, from prefix sums modulo 2**64, a window at a time.

    A hash depends on the bytes only, not on where they stand, so windows and shards agree. The two have bases and tables
    of their own, so that strings are taken for equal by 96 bits.
    """

    longest = PERIOD + LENGTH

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.powers = [(powers(base), powers(pow(base, -1, 1 << 64))) for base in _BASES]

    def at(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Entries of data[start:stop] for ascending starts."""
        out = np.empty(len(starts), ENTRY)
        out["p"] = starts
        for low in range(0, len(self.data), WINDOW_BYTES):
            i, j = np.searchsorted(starts, [low, low + WINDOW_BYTES])
            if i == j:
                continue
            part = self.data[low : low + WINDOW_BYTES + self.longest]
            a, b = starts[i:j] - low, stops[i:j] - low
            for name, table, (power, back) in zip(("h", "g"), _TABLES, self.powers, strict=True):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(table[part] * power[: len(part)], out=sums[1:])
                h = (sums[b] - sums[a]) * back[a]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                if name == "h":
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0x94D049BB133111EB)
                out[name][i:j] = h ^ (h >> np.uint64(32)) if name == "h" else h >> np.uint64(32)
        return out


def by_hash(entries: np.ndarray) -> np.ndarray:
    """The order of entries by both hashes; the second is looked at only where the first alone does not tell."""
    order = np.argsort(entries["h"])
    h, g = entries["h"][order], entries["g"][order]
    if ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
        order = np.lexsort((entries["g"], entries["h"]))
    return order


def firsts(entries: np.ndarray) -> np.ndarray:
    """Of ordered entries, those that differ from the one before."""
    h, g = entries["h"], entries["g"]
    return np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (g[1:] != g[:-1])])


class Shard:
    """The texts of a shard in one buffer, in an order that any later reading of the shard gives again."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table = table.sort_by([("_key", "ascending")])
        self.shard = table["_shard"][0].as_py()
        texts = table["_bytes"].combine_chunks()
        self.parts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        self.lengths = np.array([len(p) for p in self.parts], np.int64)
        self.stops = np.cumsum(self.lengths)
        self.starts = self.stops - self.lengths
        self.data = np.frombuffer(b"".join(self.parts), np.uint8)
        self.n = len(self.data)
        if self.n >= 1 << 31:
            raise ValueError("a shard's texts exceed 2 GB")

    def cover(self) -> np.ndarray:
        """Sample positions, counted within each document."""
        out = []
        for start, length in zip(self.starts, self.lengths, strict=True):
            if length >= LENGTH:
                grid = (np.arange(0, length, PERIOD, dtype=np.int64)[:, None] + np.array(COVER)[None, :]).ravel()
                out.append(start + grid[grid <= length - (LENGTH - PERIOD + 1)])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def bounds(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of the document of each position."""
        doc = np.searchsorted(self.stops, positions, side="right")
        return self.starts[doc], self.stops[doc]

    def context(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of suffixes whose cover sample may be at a position: first and last (inclusive)."""
        low, high = self.bounds(positions)
        return np.maximum(low, positions - PERIOD + 1), np.minimum(positions, high - LENGTH)


def deal(shard: int, entries: np.ndarray, buckets: int, kind: np.dtype) -> dict[str, list]:
    """Rows (bucket, shard, whole, e) of a shard's entries, e holding them as `kind`.

    What is repeated within the shard is settled here: its positions go along in a row of their own, and one entry,
    marked REPEATED, stands for them all. So a bucket gets one entry of a shard for a string, however common it is.
    """
    rows: dict[str, list] = {"bucket": [], "shard": [], "whole": [], "e": []}
    if not len(entries):
        return rows
    entries = entries[by_hash(entries)]
    first = firsts(entries)
    inside = ~(first & np.concatenate([first[1:], [True]]))

    def row(bucket: int, whole: bool, e: bytes) -> None:
        for column, value in zip(rows.values(), (bucket, shard, whole, e), strict=True):
            column.append(value)

    if inside.any():
        row(shard % buckets, True, packed(np.sort(entries["p"][inside])))
    entries["p"][inside] |= REPEATED
    entries = entries[first]
    bucket = (entries["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # ranges of the order just made
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    slim = np.empty(len(entries), kind)
    for name in kind.names:
        slim[name] = entries[name]
    for s, e in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        row(int(bucket[s]), False, slim[s:e].tobytes())
    return rows


DEALT = "bucket int, shard int, whole boolean, e binary"
FOUND = "shard int, kind int, p binary"
_DEALT = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("whole", pa.bool_()), ("e", pa.binary())])
_FOUND = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("p", pa.binary())])


def rank_bucket(table: pa.Table, entry: np.dtype) -> pa.Table:
    """Sort one bucket's entries; those with an equal neighbour are repeated: kind 0, and kind 1 for the first of each."""
    out: dict[str, list] = {"shard": [], "kind": [], "p": []}
    each, owners = [], []
    for shard, whole, e in zip(*(table[name].to_pylist() for name in ("shard", "whole", "e")), strict=True):
        if whole:
            for key, value in (("shard", shard), ("kind", 0), ("p", e)):
                out[key].append(value)
        else:
            each.append(np.frombuffer(e, entry))
            owners.append(np.full(len(each[-1]), shard, np.int32))
    if each:
        slim, owner = np.concatenate(each), np.concatenate(owners)
        del each, owners
        entries = np.zeros(len(slim), ENTRY)
        for name in entry.names:
            entries[name] = slim[name]
        if "h" not in entry.names:
            entries["h"] = slim["g"]
        order = by_hash(entries)
        entries, owner = entries[order], owner[order]
        first, p = firsts(entries), entries["p"]
        hit = ~(first & np.concatenate([first[1:], [True]])) | (p >= REPEATED)
        first, p, owner = first[hit], p[hit] & ~REPEATED, owner[hit]
        for kind, on in ((0, slice(None)), (1, first)):
            o, q = owner[on], p[on]
            order = np.argsort(o, kind="stable")
            o, q = o[order], q[order]
            cuts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(o)) if len(o) else [], strict=True):
                for key, value in (("shard", int(o[s])), ("kind", kind), ("p", packed(np.sort(q[s:e])))):
                    out[key].append(value)
    return pa.table(out, schema=_FOUND)


def positions_of(found: pa.Table, kind: int) -> np.ndarray:
    parts = [unpacked(p) for k, p in zip(found["kind"].to_pylist(), found["p"].to_pylist(), strict=True) if k == kind]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def interval_mask(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True where any interval [first, stop) lies; `first` ascends, empty intervals are skipped."""
    on = stop > first
    first, stop = first[on], np.maximum.accumulate(stop[on])
    steps = np.zeros(n + 1, np.int8)
    if len(first):
        new = np.concatenate([[True], first[1:] > stop[:-1]])
        steps[first[new]] = 1
        steps[stop[np.append(new[1:], True)]] = -1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


def leading(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number of some of a suffix's first bytes, which decides its block; equal suffixes are in one block."""
    x = np.zeros(len(starts), np.uint32)
    for k in (0, 3, 7, 12, 20, 33):
        x = (x ^ data[starts + k]) * np.uint32(0x9E3779B1)
    return x >> np.uint32(8)


def open_suffixes(shard: Shard, found: pa.Table) -> np.ndarray:
    """Starts that still need sorting, ascending.

    Found kinds: 0 cover samples with an equal one, 10 those whose whole context is repeated, 11 one of these for each
    context. A repeated context settles its suffixes; the suffixes of one such context stay open, for others to meet.
    """
    masks = []
    for kind in (0, 10, 11):
        first, last = shard.context(positions_of(found, kind))
        masks.append(interval_mask(shard.n, first, last + 1))
    sampled, settled, standing = masks
    return np.flatnonzero(sampled & (~settled | standing))


class Repeats:
    """The steps over one table of documents, which is written once, in shards; each step reads the shards where they lie."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.size = int(docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0)).alias("n")).first()["n"])
        self.shards = self.size // SHARD_BYTES + 1
        rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), text_of().cast("binary").alias("_bytes"), F.monotonically_increasing_id().alias("_key"))
        rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(self.shards)).cast("int"))
        self.rows = bucketed(rows, "shards", "_shard", min(self.shards, max(partitions(self.spark), self.shards // BUCKET_SHARDS)))
        self.texts = self.rows.drop("_row")
        self.empty = self.spark.range(0).select(F.lit(0).alias("shard"), F.lit(0).alias("kind"), F.lit(b"").alias("p"))

    def buckets(self, entries: float) -> int:
        return max(partitions(self.spark), int(entries // BUCKET_ENTRIES) + 1)

    def step(self, name: str, found: DataFrame, entries: float, emit, kind: np.dtype = ENTRY) -> DataFrame:
        """Emit entries from each shard with what is found of it so far, and sort them bucket by bucket."""
        buckets = self.buckets(entries)

        def dealt(texts: pa.Table, known: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return pa.table(deal(0, np.empty(0, ENTRY), buckets, kind), schema=_DEALT)
            shard = Shard(texts)
            return pa.table(deal(shard.shard, emit(shard, known), buckets, kind), schema=_DEALT)

        out = self.texts.groupBy("_shard").cogroup(found.groupBy("shard")).applyInArrow(dealt, DEALT)
        return written(out.groupBy("bucket").applyInArrow(lambda table: rank_bucket(table, kind), FOUND), name)

    def find(self) -> DataFrame:
        """shard, kind, p: 10 and 11 repeated contexts of cover samples, 20 repeated starts outside them."""
        short = LENGTH - PERIOD + 1

        def samples(shard: Shard, _: pa.Table) -> np.ndarray:
            at = shard.cover()
            return Hashes(shard.data).at(at, at + short)

        def contexts(shard: Shard, known: pa.Table) -> np.ndarray:
            at = positions_of(known, 0)
            low, high = shard.bounds(at)
            at = at[(at - PERIOD + 1 >= low) & (at + LENGTH <= high)]
            entries = Hashes(shard.data).at(at - PERIOD + 1, at + LENGTH)
            entries["p"] = at
            return entries

        density = len(COVER) / PERIOD
        ranks = self.step("cover-ranks", self.empty, self.size * density, samples, SHORT).where("kind = 0")
        settled = self.step("contexts", ranks, self.size * density / 2, contexts).select("shard", (F.col("kind") + 10).alias("kind"), "p")
        known = ranks.unionByName(settled)

        def count(texts: pa.Table, found: pa.Table) -> pa.Table:
            n = len(open_suffixes(Shard(texts), found)) if texts.num_rows else 0
            return pa.table({"n": pa.array([n], pa.int64())})

        counts = written(self.texts.groupBy("_shard").cogroup(known.groupBy("shard")).applyInArrow(count, "n long"), "open-suffixes")
        total = counts.agg(F.sum("n")).first()[0] or 0
        discard(counts)
        blocks = int(total // max(1.0, BLOCK_SHARE * self.size)) + 1
        for block in range(blocks):

            def suffixes(shard: Shard, found: pa.Table, block=block) -> np.ndarray:
                at = open_suffixes(shard, found)
                at = at[leading(shard.data, at) % np.uint32(blocks) == block]
                return Hashes(shard.data).at(at, at + LENGTH)

            rest = self.step(f"block-{block}", ranks.unionByName(settled), total / blocks, suffixes).where("kind = 0")
            known = known.unionByName(rest.select("shard", F.lit(20).alias("kind"), "p"))
        return known.where("kind >= 10")

    def apply(self, found: DataFrame, each, schema) -> DataFrame:
        """each(shard, mask) for every shard, with the mask of removed bytes; gives a table."""

        def run(texts: pa.Table, known: pa.Table) -> pa.Table:
            shard = Shard(texts)
            first, last = shard.context(positions_of(known, 10))
            more = positions_of(known, 20)
            mask = interval_mask(shard.n, first, np.where(last >= first, last + LENGTH, first))
            return each(shard, mask | interval_mask(shard.n, more, more + LENGTH))

        return self.rows.groupBy("_shard").cogroup(found.groupBy("shard")).applyInArrow(run, schema)


def kept_and_spans(shard: Shard, mask: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
    kept, removed, spans = [], [], []
    for part, start, stop in zip(shard.parts, shard.starts, shard.stops, strict=True):
        m = mask[start:stop]
        n = int(m.sum())
        removed.append(n)
        spans.append(int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if n else 0)
        kept.append(np.frombuffer(part, np.uint8)[~m].tobytes() if n else part)
    return kept, removed, spans


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    A byte goes if a 200-byte string over it also starts elsewhere, in any document or the same. Two equal strings have
    equal cover samples at one common offset below 133, so the first step sorts only the samples' 68-byte prefixes; the
    second settles long ties by whole contexts of samples; the third sorts the suffixes that stay open, one block at a
    time, as many blocks as hold each below a fixed share of all bytes. Strings of 96 equal bits of two hashes are taken for
    equal (chance gives that to 0.02 pairs of 100 TB). A null or empty
    text has no bytes, nothing removed and the digest of no bytes; texts under 200 bytes stay whole; repeated rows are
    copies of each other.
    """
    work = Repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def each(shard: Shard, mask: np.ndarray) -> pa.Table:
        kept, removed, spans = kept_and_spans(shard, mask)
        return pa.table(
            {
                "doc_id": shard.table["_row"].combine_chunks().field("doc_id"),
                "n_bytes": pa.array(shard.lengths, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            }
        )

    return work.apply(work.find(), each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes of repeated_substrings(); all rows and columns stay, n_chars follows.

    A character that loses some of its bytes goes whole, so that texts stay UTF-8. Null texts become empty.
    """
    work = Repeats(docs)
    fields = docs.schema.fields

    def each(shard: Shard, mask: np.ndarray) -> pa.Table:
        kept, _, _ = kept_and_spans(shard, mask)
        texts = [k.decode("utf-8", "ignore") for k in kept]
        row = shard.table["_row"].combine_chunks()
        out = {}
        for field in fields:
            if field.name == "text":
                out[field.name] = pa.array(texts, pa.string())
            elif field.name == "n_chars":
                out[field.name] = pa.array([len(t) for t in texts], row.field(field.name).type)
            else:
                out[field.name] = row.field(field.name)
        return pa.table(out)

    return work.apply(work.find(), each, docs.schema)


if sys.byteorder != "little":
    raise ImportError("packed positions are little-endian")
