"""Packing along a space-filling curve: Hilbert keys of projected document vectors, range sort, cuts at the sequence length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encode_ids, load_encoding, load_ranks
from .common import map_rows, partitions, small_batches, text_of, written

DIMS, BITS, FEATURES = 4, 8, 1024
SEQUENCE = 1024
#: Standard deviations from the mean at which a coordinate's cells end.
SPREAD = 2.5
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((FEATURES, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims), each coordinate below 2**bits (Skilling's transpose form)."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            on = (x[:, d] & q) > 0
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0])
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= swap
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[:, dims - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def cells_of(places: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Coordinates as integers below 2**BITS: SPREAD deviations to either side of the mean, what is beyond at the edge."""
    unit = np.divide(places - mean, SPREAD * spread, out=np.zeros_like(places), where=spread > 0)
    return np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def specials_of(tokenizer_path: str, rank_path: str) -> dict[str, int]:
    """The special strings of a tokenizer file and their ids; an error if its vocabulary, merges or splitting are not those
    of the ranks, by which texts are encoded here in less than half of the time."""
    with open(tokenizer_path, encoding="utf-8") as file:
        own = json.load(file)
    special = {t["content"]: t["id"] for t in own["added_tokens"]}
    if any(t.get(flag) for t in own["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("special strings that take what is beside them along are not told apart here")
    back, ranks = characters(), load_ranks(rank_path)
    vocab, merges = own["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
    same = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special} == ranks
    ordered = all(vocab["".join(m)] == 256 + k for k, m in enumerate(merges)) and len(merges) + 256 == len(ranks)
    splits = own["pre_tokenizer"]
    if not (same and ordered and splits["type"] == "ByteLevel" and not splits["add_prefix_space"] and own["normalizer"] is None):
        raise ValueError("the tokenizer file and the ranks are of different tokenizers")
    return special


def tokenizer_ids(encoding, text: str, special: dict[str, int]) -> np.ndarray:
    """As the tokenizer file encodes by default: its special strings inside a text become their ids."""
    found = [s for s in special if s in text]
    if not found:
        return encode_ids(encoding, text)
    parts: list[np.ndarray] = []
    for part in re.split("(" + "|".join(map(re.escape, found)) + ")", text):
        parts.append(np.array([special[part]], np.uint32) if part in special else encode_ids(encoding, part))
    return np.concatenate(parts)


def tokenised(docs: DataFrame, tokenizer_path: str, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 16-bit, with the final id 0) and place (binary: DIMS doubles).

    The place is the document's unit vector of token counts, hashed to FEATURES components, projected to DIMS.
    """
    small_batches(docs.sparkSession)
    special = specials_of(tokenizer_path, rank_path)

    def make():
        encoding = load_encoding(rank_path, pattern)
        if max(encoding.n_vocab, *special.values(), 0) > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits an id")
        plane = projection()
        hashed = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)).astype(np.int64) % FEATURES

        def each(cols: dict) -> dict:
            ids = [np.append(tokenizer_ids(encoding, t, special), 0).astype("<u2") for t in cols["text"]]
            counts = np.stack([np.sqrt(np.bincount(hashed[x], minlength=FEATURES)) for x in ids])
            places = counts / np.linalg.norm(counts, axis=1, keepdims=True) @ plane
            return {"doc_id": cols["doc_id"], "ids": [x.tobytes() for x in ids], **{f"x{d}": places[:, d].tolist() for d in range(DIMS)}}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(rows, make, f"doc_id long, ids binary, {', '.join(f'x{d} double' for d in range(DIMS))}")


def along_curve(rows: DataFrame) -> DataFrame:
    """doc_id, ids, curve of tokenised rows: the Hilbert key of the place, in cells laid around the mean of all places.

    The mean and deviation of each coordinate are all that is taken from the corpus, by partial sums.
    """
    names = [f"x{d}" for d in range(DIMS)]
    stats = rows.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    mean, spread = (np.array([stats[f"{k}{n}"] or 0.0 for n in names]) for k in "ms")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("curve", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.column_stack([batch.column(2 + d).to_numpy(zero_copy_only=False) for d in range(DIMS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(cells_of(places, mean, spread)), pa.int64())], schema=schema)

    return rows.select("doc_id", "ids", *names).mapInArrow(run, "doc_id long, ids binary, curve long")


class Sequences:
    """Deals pieces to sequences of one partition; keeps the open sequence only."""

    def __init__(self, first_id: int, size: int) -> None:
        self.id, self.size, self.filled = first_id, size, 0
        self.open: list[tuple[int, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple[int, int, np.ndarray, int]]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.id, at))
            at += len(ids)
        self.id += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.filled]
            self.open.append((doc, start, part, len(ids)))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.size:
                self.close(self.open)
                self.open, self.filled = [], 0

    def finish(self) -> None:
        """The rest of a partition goes to sequences of powers of two, which need no padding."""
        queue = self.open
        for bit in range(self.filled.bit_length() - 1, -1, -1):
            want = self.filled & (1 << bit)
            pieces = []
            while want:
                doc, start, ids, total = queue.pop(0)
                if len(ids) > want:
                    queue.insert(0, (doc, start + want, ids[want:], total))
                    ids = ids[:want]
                pieces.append((doc, start, ids, total))
                want -= len(ids)
            if pieces:
                self.close(pieces)
        self.open, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer_path: str, rank_path: str, pattern: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised once and written; a range sort by (Hilbert key, doc_id) then puts neighbours on the curve
    into one partition, where they are cut into full sequences. What is left at the end of a partition fills sequences of
    powers of two, so no sequence is padded. A null or empty text is the single id 0. Copies share a key and are parted
    by doc_id; repeated rows are packed row by row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = along_curve(written(tokenised(docs, tokenizer_path, rank_path, pattern), "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Sequences(TaskContext.get().partitionId() << 40, size)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                deal.add(doc, np.frombuffer(ids.as_buffer(), "<u2"))
            yield deal.take()
        deal.finish()
        yield deal.take()

    # a number of the row spreads rows that are alike in all else over tasks
    order = ["curve", "doc_id", "row"]
    return rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, PIECES)
