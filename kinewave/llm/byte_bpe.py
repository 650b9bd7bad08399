"""Byte-level BPE by the tiktoken library from a local rank file, with safe cuts of long texts and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, safe_cuts, small_batches, text_of

CHUNK_CHARS = 32_768


def load_ranks(rank_path: str) -> dict[bytes, int]:
    with open(rank_path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def load_encoding(rank_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(rank_path), special_tokens={})


def word_cut(text: str, i: int) -> bool:
    """Before white space that follows another character: no match of the pattern goes on over such a place.

    Also between a letter or digit run and the other: each alternative holds one class only.
    """
    a, b = text[i - 1], text[i]
    if b in " \n\t\r":
        return not a.isspace()
    return a.isalpha() and b.isdecimal() or a.isdecimal() and b.isalpha()


def encode_ids(encoding, text: str, limit: int = CHUNK_CHARS) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    if len(text) <= limit:
        return encoding.encode_to_numpy(text)
    cuts = safe_cuts(text, limit, word_cut)
    return np.concatenate([encoding.encode_to_numpy(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])


def decode_ids(encoding, ids: np.ndarray) -> bytes:
    """The raw bytes behind ids; a cut inside a character needs no repair, as bytes are joined before any decoding."""
    return encoding.decode_bytes(ids.tolist())


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids."""
    small_batches(docs.sparkSession)

    def make():
        encoding = load_encoding(rank_path, pattern)
        return lambda cols: {"doc_id": cols["doc_id"], "ids": [encode_ids(encoding, t).astype(np.int32).tolist() for t in cols["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, "doc_id long, ids array<int>")


def decode(rows: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of rows (doc_id, ids); null ids decode to no bytes."""
    small_batches(rows.sparkSession)

    def make():
        encoding = load_encoding(rank_path, pattern)
        return lambda cols: {"doc_id": cols["doc_id"], "decoded": [encoding.decode_bytes(ids or []) for ids in cols["ids"]]}

    return map_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding of every whole text in one pass.

    A null or empty text has no ids, and both digests are those of no bytes. Repeated rows are encoded row by row.
    """
    small_batches(docs.sparkSession)

    def make():
        encoding = load_encoding(rank_path, pattern)

        def each(cols: dict) -> dict:
            ids = [encode_ids(encoding, t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decode_ids(encoding, x)).hexdigest() for x in ids],
            }

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
