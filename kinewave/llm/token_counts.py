"""Token counts: lengths of a sentencepiece encoding, by Arrow batches balanced by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, safe_cuts, small_batches, text_of

CHUNK_CHARS = 16_384
BATCH_BYTES = 1 << 18
MARK = "▁"


def space_cut(text: str, i: int) -> bool:
    """A single space between two other characters: no piece has the space mark after another character.

    The rest is encoded without that space, as the encoder puts one before every text.
    """
    return text[i] == " " and text[i - 1] not in (" ", MARK) and i + 1 < len(text)


def pieces_of(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    if len(text) <= limit:
        return [text]
    cuts = safe_cuts(text, limit, space_cut)
    return [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]


def counter(model_path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    inner = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    limit = (1 << 62) if inner else CHUNK_CHARS

    def count(texts: list[str]) -> list[int]:
        totals, held, owners, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            nonlocal size
            for owner, ids in zip(owners, sp.encode(held, num_threads=1), strict=True):
                totals[owner] += len(ids)
            held.clear()
            owners.clear()
            size = 0

        for k, text in enumerate(texts):
            for piece in pieces_of(text, limit):
                held.append(piece)
                owners.append(k)
                size += len(piece.encode())
                if size >= BATCH_BYTES:
                    flush()
        if held:
            flush()
        return totals

    return count


def token_counts(docs: DataFrame, model_path: str, max_tokens: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are counted row by row; long texts are cut
    only before a space that follows another character, which no piece of the vocabulary spans; further columns are
    ignored. No shuffle: each Arrow batch returns lengths only.
    """
    small_batches(docs.sparkSession)

    def make():
        count = counter(model_path)

        def each(cols: dict) -> dict:
            n = count(cols["text"])
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": n, "over_limit": [x > max_tokens for x in n]}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
