"""Importance resampling towards a target: documents are drawn by how much likelier their features are in the target table.

Identical texts are one row while features and weights are made: texts are grouped whole, counts are multiplied by how often
a text stands, and a text's weight goes back to its documents, whose noise is their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewave.operators.numbering import numbered

from .common import discard, joined_back, text_of, written

#: What a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Parts of a weight: weights are whole numbers of thousandths.
UNIT = 1000


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(F.translate(text, *LETTERS), F.lit(WORD), F.lit(0))


def runs_of(words: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words, joined by a space, repeats included."""

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *map(of, range(2, n + 1))) if n > 1 else words


def collapsed(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """digest, copies, n_words, buckets of the distinct texts: the rows that have a text, and the bucket of each of its features.

    Rows are grouped by the whole text, counts first, so a text that a third of all rows hold is one row a task. What stays
    of the text is its SHA-256, by which its weight finds the rows again.
    """
    each = texts.select(text_of().alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    each = each.select(F.sha2("text", 256).alias("digest"), "copies", words_of(F.col("text")).alias("words"))
    bucket = F.transform(runs_of(F.col("words"), n), lambda w: (F.crc32(w) % buckets).cast("int"))
    return each.select("digest", "copies", F.size("words").alias("n_words"), bucket.alias("buckets"))


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """bucket and the count `name` of the features of all rows that the distinct texts stand for."""
    return texts.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket: log of how much likelier it is in the target, each bucket counted once more, in thousandths, cut down.

    A row per bucket comes to the driver, so `buckets` bounds it, whatever the tables hold.
    """
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = written(every.join(bucket_counts(source, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").fillna(0), "gains")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t").cast("double") + 1) * float(total.s + buckets)) / ((F.col("s").cast("double") + 1) * float(total.t + buckets))
    found = counts.select("bucket", F.floor(UNIT * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    discard(counts)
    return [r.gain for r in found]


def weight_of(column: Column, gain: list[int]) -> Column:
    """Sum of the gains of an array of buckets; the table of gains is one constant of the plan."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(column, F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))


def noise(doc_id: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution in thousandths, cut down, by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) of every row of docs (doc_id, text); target: text.

    Features are runs of 1 to n words, hashed by CRC-32. rank numbers the floor(percent * N / 100) best of the N rows that
    have `least_words` words, ties to the smaller doc_id; it is null elsewhere, so a filter on it is the sample. The score
    adds noise to the weight, drawn from the doc_id. Null texts have no words, so a weight of 0; a null doc_id is hashed as
    the empty text and comes last among ties; of repeated rows each is ranked, in any order. Empty tables give no rows; with
    an empty target only the prior count of 1 speaks for a bucket. Other columns are not read.
    """
    source = written(collapsed(docs, n, buckets), "texts")
    aim = written(collapsed(target, n, buckets), "target")
    weight = weight_of(F.col("buckets"), gains(source, aim, buckets))
    weights = written(source.select("digest", "copies", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")), "weights", source, aim)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_of(), 256).alias("digest"))
    scored = joined_back(rows, weights, "digest").select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("full"))
    scored = written(scored, "scored", weights)
    drawn = scored.where("full").count() * percent // 100
    ranks = numbered(scored, [F.desc("full"), F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranks.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
