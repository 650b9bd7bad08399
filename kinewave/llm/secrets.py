"""Secret scans with DataFrame functions only: three kinds of patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The three base patterns, and the least lengths of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan: maximal runs of the widest class, with a digit and a letter, WINDOW long with padding.
#: A run ends at "=", which counts as padding only at its end, so that in NAME=value the value is judged alone.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{18,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Matches whose places are summed at a time, and counts of characters in a long, of BITS each.
CHUNK, PACKED, BITS = 64, 12, 5
#: Least entropy in bits a character, by the class of a window's characters; a window of 20 has 4.32 at most.
LIMITS = {"hex": 3.1, "alnum": 3.7, "base64": 3.9}
#: Allow-list: what looks random but is no secret (UUIDs, dates and paths, words joined by marks, values made up of stand-ins).
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=/+-]+$",
    r"^[A-Za-z]*[-_/][A-Za-z/_-]+[0-9]{0,4}$",
    r"^(?i:(?:example|sample|placeholder|x{4,}+|changeme)[-_/+]*+[0-9]{0,4}+[-_/+]*+)++=*$",
)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<s,e,value>> of leftmost non-overlapping matches in code points; value is of the group (or the whole).

    Starts are sums over the gaps that split() leaves between matches and the matches before.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n")))
    made = F.zip_with(places(parts), values, lambda x, v: F.struct(x.s.alias("s"), x.e.alias("e"), v.alias("value")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<s:int,e:int,value:string>>"))


def places(parts: Column) -> Column:
    """array<struct<s,e>> of lengths (g before, n within). Summed in chunks, so that a text of many matches is not copied for each."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def within(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc.at + x.g + x.n).alias("at"), F.concat(acc.out, F.array(F.struct((acc.at + x.g).alias("s"), (acc.at + x.g + x.n).alias("e")))).alias("out")
            ),
        )

    starts = F.sequence(F.lit(1), F.size(parts), F.lit(CHUNK))
    chunks = F.transform(starts, lambda i: within(F.slice(parts, i, F.lit(CHUNK))))
    moved = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int>>>").alias("out")),
        lambda acc, c: F.struct(
            (acc.at + c.at).alias("at"), F.concat(acc.out, F.array(F.transform(c.out, lambda x: F.struct((x.s + acc.at).alias("s"), (x.e + acc.at).alias("e"))))).alias("out")
        ),
        lambda acc: F.flatten(acc.out),
    )
    return F.when(F.size(parts) > 0, moved).otherwise(none)


def best_margin(value: Column, window: int = WINDOW) -> Column:
    """The largest excess of a window's Shannon entropy over the limit of its class, over all windows of the string.

    From window to window one character comes in and one goes out. The counts of the ALPHABET are BITS bits each, PACKED in
    a long, so a step changes at most two of a few longs; with f(n) = n log2 n the sum of f over the counts changes in two
    places, and the entropy is log2(window) - sum / window. The class follows from how many characters of the window are
    no hexadecimal digits, and how many are no letters or digits; these counts are carried along as well. Null for a string
    shorter than the window.
    """
    longs = -(-len(ALPHABET) // PACKED)
    f = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    wide = F.array(*[F.lit(0 if c in "0123456789abcdefABCDEF" else 1 if c.isalnum() else 2) for c in ALPHABET])
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)).alias("old"), i.alias("i")))
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("off_hex"), F.lit(0).alias("off_alnum"), F.lit(None).cast("double").alias("best")
    )
    slot = lambda code: F.floor(code / PACKED).cast("int")
    shift = lambda code: (code % PACKED * BITS).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))
    count = lambda n, code: F.call_function("shiftright", F.get(n, slot(code)), shift(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        goes = x.old >= 0
        n_old = F.when(goes, count(acc.n, x.old))
        less = F.when(goes, F.get(f, n_old - 1) - F.get(f, n_old)).otherwise(F.lit(0.0))
        n_new = count(acc.n, x.new) - F.when(goes & (x.old == x.new), 1).otherwise(0)
        s = acc.s + less + F.get(f, n_new + 1) - F.get(f, n_new)
        counts = F.transform(
            acc.n, lambda v, j: v + F.when(j == slot(x.new), one(x.new)).otherwise(0) - F.when(goes & (j == slot(x.old)), one(x.old)).otherwise(0)
        )
        kind, gone = F.get(wide, x.new), F.when(goes, F.get(wide, x.old)).otherwise(0)
        off_hex = acc.off_hex + (kind > 0).cast("int") - (gone > 0).cast("int")
        off_alnum = acc.off_alnum + (kind > 1).cast("int") - (gone > 1).cast("int")
        limit = F.when(off_hex == 0, LIMITS["hex"]).when(off_alnum == 0, LIMITS["alnum"]).otherwise(LIMITS["base64"])
        margin = F.lit(math.log2(window)) - s / window - limit
        best = F.when(x.i >= window - 1, F.greatest(acc.best, margin)).otherwise(acc.best)
        return F.struct(counts.alias("n"), s.alias("s"), off_hex.alias("off_hex"), off_alnum.alias("off_alnum"), best.alias("best"))

    return F.aggregate(steps, zero, step, lambda acc: acc.best)


def entropy_spans(text: Column) -> Column:
    """Spans of candidates with a random-looking window, without those on the allow-list."""

    def secret(x: Column) -> Column:
        value = x.value
        mixed = (F.length(value) >= WINDOW) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | value.rlike(pattern)
        return F.when(mixed & ~allowed, best_margin(value) >= -1e-9).otherwise(F.lit(False))

    return F.filter(matches(text, CANDIDATE), secret)


def tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(kind).alias("k"), x.e.alias("e")))


def scanned(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column more, a struct of arrays: assign, access, hex, and base and spans of (s, k, e) by start, then kind.

    Spans are in code points, their ends exclusive. The entropy scan adds spans where no base span lies. The column gets
    the given name, and no other column is touched, whatever it is called.
    """
    text, own = text_of(), F.col(name)
    kinds = [F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x.value) >= ASSIGN_LEAST), matches(text, ACCESS), matches(text, HEX)]
    first = docs.withColumn(name, F.struct(*[c.alias(k) for c, k in zip(kinds, KINDS, strict=False)], entropy_spans(text).alias("more")))
    base = F.array_sort(F.concat(*[tagged(own[kind], k) for k, kind in enumerate(KINDS[:3])]))
    second = first.withColumn(name, own.withField("base", base))
    clear = F.filter(own["more"], lambda x: ~F.exists(own["base"], lambda b: (b.s < x.e) & (x.s < b.e)))
    return second.withColumn(name, own.withField("spans", F.array_sort(F.concat(own["base"], tagged(clear, 3)))).dropFields("more"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s, x.e)), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text).

    A null or empty text has no spans: counts 0, the digest of the empty string, spans empty. Repeated rows are scanned
    row by row; whole texts are scanned; no shuffle and no Python.
    """
    found = F.col("found")
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "found")
    return rows.select(
        "doc_id",
        *[F.size(found[kind]).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(found["base"]).cast("binary"), 256).alias("base_sha256"),
        listed(found["spans"]).alias("spans"),
    )


def redacted(docs: DataFrame, tag: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by the tag, overlapping spans by one; n_chars follows.

    Null texts stay null; all other columns stay as they are, whatever their names.
    """
    name = f"found_{uuid.uuid4().hex}"
    text, spans = F.col("text"), F.col(name)["spans"]
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    kept = F.aggregate(
        spans,
        zero,
        lambda acc, x: F.when(
            x.s >= acc.at,
            F.struct(F.concat(acc.out, F.substring(text, acc.at + 1, x.s - acc.at), F.lit(tag)).alias("out"), x.e.alias("at")),
        ).otherwise(F.struct(acc.out.alias("out"), F.greatest(acc.at, x.e).alias("at"))),
        lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))),
    )
    rows = scanned(docs, name).withColumn("text", F.when(F.size(spans) > 0, kept).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
