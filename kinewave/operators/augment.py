"""Augmentation of padded sequences: rows (recording_id, real_len, seq), seq being an array of WIDTH frames (arrays)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the augmentation.
WARPS = (0.7, 0.85, 1.15, 1.3)
SHIFTS = (0.5, 1.0, -0.5, -1.0)
LEAST_SHIFT, NOISE, MOST_DROPPED, REPEATS = 10, 0.01, 3, 8


def to_width(seq: Column, width: int, channels: int) -> Column:
    """The first `width` frames, zero frames behind."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), channels), width)
    return F.slice(F.concat(seq, zero), 1, width)


def time_warp(rows: DataFrame, width: int, channels: int, factors: tuple[float, ...] = WARPS) -> DataFrame:
    """recording_id, factor, real_len, seq: the real frames resampled to round(n * factor) frames, 2 to width (half-even).

    Fewer than two real frames stay as they are.
    """
    each = rows.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors]))).withColumnRenamed("real_len", "_n")
    n = F.col("_n")  # a name of its own, as a select would take the new real_len in lambdas
    size = F.greatest(F.lit(2), F.least(F.lit(width), F.bround(n * F.col("factor")).cast("int")))
    # columns of their own, as a lambda evaluates what stands in it for every frame
    each = each.withColumn("_m", size).withColumn("_real", F.slice("seq", 1, n))
    m, real = F.col("_m"), F.col("_real")

    def at(i: Column) -> Column:
        p = i * (n - 1) / (m - 1)
        low = F.floor(p).cast("int")
        return F.zip_with(F.get(real, low), F.get(real, F.least(low + 1, n - 1)), lambda a, b: a + (b - a) * (p - low))

    warped = F.when(n >= 2, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.col("seq"))
    return each.select("recording_id", "factor", F.when(n >= 2, m).otherwise(n).alias("real_len"), to_width(warped, width, channels).alias("seq"))


def temporal_shift(rows: DataFrame, width: int, channels: int, shares: tuple[float, ...] = SHIFTS) -> DataFrame:
    """recording_id, shift, real_len, seq: real frames moved by a share of max(10, width - n), cut toward zero."""
    each = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumnRenamed("real_len", "_n")
    n = F.col("_n")
    shift = (F.col("share") * F.greatest(F.lit(LEAST_SHIFT), width - n)).cast("int")
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), channels), F.greatest(shift, F.lit(0)))
    real = F.slice("seq", 1, n)
    moved = F.when(shift >= 0, F.concat(zero, real)).otherwise(F.slice(real, 1 - F.least(shift, F.lit(0)), F.greatest(n, F.lit(0))))
    size = F.when(shift >= 0, F.least(n, width - shift)).otherwise(n + shift)
    return each.select("recording_id", shift.alias("shift"), F.greatest(size, F.lit(0)).alias("real_len"), to_width(moved, width, channels).alias("seq"))


def drawn(key: Column, seed: int, *place: Column) -> Column:
    """A whole number below 2**32, by a hash of key, seed and place: retries draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), *[p.cast("string") for p in place]).cast("binary")), 1, 8), 16, 10).cast("long")


def noisy(seq: Column, n: Column, key: Column, flex: int, seed: int = 42, sigma: float = NOISE) -> Column:
    """seq with normal noise on the flex channels of its n real frames, clipped to 0 to 1."""
    unit = lambda i, c, k: (drawn(key, seed + k, i, c) + 0.5) / float(1 << 32)

    def frame(f: Column, i: Column) -> Column:
        def one(x: Column, c: Column) -> Column:
            g = F.sqrt(-2 * F.log(unit(i, c, 0))) * F.cos(6.283185307179586 * unit(i, c, 1))
            return F.when((c < flex) & (i < n), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + sigma * g))).otherwise(x)

        return F.transform(f, one)

    return F.transform(seq, frame)


def dropped(seq: Column, n: Column, key: Column, channels: int, seed: int = 42) -> Column:
    """seq with one to three real frames in a row at zero; sequences of fewer than four real frames stay."""
    size = (1 + drawn(key, seed + 2) % MOST_DROPPED).cast("int")
    first = (drawn(key, seed + 3) % F.greatest(n - size, F.lit(1))).cast("int")
    gone = F.transform(F.sequence(F.lit(0), F.size(seq) - 1), lambda i: (i >= first) & (i < first + size))
    zero = F.array_repeat(F.lit(0.0), channels)
    return F.when((n >= 4) & (n - size >= 1), F.zip_with(seq, gone, lambda f, g: F.when(g, zero).otherwise(f))).otherwise(seq)


def flex_noise(rows: DataFrame, flex: int, seed: int = 42, sigma: float = NOISE) -> DataFrame:
    """Normal noise on the flex channels of real frames; see noisy()."""
    return rows.withColumn("seq", noisy(F.col("seq"), F.col("real_len"), F.col("recording_id"), flex, seed, sigma))


def frame_dropout(rows: DataFrame, channels: int, seed: int = 42) -> DataFrame:
    """One to three real frames in a row become zero; see dropped()."""
    return rows.withColumn("seq", dropped(F.col("seq"), F.col("real_len"), F.col("recording_id"), channels, seed))


#: A transform gives, from rows (_key, _n, _seq, _real), an array of its copies (tag, n, seq); _real are the n real frames.
Transform = Callable[[int, int, int, int], Column]


def copy_of(tag: str, n: Column, seq: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), n.cast("int").alias("n"), seq.alias("seq"))


def warps(width: int, channels: int, flex: int, seed: int, factors: tuple[float, ...] = WARPS) -> Column:
    n, real = F.col("_n"), F.col("_real")

    def one(k: int) -> Column:
        m = F.greatest(F.lit(2), F.least(F.lit(width), F.bround(n * F.lit(float(factors[k]))).cast("int")))

        def at(i: Column) -> Column:
            p = i * (n - 1) / (m - 1)
            low = F.floor(p).cast("int")
            return F.zip_with(F.get(real, low), F.get(real, F.least(low + 1, n - 1)), lambda a, b: a + (b - a) * (p - low))

        return copy_of(f"w{k}", F.when(n >= 2, m).otherwise(n), to_width(F.when(n >= 2, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.col("_seq")), width, channels))

    return F.array(*map(one, range(len(factors))))


def shifts(width: int, channels: int, flex: int, seed: int, shares: tuple[float, ...] = SHIFTS) -> Column:
    n, real = F.col("_n"), F.col("_real")

    def one(k: int) -> Column:
        by = (F.lit(float(shares[k])) * F.greatest(F.lit(LEAST_SHIFT), width - n)).cast("int")
        zero = F.array_repeat(F.array_repeat(F.lit(0.0), channels), F.greatest(by, F.lit(0)))
        moved = F.when(by >= 0, F.concat(zero, real)).otherwise(F.slice(real, 1 - F.least(by, F.lit(0)), F.greatest(n, F.lit(0))))
        return copy_of(f"s{k}", F.greatest(F.when(by >= 0, F.least(n, width - by)).otherwise(n + by), F.lit(0)), to_width(moved, width, channels))

    return F.array(*map(one, range(len(shares))))


def noise_copy(width: int, channels: int, flex: int, seed: int) -> Column:
    return F.array(copy_of("n", F.col("_n"), noisy(F.col("_seq"), F.col("_n"), F.col("_key"), flex, seed)))


def dropout_copy(width: int, channels: int, flex: int, seed: int) -> Column:
    return F.array(copy_of("d", F.col("_n"), dropped(F.col("_seq"), F.col("_n"), F.col("_key"), channels, seed)))


TRANSFORMS = {"time_warp": warps, "flex_noise": noise_copy, "temporal_shift": shifts, "frame_dropout": dropout_copy}


#: Rows whose copies are made together, and messages that are hashed together.
ROWS, MESSAGES = 32, 4096
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)


def first_words(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of messages, as numbers; blocks: padded messages (count, 64), of 55 bytes at most."""
    out = np.empty(len(blocks), np.uint32)
    for at in range(0, len(blocks), MESSAGES):
        words = np.ascontiguousarray(blocks[at : at + MESSAGES].view("<u4").T)
        used = words.any(axis=1)
        a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, turned = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                g = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
                g = 7 * i % 16
            f += a
            f += _SINES[i]
            if used[g]:
                f += words[g]
            turn = _TURNS[i // 16, i % 4]
            np.left_shift(f, turn, out=turned)
            f >>= np.uint32(32) - turn
            f |= turned
            f += b
            a, b, c, d, f = d, f, b, c, a
        out[at : at + MESSAGES] = (a + np.uint32(0x67452301)).byteswap()
    return out


def letters(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text (an array of type S), zeros behind, and its length."""
    return np.frombuffer(np.ascontiguousarray(texts).tobytes(), np.uint8).reshape(len(texts), texts.dtype.itemsize), np.char.str_len(texts)


def drawn_numbers(keys: np.ndarray, seeds: list[int], places: np.ndarray | None = None, row: np.ndarray | None = None, place: np.ndarray | None = None) -> list[np.ndarray]:
    """As drawn() by each seed, of keys (an array of type S), or of keys[row] and places[place], which are texts ("12:0")."""
    row = np.arange(len(keys)) if row is None else row
    if not len(row):
        return [np.empty(0, np.int64) for _ in seeds]
    ends = np.zeros(1, "S1") if places is None else np.char.add(b":", places)
    place = np.zeros(len(row), np.int64) if place is None else place
    (text, n), (end, m), out = letters(keys), letters(ends), []
    for seed in seeds:
        head = np.frombuffer(f"{seed}:".encode(), np.uint8)
        size = len(head) + n[row] + m[place]
        if size.max() > 55:
            whole = (head.tobytes() + keys[i] + ends[j] for i, j in zip(row.tolist(), place.tolist(), strict=True))
            out.append(np.array([int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in whole], np.int64))
            continue
        base, wide = np.zeros((len(keys), 64), np.uint8), min(text.shape[1], 55 - len(head))
        base[:, : len(head)], base[:, len(head) : len(head) + wide] = head, text[:, :wide]
        blocks = base[row]
        flat, at = blocks.reshape(-1), np.arange(len(row)) * 64 + len(head) + n[row]
        for j in range(m.max()):
            flat[at + np.minimum(j, m[place])] = end[place, np.minimum(j, m[place] - 1)]
        flat[np.arange(len(row)) * 64 + size] = 128
        blocks[:, 56:58] = (8 * size).astype("<u2").view(np.uint8).reshape(-1, 2)
        out.append(first_words(blocks).astype(np.int64))
    return out


def warped_copies(keys: np.ndarray, n: np.ndarray, seq: np.ndarray, flex: int, seed: int) -> list[tuple]:
    """(tag, n, seq) of each copy of rows with n real frames of seq (rows, width, channels); the same as warps()."""
    width, i, out = seq.shape[1], np.arange(seq.shape[1]), []
    for k, factor in enumerate(WARPS):
        m = np.maximum(2, np.minimum(width, np.round(n * factor).astype(np.int64)))
        p = i * (n[:, None] - 1) / (m[:, None] - 1)
        low = np.clip(np.floor(p).astype(np.int64), 0, width - 1)
        high = np.clip(np.minimum(low + 1, n[:, None] - 1), 0, width - 1)
        a, b = (np.take_along_axis(seq, x[:, :, None], axis=1) for x in (low, high))
        new = np.where((i < m[:, None])[:, :, None], a + (b - a) * (p - np.floor(p))[:, :, None], 0.0)
        out.append((f"w{k}", np.where(n >= 2, m, n), np.where((n >= 2)[:, None, None], new, seq)))
    return out


def shifted_copies(keys: np.ndarray, n: np.ndarray, seq: np.ndarray, flex: int, seed: int) -> list[tuple]:
    width, i, out = seq.shape[1], np.arange(seq.shape[1]), []
    for k, share in enumerate(SHIFTS):
        by = np.trunc(share * np.maximum(LEAST_SHIFT, width - n)).astype(np.int64)
        at = i - by[:, None]
        new = np.where(((at >= 0) & (at < n[:, None]))[:, :, None], np.take_along_axis(seq, np.clip(at, 0, width - 1)[:, :, None], axis=1), 0.0)
        out.append((f"s{k}", np.maximum(np.where(by >= 0, np.minimum(n, width - by), n + by), 0), new))
    return out


def noisy_copies(keys: np.ndarray, n: np.ndarray, seq: np.ndarray, flex: int, seed: int) -> list[tuple]:
    out = seq.copy()
    row, i, c = np.nonzero(np.broadcast_to((np.arange(seq.shape[1]) < n[:, None])[:, :, None], (len(n), seq.shape[1], min(flex, seq.shape[2]))))
    places = np.array([f"{t}:{channel}".encode() for t in range(seq.shape[1]) for channel in range(seq.shape[2])], "S")
    u, w = ((x + 0.5) / float(1 << 32) for x in drawn_numbers(keys, [seed, seed + 1], places, row, i * seq.shape[2] + c))
    out[row, i, c] = np.maximum(0.0, np.minimum(1.0, seq[row, i, c] + NOISE * (np.sqrt(-2 * np.log(u)) * np.cos(6.283185307179586 * w))))
    return [("n", n, out)]


def dropped_copies(keys: np.ndarray, n: np.ndarray, seq: np.ndarray, flex: int, seed: int) -> list[tuple]:
    long, start = drawn_numbers(keys, [seed + 2, seed + 3])
    size = 1 + long % MOST_DROPPED
    first, i = start % np.maximum(n - size, 1), np.arange(seq.shape[1])
    gone = (i >= first[:, None]) & (i < (first + size)[:, None]) & ((n >= 4) & (n - size >= 1))[:, None]
    return [("d", n, np.where(gone[:, :, None], 0.0, seq))]


COPIES = {"time_warp": warped_copies, "flex_noise": noisy_copies, "temporal_shift": shifted_copies, "frame_dropout": dropped_copies}


def copies_of(names: list, n: np.ndarray, seq: np.ndarray, flex: int, repeats: int, seed: int) -> tuple[np.ndarray, ...]:
    """row, repeat, path, n, seq of all copies of rows whose recordings have these names (None: no name)."""
    row, repeat = np.repeat(np.arange(len(n)), repeats), np.tile(np.arange(repeats), len(n))
    path = np.array([(f"{name}:{k}" if name is not None else f"{k}").encode() for name in names for k in range(repeats)], "S")
    n, seq = n[row], seq[row]
    kinds = sorted(COPIES)
    every = np.arange(len(path))
    draws = np.stack([drawn_numbers(path, [seed], np.array(kinds, "S"), every, np.full(len(path), k))[0] for k in range(len(kinds))], axis=1)
    order = np.argsort(draws, axis=1, kind="stable")  # equal draws: by name
    for step in range(len(kinds)):
        parts = []
        for kind, name in enumerate(kinds):
            own = np.flatnonzero(order[:, step] == kind)
            if len(own):
                parts += [(row[own], repeat[own], order[own], np.char.add(path[own], f"|{tag}".encode()), m, x) for tag, m, x in COPIES[name](path[own], n[own], seq[own], flex, seed)]
        row, repeat, order, path, n, seq = (np.concatenate(c) for c in zip(*parts, strict=True))
    return row, repeat, path, n, seq


def augmented(rows: DataFrame, width: int, channels: int, flex: int, repeats: int = REPEATS, transforms: dict[str, Transform] | None = None, seed: int = 42, of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """recording_id, repeat, path, real_len, seq: copies of each row by all transforms, in an order drawn for each repeat.

    transforms: name to Transform, TRANSFORMS by default (4 warps x 4 shifts, noise and dropout: 16 copies a repeat). The
    order of a row's repeat is that of hashes of the names. Each step makes all copies of the row's next transform, and path
    (recording, repeat, then the tags of the steps) is the key of its draws, so that copies differ in noise and dropout. Rows
    are exploded step by step, in one pass: in NumPy, ROWS rows at a time, or given transforms as expressions. of: a number of
    each copy, from arrays (copies, width, channels), that comes in place of seq as the column value.
    """
    if transforms is None:
        return augmented_rows(rows, width, channels, flex, repeats, seed, of)
    if of is not None:
        raise ValueError("given transforms are expressions; so is what is taken of their copies")
    every = transforms
    key = F.concat_ws(":", F.col("recording_id").cast("string"), F.col("repeat").cast("string"))
    out = rows.select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), F.col("real_len").cast("int").alias("_n"), F.col("seq").alias("_seq")).withColumn("_key", key)
    order = F.sort_array(F.array(*[F.struct(drawn(F.col("_key"), seed, F.lit(name)).alias("h"), F.lit(name).alias("name")) for name in every]))
    out = out.withColumn("_order", F.transform(order, lambda x: x["name"]))
    for step in range(len(every)):
        copies = None
        for name, make in every.items():
            own = make(width, channels, flex, seed)
            copies = F.when(F.col("_order")[step] == name, own) if copies is None else copies.when(F.col("_order")[step] == name, own)
        each = out.withColumn("_real", F.slice("_seq", 1, F.col("_n"))).select("recording_id", "repeat", "_key", "_order", F.explode(copies).alias("_x"))
        out = each.select("recording_id", "repeat", F.concat_ws("|", "_key", "_x.tag").alias("_key"), "_order", F.col("_x.n").alias("_n"), F.col("_x.seq").alias("_seq"))
    return out.select("recording_id", "repeat", F.col("_key").alias("path"), F.col("_n").alias("real_len"), F.col("_seq").alias("seq"))


def augmented_rows(rows: DataFrame, width: int, channels: int, flex: int, repeats: int, seed: int, of: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """augmented() by all transforms; see there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                seq = some["seq"].flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, width, channels)
                n = some["real_len"].to_numpy(zero_copy_only=False).astype(np.int64)
                row, repeat, path, left, copies = copies_of(some["name"].to_pylist(), n, seq, flex, repeats, seed)
                if of is None:
                    frames = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * width * channels + 1, channels), pa.int32()), pa.array(copies.ravel()))
                    last = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * width + 1, width), pa.int32()), frames)
                else:
                    last = pa.array(of(copies), pa.float64())
                ids = some["recording_id"].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(repeat, pa.int32()), pa.array(path.astype("U"), pa.string()), pa.array(left, pa.int32()), last], names=["recording_id", "repeat", "path", "real_len", "seq" if of is None else "value"])

    own = rows.select("recording_id", F.col("recording_id").cast("string").alias("name"), "real_len", "seq")
    return own.mapInArrow(run, f"recording_id {dict(rows.dtypes)['recording_id']}, repeat int, path string, real_len int, " + ("seq array<array<double>>" if of is None else "value double"))
