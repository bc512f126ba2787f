"""Hash columns. xxhash64 is the fast choice; the bit-exact ones run over Arrow batches in numpy or the standard library."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of Murmur3 x86 32.
MURMUR_C1, MURMUR_C2, MURMUR_ADD, MURMUR_MIX1, MURMUR_MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def one_at_a_time(s: str | None) -> int:
    """Jenkins' one-at-a-time over UTF-16 units with signed right shifts, 32 bits; null is 0 (H1)."""
    if s is None:
        return 0
    h = 0
    for (unit,) in struct.iter_unpack("<H", s.encode("utf-16-le", "surrogatepass")):
        h = _signed(h + unit, 32)
        h = _signed(h + (h << 10), 32)
        h ^= h >> 6
    h = _signed(h + (h << 3), 32)
    h ^= h >> 11
    return _signed(h + (h << 15), 32)


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bytes of two longs in turn through one-at-a-time with 64 bits and unsigned shifts (H2); elementwise."""
    a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
    h = np.zeros(a.shape, np.uint64)
    with np.errstate(over="ignore"):
        for shift in range(0, 64, 8):
            for v in (a, b):
                h = h + ((v >> np.uint64(shift)) & np.uint64(255))
                h = h + (h << np.uint64(10))
                h = h ^ (h >> np.uint64(6))
        h = h + (h << np.uint64(3))
        h = h ^ (h >> np.uint64(11))
        h = h + (h << np.uint64(15))
    return h.view(np.int64)


def sha_fold(s: str) -> int:
    """The first eight bytes of SHA-256, each sign-extended, shifted together by exclusive or (H4)."""
    h = 0
    for i, b in enumerate(struct.unpack("8b", hashlib.sha256(s.encode()).digest()[:8])):
        h = b if i == 0 else _signed(h << 8, 64) ^ b
    return _signed(h, 64)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Standard Murmur3 x86 32, as a signed number (H5)."""
    mask, h, n = 0xFFFFFFFF, seed & 0xFFFFFFFF, len(data)

    def scramble(k: int) -> int:
        k = (k * MURMUR_C1) & mask
        return (((k << 15) | (k >> 17)) * MURMUR_C2) & mask

    for (k,) in struct.iter_unpack("<I", data[: n - n % 4]):
        h ^= scramble(k)
        h = ((((h << 13) | (h >> 19)) & mask) * 5 + MURMUR_ADD) & mask
    if n % 4:
        h ^= scramble(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    h = ((h ^ (h >> 16)) * MURMUR_MIX1) & mask
    h = ((h ^ (h >> 13)) * MURMUR_MIX2) & mask
    return _signed(h ^ (h >> 16), 32)


def _by_length(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the items by falling length, their lengths in it, and where each begins in their concatenation: a loop over positions then works on a prefix of all items at once."""
    n = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-n, kind="stable")
    return order, n[order], (np.cumsum(n) - n)[order]


def one_at_a_time_all(texts: list[str | None]) -> np.ndarray:
    """one_at_a_time of many texts, position by position over all of them."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order, n, start = _by_length(units)
    flat = np.concatenate(units).astype(np.int32) if units else np.zeros(0, np.int32)
    h = np.zeros(len(texts), np.int32)
    with np.errstate(over="ignore"):
        for p in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -p, side="left"))
            x = h[:live] + flat[start[:live] + p]
            x = x + (x << 10)
            h[:live] = x ^ (x >> 6)
        h = h + (h << 3)
        h = h ^ (h >> 11)
        h = h + (h << 15)
    out = np.empty(len(texts), np.int32)
    out[order] = h
    return out


def murmur3_32_all(items: list[bytes], seed: int = 0) -> np.ndarray:
    """murmur3_32 of many byte strings, block by block over all of them."""
    blocks = [np.frombuffer(x + b"\0" * (-len(x) % 4), "<u4") for x in items]
    order, n, start = _by_length(blocks)
    size = np.array([len(x) for x in items], np.uint32)[order] if items else np.zeros(0, np.uint32)
    flat = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    h = np.full(len(items), seed & 0xFFFFFFFF, np.uint32)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        for p in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -p, side="left"))
            k = turn(flat[start[:live] + p] * np.uint32(MURMUR_C1), 15) * np.uint32(MURMUR_C2)
            x = h[:live] ^ k
            full = size[:live] >= 4 * (p + 1)  # what remains of a text is mixed in without the turn
            h[:live] = np.where(full, turn(x, 13) * np.uint32(5) + np.uint32(MURMUR_ADD), x)
        h = h ^ size
        h = (h ^ (h >> np.uint32(16))) * np.uint32(MURMUR_MIX1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(MURMUR_MIX2)
        h = h ^ (h >> np.uint32(16))
    out = np.empty(len(items), np.int32)
    out[order] = h.view(np.int32)
    return out


def jenkins(text: Column) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(one_at_a_time_all([None if x is None or x != x else x for x in s]))

    return run(text)


def mixed(a: Column, b: Column) -> Column:
    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(mix64(x.to_numpy(), y.to_numpy()))

    return run(a.cast("bigint"), b.cast("bigint"))


def sha256_long(text: Column) -> Column:
    """sha_fold in the JVM."""
    hexed = F.sha2(text, 256)

    def byte(i):
        v = F.conv(F.substring(hexed, F.lit(2) * i + 1, F.lit(2)), 16, 10).cast("bigint")
        return v - F.when(v > 127, 256).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), byte(F.lit(0)), lambda h, i: F.shiftleft(h, 8).bitwiseXOR(byte(i)))


def murmur3(text: Column, seed: int = 0) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        none = s.isna()
        out = pd.Series(murmur3_32_all([b"" if n else x.encode() for x, n in zip(s, none)], seed), dtype="Int32")
        return out.mask(none.reset_index(drop=True))

    return run(text)


def interleave(y: Column, size: Column | int, x: Column) -> Column:
    """x * size + y (H3); undone by division and remainder."""
    return x * size + y


def hashed_lines(df, line: str = "value", by=sha256_long):
    """value: each line behind its hash in hexadecimal digits and a tab (K9)."""
    return df.select(F.concat(F.lower(F.lpad(F.hex(by(F.col(line))), 16, "0")), F.lit("\t"), F.col(line)).alias("value"))


def composite(*cols: Column) -> Column:
    """One 64-bit key of several columns (H8), in the JVM."""
    return F.xxhash64(*cols)


def bit_field(digest: Column, index: int, width: int) -> Column:
    """The index-th field of `width` bits of a binary digest, least significant first within bytes (H7)."""
    first, last = index * width // 8, (index * width + width - 1) // 8
    total = F.lit(0).cast("bigint")
    for k in range(first, last + 1):
        total = total + F.shiftleft(F.conv(F.hex(F.substring(digest, k + 1, 1)), 16, 10).cast("bigint"), 8 * (k - first))
    return F.shiftright(total, index * width % 8).bitwiseAND((1 << width) - 1)
