"""Checksums and hashes that Spark lacks, vectorised over Arrow batches.

Packed k-mers go in as DECIMAL(20,0) or BIGINT; 64-bit results come out as signed BIGINT
(``unsigned`` gives the value as DECIMAL), since Spark has no unsigned type.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MURMUR_SEED = 0xC062FB4A
FINGERPRINT_MASK = 0xFFFC00
BUCKET_WAYS = 4


#: Fewer texts than this are hashed one after the other: a step over arrays would cost more.
FEW = 16


def _u64(values: pd.Series) -> np.ndarray:
    return values.to_numpy(np.int64).view(np.uint64)


# The steps and constants of the mixes and checksums below are fixed values of published functions.


def wang(x: np.ndarray) -> np.ndarray:
    """The published 64-bit integer mix of Thomas Wang."""
    u = np.uint64
    x = ~x + (x << u(21))
    x ^= x >> u(24)
    x = x + (x << u(3)) + (x << u(8))
    x ^= x >> u(14)
    x = x + (x << u(2)) + (x << u(4))
    x ^= x >> u(28)
    return x + (x << u(31))


# Fixed values of the 128-to-64-bit mix: what is taken off the first hash, and the multiplier.
_OFF = np.uint64(0x9AE16A3B2F90404F)
_MIX = np.uint64(0x9DDFEA08EB382D69)


def hash_mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 128-to-64-bit mix of two hashes; a constant is taken off the first."""
    s = np.uint64(47)
    low = low - _OFF
    a = (low ^ high) * _MIX
    a ^= a >> s
    b = (high ^ a) * _MIX
    b ^= b >> s
    return b * _MIX


def murmur3_bytes(data: bytes, seed: int = MURMUR_SEED) -> int:
    """MurmurHash3, 32-bit for x86, as published."""
    m, h = 0xFFFFFFFF, seed
    whole = len(data) // 4 * 4

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & m
        return (k << 15 | k >> 17) * 0x1B873593 & m

    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & m
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & m
    return h ^ h >> 16


def _stacked(texts: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, longest first: their order, whole units in each, where each begins, and the units."""
    sizes = np.array([len(x) // unit for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = b"".join(texts[i][: n * unit] for i, n in zip(order.tolist(), sizes.tolist(), strict=True))
    return order, sizes, np.cumsum(sizes) - sizes, np.frombuffer(flat, np.uint32 if unit == 4 else np.uint8)


def murmur3_many(texts: list[bytes], seed: int = MURMUR_SEED) -> np.ndarray:
    """murmur3_bytes of each text; the first blocks of all are mixed together, then the second ones, and so on."""
    if len(texts) < FEW:
        return np.array([murmur3_bytes(x, seed) for x in texts], np.int64)
    u = np.uint32
    order, sizes, begin, blocks = _stacked(texts, 4)

    def scramble(k):
        k = k * u(0xCC9E2D51)
        return (k << u(15) | k >> u(17)) * u(0x1B873593)

    h = np.full(len(texts), seed, np.uint32)
    going = np.searchsorted(-sizes, -np.arange(int(sizes[FEW - 1])), "left")
    for i, n in enumerate(going.tolist()):
        x = h[:n] ^ scramble(blocks[begin[:n] + i])
        h[:n] = (x << u(13) | x >> u(19)) * u(5) + u(0xE6546B64)
    lengths = np.array([len(texts[i]) for i in order.tolist()], np.int64)
    rest = np.array([int.from_bytes(texts[i][n * 4 :], "little") for i, n in zip(order.tolist(), sizes.tolist(), strict=True)], np.uint64)
    h ^= scramble(rest.astype(np.uint32))  # nothing left is 0, which changes nothing
    h ^= lengths.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> u(shift)) * u(factor)
    out = np.empty(len(texts), np.int64)
    out[order] = h ^ h >> u(16)
    for i in order[sizes > sizes[FEW - 1]].tolist():  # the few that are longer
        out[i] = murmur3_bytes(texts[i], seed)
    return out


# Fixed value: the polynomial of ECMA-182, reflected.
_POLYNOMIAL = 0xC96C5795D7870F42


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


def crc64_bytes(data: bytes, crc: int = 0) -> int:
    """CRC-64 of ECMA-182, reflected; start from a former result to go on."""
    crc ^= 2**64 - 1
    for byte in data:
        crc = _CRC[(crc ^ byte) & 255] ^ crc >> 8
    return crc ^ 2**64 - 1


def crc64_many(texts: list[bytes]) -> np.ndarray:
    """crc64_bytes of each text as unsigned numbers, a byte of all at a time."""
    if len(texts) < FEW:
        return np.array([crc64_bytes(x) for x in texts], np.uint64)
    order, sizes, begin, data = _stacked(texts, 1)
    table, crc = np.array(_CRC, np.uint64), np.full(len(texts), 2**64 - 1, np.uint64)
    together = int(sizes[FEW - 1])
    going = np.searchsorted(-sizes, -np.arange(together), "left")
    for i, n in enumerate(going.tolist()):
        crc[:n] = table[(crc[:n] ^ data[begin[:n] + i]) & np.uint64(255)] ^ crc[:n] >> np.uint64(8)
    out = np.empty(len(texts), np.uint64)
    out[order] = ~crc
    for i in order[sizes > together].tolist():  # the few that are longer
        out[i] = crc64_bytes(texts[i][together:], int(out[i]))
    return out


# Checksums are remainders of polynomials over GF(2), the highest bit being the coefficient of x^0.
_ONE = 1 << 63


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(63, -1, -1):
        out ^= b if a >> bit & 1 else 0
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@cache
def _shift_tables(back: bool) -> np.ndarray:
    """[k, j, v]: the byte v at place j times x^(8 * 2^k), or divided by it if ``back``: 1 MB."""
    power = (_ONE ^ _POLYNOMIAL) << 1 & 2**64 - 1 | 1 if back else _ONE >> 1
    for _ in range(3):
        power = _times(power, power)
    out = np.zeros((63, 8, 256), np.uint64)
    for k in range(63):
        bits = np.array([_times(1 << i, power) for i in range(64)], np.uint64).reshape(8, 8)
        for bit in range(8):  # a byte's products are those of its bits, added up
            out[k, :, 1 << bit : 2 << bit] = out[k, :, : 1 << bit] ^ bits[:, bit, None]
        power = _times(power, power)
    return out


def crc64_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums, unsigned, times x^(8 n), n signed: what they add to the checksum of a text that goes on for n bytes."""
    crc, far = crc.astype(np.uint64), np.abs(n)
    for back in (False, True):
        side = n < 0 if back else n > 0
        for k in range(int(far[side].max()).bit_length() if side.any() else 0):
            at = np.flatnonzero(side & (far >> k & 1).astype(bool))
            tables, old = _shift_tables(back)[k], crc[at]
            new = np.zeros(len(at), np.uint64)
            for j in range(8):
                new ^= tables[j][(old >> np.uint64(8 * j) & np.uint64(255)).astype(np.intp)]
            crc[at] = new
    return crc


_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def limb_bytes(seq: str) -> bytes:
    """A sequence as 64-bit little-endian words of 32 bases, base 0 lowest."""
    codes = np.zeros(-(-len(seq) // 32) * 32, np.uint8)
    codes[: len(seq)] = _CODES[np.frombuffer(seq.encode(), np.uint8)]
    four = codes.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _each(data: pd.Series, many) -> pd.Series:
    """A batch's values by ``many``; null for null."""
    there = data.notna().to_numpy()
    out = pd.Series(pd.array([pd.NA] * len(data), "Int64"))
    out[there] = many([bytes(x) for x in data[there]]).view(np.int64)
    return out


@F.pandas_udf(T.LongType())
def _wang_udf(x: pd.Series) -> pd.Series:
    return pd.Series(wang(_u64(x)).view(np.int64))


@F.pandas_udf(T.LongType())
def _mix_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(hash_mix(_u64(a), _u64(b)).view(np.int64))


@F.pandas_udf(T.LongType())
def _murmur_udf(data: pd.Series) -> pd.Series:
    return _each(data, murmur3_many)


@F.pandas_udf(T.LongType())
def _crc_udf(data: pd.Series) -> pd.Series:
    return _each(data, crc64_many)


@F.pandas_udf(T.LongType())
def _shift_udf(crc: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(crc64_shift(_u64(crc), n.to_numpy(np.int64)).view(np.int64))


@F.pandas_udf(T.LongType())
def _part_udf(data: pd.Series, start: pd.Series) -> pd.Series:
    """A part's checksum, divided by x^8 for each byte up to its end."""
    ends = (start + data.map(len, na_action="ignore").fillna(0)).to_numpy(np.int64)
    out = _each(data, crc64_many)
    there = out.notna().to_numpy()
    out[there] = crc64_shift(_u64(out[there].astype(np.int64)), -ends[there]).view(np.int64)
    return out


@F.pandas_udf(T.BinaryType())
def _limbs_udf(seq: pd.Series) -> pd.Series:
    return seq.map(lambda x: None if x is None else limb_bytes(x))


def signed(number: Column) -> Column:
    """The BIGINT with the same 64 bits; 0 for null."""
    wide = number.cast("decimal(20,0)")
    low = F.when(wide > F.lit(2**63 - 1), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)
    return F.coalesce(low.cast("bigint"), F.lit(0).cast("bigint"))


def kmer_hash(packed: Column) -> Column:
    return F.when(packed.isNotNull(), _wang_udf(signed(packed)))


def kmer_hash_mix(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _mix_udf(signed(a), signed(b)))


def unsigned(number: Column) -> Column:
    wide = number.cast("decimal(20,0)")
    return F.when(number < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def fingerprint(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(FINGERPRINT_MASK))


def buckets(hashed: Column, n: int) -> Column:
    """The BUCKET_WAYS bucket numbers of a key: its hash mixed with itself, then with each mix before, modulo n."""
    if n < 1:
        raise ValueError("there must be a bucket")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def place(h: pd.Series) -> pd.Series:
        first = _u64(h)
        ways, now = [], first
        for _ in range(BUCKET_WAYS):
            now = hash_mix(first, now)
            ways.append((now % np.uint64(n)).astype(np.int64))
        return pd.Series(list(np.stack(ways, 1)) if len(first) else [])

    return F.when(hashed.isNotNull(), place(signed(hashed)))


def murmur3(data: Column) -> Column:
    return _murmur_udf(data.cast("binary"))


def crc64(data: Column, initial: Column | None = None) -> Column:
    """The checksum of data, or of what ``initial`` is the checksum of with data after it; null if either is."""
    raw = data.cast("binary")
    return _crc_udf(raw) if initial is None else crc64_chained(initial, _crc_udf(raw), F.octet_length(raw))


def crc64_chained(first: Column, second: Column, length: Column) -> Column:
    """The checksum of two stretches from each one's own and the second's length in bytes."""
    return _shifted(first, length).bitwiseXOR(second)


def _shifted(crc: Column, length: Column) -> Column:
    return F.when(crc.isNotNull() & length.isNotNull(), _shift_udf(signed(crc), signed(length)))


def crc64_of_parts(parts: DataFrame, *keys: str, start: str = "start", data: str = "data", crc: str = "crc64") -> DataFrame:
    """(keys, crc): the checksums of texts that come in parts, rows in any order, part ``start`` bytes into the text of its keys.

    A part's checksum is divided by x^8 for each byte up to its end, these are added up, and
    the sum is multiplied by x^8 for each byte of the text: one aggregation that tasks begin
    before the exchange, of one number a text, however many parts there are.  Parts must
    cover their text once.  Null parts count as none; a text of these alone has a null checksum.
    """
    raw = F.col(data).cast("binary")
    part = F.when(F.col(start).isNotNull(), _part_udf(raw, signed(F.col(start))))
    found = parts.select(*keys, F.octet_length(raw).cast("bigint").alias("_n"), part.alias("_s"))
    summed = found.groupBy(*keys).agg(F.bit_xor("_s").alias("_s"), F.sum("_n").alias("_n"))
    return summed.select(*keys, _shifted(F.col("_s"), F.col("_n")).alias(crc))


def in_parts(frame: DataFrame, text: str, size: int, start: str = "start", data: str = "data") -> DataFrame:
    """The rows once for each ``size`` bytes of a text, with ``start`` and ``data`` in the text's place; empty and null texts have one part."""
    if size < 1:
        raise ValueError("a part has a byte or more")
    raw, keep = F.col(text).cast("binary"), [c for c in frame.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(raw) - 1, F.lit(0)), F.lit(size))
    return frame.withColumn(start, F.explode_outer(starts)).select(*keep, start, F.substring(raw, F.col(start) + 1, F.lit(size)).alias(data))


def sequence_crc64(seq: Column) -> Column:
    return _crc_udf(_limbs_udf(seq))


def sequence_murmur3(seq: Column) -> Column:
    """Over all words of the packed sequence."""
    return _murmur_udf(_limbs_udf(seq))
