"""Nucleotide and k-mer expressions: every function maps Columns to a Column and stays in whole-stage codegen.

Bases are the letters ACGT.  A k-mer is a string of k bases, 1 <= k <= 32; string order
equals the unsigned order of two-bit packed k-mers of one length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a UTF-8 character of two, three or four bytes reads, one base a byte.
WIDE = (("[\\x{80}-\\x{7FF}]", "AA"), ("[\\x{800}-\\x{FFFF}]", "AAA"), ("[\\x{10000}-\\x{10FFFF}]", "AAAA"))

#: Bases that are compared as one number.
LIMB = 31


def check_k(k: int) -> int:
    if not 1 <= k <= 32:
        raise ValueError(f"k must be from 1 to 32, not {k}")
    return k


def encode(text: Column) -> Column:
    """Bases of a text: case is ignored, every byte that isn't a base reads as A."""
    for pattern, letters in WIDE:
        text = F.regexp_replace(text, pattern, letters)
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", "A"))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def complement_text(text: Column) -> Column:
    """Complement of free text: case is kept, letters that aren't bases stay."""
    return F.translate(text, "acgtACGT", "tgcaTGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def reverse_complement_text(text: Column) -> Column:
    return F.reverse(complement_text(text))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def pack(kmer: Column, k: int) -> Column:
    """The k-mer as a number, first base highest: BIGINT, or DECIMAL(20,0) at k = 32."""
    number = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10)
    return number.cast("decimal(20,0)" if check_k(k) == 32 else "bigint")


def unpack(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), check_k(k), "0"), "0123", "ACGT")


def mask(k: int) -> int:
    """The low 2k bits."""
    return (1 << (2 * check_k(k))) - 1


def base_at(seq: Column, i: int) -> Column:
    return F.substring(seq, i + 1, 1)


def set_base(seq: Column, i: int, base: str) -> Column:
    return F.overlay(seq, F.lit(base), i + 1, 1)


def window(seq: Column, i: int, k: int) -> Column:
    return F.substring(seq, i + 1, k)


def window_reversed(seq: Column, i: int, k: int) -> Column:
    """The window with its first base lowest."""
    return F.reverse(window(seq, i, k))


def append(seq: Column, text: Column) -> Column:
    return F.concat(seq, encode(text))


def append_kmer(seq: Column, kmer: Column) -> Column:
    """A packed k-mer appended from its low end, which reverses it."""
    return F.concat(seq, F.reverse(kmer))


def limbs(seq: Column) -> Column:
    """How many 64-bit words of 32 bases a sequence takes."""
    return F.ceil(F.length(seq) / 32).cast("bigint")


def length_order(seq: Column) -> list[Column]:
    """Sort keys: by length, then lexicographic."""
    return [F.length(seq), seq]


def low_period(kmer: Column, k: int) -> Column:
    """Whether the k-mer repeats with period 1, 2 or 3; for k <= 3 always."""
    out = F.lit(k <= 3)
    for p in (1, 2, 3):
        if p < k:
            out = out | (F.substring(kmer, 1, k - p) == F.substring(kmer, 1 + p, k - p))
    return out


def mismatches(query: Column, subject: Column, offset: Column, most: int | None = None) -> Column:
    """Hamming distance of query from subject at an offset (from 0); a base beyond the subject's end is unlike any.

    Both are compared LIMB bases at a time, as packed numbers: bases that differ are pairs of bits that aren't both 0 in their xor.
    """
    limb, query, subject = F.lit(LIMB), query.cast("binary"), subject.cast("binary")

    def number(bases: Column) -> Column:
        return F.conv(F.translate(bases.cast("string"), "ACGT", "0123"), 4, 10).cast("bigint")

    def unlike(i: Column) -> Column:
        theirs = F.substring(subject, i * limb + offset + 1, limb)
        mine = F.substring(query, i * limb + 1, limb)
        inside = F.substring(mine, F.lit(1), F.octet_length(theirs))
        theirs = F.substring(theirs, F.lit(1), F.octet_length(inside))
        differ = number(inside).bitwiseXOR(number(theirs))
        pairs = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(mask(LIMB) // 3))
        return F.when(F.octet_length(inside) == 0, 0).otherwise(F.bit_count(pairs)) + F.octet_length(mine) - F.octet_length(inside)

    limbs_ = F.sequence(F.lit(0), F.ceil(F.octet_length(query) / limb).cast("int"))
    found = F.aggregate(F.transform(limbs_, unlike), F.lit(0), lambda a, x: a + x)
    return F.least(found, F.lit(most)) if most is not None else found


def out_neighbours(kmer: Column) -> Column:
    return F.transform(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: F.concat(F.substring(kmer, 2, 31), b))


def in_neighbours(kmer: Column, k: int) -> Column:
    return F.transform(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: F.concat(b, F.substring(kmer, 1, k - 1)))
