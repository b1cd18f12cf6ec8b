"""Nucleotides as Column expressions.

A byte means the two bits ``(byte >> 1) & 3``: A, C, T, G for 0 to 3. So case
does not matter, U reads as T, N as G, and no byte is rejected. Strings here
are over ACGT and ordered as ASCII orders them; a k-mer and its reverse
complement are one element, shown by the smaller string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123)))
BITS_TO_BASE = "ACTG"
LETTERS_AS_BASES = "".join(BITS_TO_BASE[(ord(c) >> 1) & 3] for c in LETTERS)
_BYTES = "".join(map(chr, range(256)))
_BYTES_AS_BASES = "".join(BITS_TO_BASE[(b >> 1) & 3] for b in range(256))
#: Two-bit codes that order as the letters do.
ORDER = "ACGT"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bases(c) -> Column:
    """Every byte of a string as a nucleotide."""
    # translate can't map the NUL character; it is folded first
    latin = F.regexp_replace(F.decode(_col(c).cast("binary"), "ISO-8859-1"), "\\x00", "A")
    return F.translate(latin, _BYTES[1:], _BYTES_AS_BASES[1:])


def letters_as_bases(c) -> Column:
    """The ASCII letters of a string as nucleotides, all else dropped."""
    return F.translate(F.regexp_replace(_col(c), "[^A-Za-z]", ""), LETTERS, LETTERS_AS_BASES)


def encode_base(c) -> Column:
    """Two-bit code of a one-character string."""
    return F.shiftright(F.ascii(_col(c)), 1).bitwiseAND(F.lit(3))


def decode_base(c) -> Column:
    return F.substring(F.lit(BITS_TO_BASE), _col(c).cast("int") + 1, F.lit(1))


def complement(c) -> Column:
    return F.translate(_col(c), "ACGT", "TGCA")


def revcomp(c) -> Column:
    return F.reverse(complement(c))


def canonical(c) -> Column:
    c = _col(c)
    return F.least(c, revcomp(c))


def is_forward(c) -> Column:
    c = _col(c)
    return c <= revcomp(c)


def is_palindrome(c) -> Column:
    c = _col(c)
    return c == revcomp(c)


def code(c, k: int) -> Column:
    """A string of k <= 31 bases as a long that orders as the string does."""
    if k > 31:
        raise ValueError("codes hold 31 bases at most")
    return F.conv(F.translate(_col(c), ORDER, "0123"), 4, 10).cast("long")


def decode(c, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(c).cast("string"), 10, 4), k, "0"), "0123", ORDER)


def prefix_overlap(c, k: int) -> Column:
    """The first k - 1 bases."""
    return F.substring(_col(c), 1, k - 1)


def suffix_overlap(c, k: int) -> Column:
    """The last k - 1 bases."""
    return F.substring(_col(c), 2, k - 1)


def extend(c, next_kmer) -> Column:
    """A string with the last base of the k-mer that follows it."""
    return F.concat(_col(c), F.right(_col(next_kmer), F.lit(1)))


def replace_base(c, place: int, base: str) -> Column:
    """A string with the base at ``place`` (from 0) replaced."""
    return F.overlay(_col(c), F.lit(base), F.lit(place + 1), F.lit(1))
