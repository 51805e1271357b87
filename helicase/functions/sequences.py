"""Column builders for DNA text: cleaning, complements, k-mers, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import check_k

STEP = 512


def clean(seq: Column) -> Column:
    """Bases in upper case, U read as T; other letters stay, so that they are found to be none."""
    return F.translate(seq, "acgtuU", "ACGTTT")


def bad_position(seq: Column) -> Column:
    """The first place, from 0, of a letter that is no base; null if all are bases."""
    good = F.length(F.regexp_extract(clean(seq), "^[ACGT]*", 0))
    return F.when(good < F.length(seq), good)


def validated(seq: Column) -> Column:
    """The cleaned sequence; the query fails at a letter that is no base."""
    message = F.concat(F.lit("invalid base '"), F.substring(seq, bad_position(seq) + 1, F.lit(1)), F.lit("' at "), bad_position(seq))
    return F.when(bad_position(seq).isNotNull(), F.raise_error(message).cast("string")).otherwise(clean(seq))


def base_code(base: Column) -> Column:
    """0..3 for A, C, G, T or U in either case, else null."""
    return F.when(base.rlike("^[ACGTUacgtu]$"), F.translate(F.upper(base), "ACGTU", "01233").cast("int"))


def code_base(code: Column) -> Column:
    """The base of a code's two lowest bits."""
    return F.substring(F.lit("ACGT"), F.pmod(code, F.lit(4)) + 1, F.lit(1))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def codes(seq: Column) -> Column:
    """The array of base codes."""
    return F.transform(F.filter(F.split(seq, ""), lambda b: b != ""), base_code)


def from_codes(values: Column) -> Column:
    return F.array_join(F.transform(values, code_base), "")


def kmers(seq: Column, k: int) -> Column:
    """The array of all k-mers from left to right; empty for shorter sequences."""
    check_k(k)
    # a substring is found from the text's start, so long sequences are cut into overlapping steps first
    steps = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1), F.lit(STEP)), lambda p: F.substring(seq, p, F.lit(STEP + k - 1)))
    words = F.transform(steps, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k))))
    return F.when(F.length(seq) >= k, F.flatten(words)).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; text order is code order."""
    return F.least(kmer, reverse_complement(kmer))


def kmer_code(kmer: Column) -> Column:
    """The k-mer read as a number to base four, its first base counting most."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def code_kmer(code: Column, k: int) -> Column:
    """The k-mer of a number to base four."""
    return F.concat(*[code_base(F.shiftright(code, 2 * (k - 1 - i))) for i in range(k)])


def is_homopolymer(kmer: Column) -> Column:
    """Whether all bases are equal; false for the empty k-mer."""
    return kmer.rlike(r"^(.)\1*$")


def homopolymer_mask(seq: Column, least: int = 3) -> Column:
    """For each position whether it lies in a run of `least` equal bases or more."""
    runs = F.regexp_extract_all(seq, F.lit(r"(.)\1*"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.length(r) >= least, F.length(r))))


def header_size(header: Column) -> Column:
    """The first size=N of a header that is a number, at least 1; else 1."""
    tokens = F.filter(F.split(header, r"[;\s]"), lambda t: t.rlike(r"^size=\+?\d+$"))
    numbers = F.filter(F.transform(tokens, lambda t: F.substr(t, F.lit(6)).try_cast("long")), lambda v: v.isNotNull())
    return F.greatest(F.coalesce(F.get(numbers, F.lit(0)), F.lit(1)), F.lit(1)).cast("long")


def header_id(header: Column) -> Column:
    """What stands before the first ; or blank."""
    return F.split(header, r"[;\s]")[0]


def fasta_lines(header: Column, seq: Column, width: int = 80) -> Column:
    """A record's text: the header, then the sequence in lines of `width`; an empty sequence gives the header alone."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), header, F.when(F.length(seq) > 0, F.concat(F.lit("\n"), body)).otherwise(F.lit("")))


def even_index(i: Column, n: Column, most: int) -> Column:
    """The i-th of at most `most` evenly spaced places among n, the first and the last included."""
    if most <= 1:
        return F.when(n <= most, i).otherwise(F.lit(0))
    return F.when(n <= most, i).otherwise(F.floor(i * (n - 1) / (most - 1)))
