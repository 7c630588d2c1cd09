"""Chromosome names, alleles, codons and variant types as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

_IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
_IUPAC_PAIRS = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
_BASES = "TCAG"
#: Fixed value: amino acids of the standard code, codons in the order of bases T, C, A, G.
_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def chrom(c: Column) -> Column:
    """Chromosome without a `chr` prefix; 23 is X, 24 is Y, M is MT."""
    bare = F.upper(F.regexp_replace(F.trim(c), "(?i)^chr", ""))
    return F.when(bare == "23", "X").when(bare == "24", "Y").when(bare == "M", "MT").otherwise(bare)


def chrom_order(c: Column) -> Column:
    """Sort key of a normalised chromosome: 1 to 22, X, Y, MT, others last."""
    n = c.try_cast("int")
    return F.coalesce(F.when(n.between(1, 22), n), F.when(c == "X", 23).when(c == "Y", 24).when(c == "MT", 25), F.lit(99))


def complement(c: Column) -> Column:
    return F.translate(F.upper(c), "ACGT", "TGCA")


def reverse_complement(c: Column) -> Column:
    """Reverse complement with ambiguity codes, case kept."""
    return F.reverse(F.translate(c, _IUPAC, _IUPAC_PAIRS))


def strand_partner(c: Column) -> Column:
    """An allele read from the other strand: the complement, reversed for more than one base."""
    return F.when(F.length(c) > 1, F.upper(reverse_complement(c))).otherwise(complement(c))


def palindromic(a: Column, b: Column) -> Column:
    return F.concat(F.upper(a), F.upper(b)).isin("AT", "TA", "CG", "GC")


def variant_type(ref: Column, alt: Column) -> Column:
    """SNV, MNV or INDEL by the alleles' lengths."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").when(F.length(ref) == F.length(alt), "MNV").otherwise("INDEL")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def translate_codon(codon: Column) -> Column:
    """One-letter amino acid, * for stop, ? for an unknown codon."""
    table = {"".join(c): a for c, a in zip(product(_BASES, repeat=3), _AMINO_ACIDS, strict=True)}
    return F.coalesce(_lookup(table, F.translate(F.upper(codon), "U", "T")), F.lit("?"))


def codon_consequence(ref_codon: Column, alt_codon: Column, index: Column) -> Column:
    """Consequence of a substitution in the codon with this 0-based index."""
    r, a = translate_codon(ref_codon), translate_codon(alt_codon)
    return (
        F.when((index == 0) & (r == "M") & (a != "M"), "start_lost")
        .when((r == "*") & (a != "*"), "stop_lost")
        .when((r != "*") & (a == "*"), "stop_gained")
        .when(r == a, "synonymous_variant")
        .otherwise("missense_variant")
    )


def indel_consequence(ref: Column, alt: Column) -> Column:
    d = F.length(alt) - F.length(ref)
    return F.when(d == 0, "coding_sequence_variant").when(F.pmod(d, F.lit(3)) != 0, "frameshift_variant").when(d > 0, "inframe_insertion").otherwise("inframe_deletion")


def replace_base(codon: Column, place: Column, base: Column) -> Column:
    """The codon with one base replaced, place from 0."""
    return F.overlay(codon, base, place + 1, F.lit(1))


def splice_type(before: Column, after: Column) -> Column:
    """donor for an intron that begins with GT, acceptor for one that ends with AG, else null; in coding orientation."""
    return F.when(F.upper(after) == "GT", "donor").when(F.upper(before) == "AG", "acceptor")


def flip_dosage(dosage: Column, flip: Column) -> Column:
    """2 - dosage where the effect allele is REF."""
    return F.when(flip, 2 - dosage).otherwise(dosage)


def genotype_dosage(g1: Column, g2: Column) -> Column:
    """Sum of two alleles; null if either is missing (negative or null)."""
    return F.when((g1 >= 0) & (g2 >= 0), (g1 + g2).cast("double"))


def variant_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def ref_decision(ref_base: Column, effect: Column, other: Column) -> Column:
    """Which allele the reference sequence shows: other (the effect allele is ALT), effect (flipped), or none."""
    r = F.upper(ref_base)
    return F.when(r == F.upper(other), "effect_is_alt").when(r == F.upper(effect), "effect_is_ref").otherwise("no_match")
