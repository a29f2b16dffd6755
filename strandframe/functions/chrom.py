"""Chromosome names: sort keys, classes, pseudoautosomal regions. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudoautosomal regions by assembly (fixed values).
PAR = {
    "grch37": {"PAR1X": (60000, 2699520), "PAR2X": (154931043, 155260560), "PAR1Y": (10000, 2649520), "PAR2Y": (59034049, 59363566)},
    "grch38": {"PAR1X": (10000, 2781479), "PAR2X": (155701382, 156030895), "PAR1Y": (10000, 2781479), "PAR2Y": (56887902, 57217415)},
}
#: The whole name of an autosome, for Python.
AUTOSOME = r"(?i:chr)?[0-9]+"


def bare(name: Column) -> Column:
    """The name without a leading chr, in any case."""
    return F.regexp_replace(name, "(?i)^chr", "")


def sort_key(name: Column) -> tuple[Column, Column]:
    """(number, text) that order chromosomes: numbers, then X and Y, then one-letter tails, then the rest."""
    b = bare(name)
    digits, tail = F.regexp_extract(b, r"^(\d*)", 1), F.regexp_extract(b, r"^\d*(.*)$", 1)
    number = F.when(digits == "", 0).otherwise(digits.cast("int"))
    first = F.when(b.isin("X", "Y"), 1000).when(tail == "", number).when(F.length(tail) == 1, number + 2000).otherwise(number + 3000)
    return first, F.when(b.isin("X", "Y"), b).otherwise(tail)


def is_autosome(name: Column) -> Column:
    return bare(name).rlike(r"^\d+$")


def is_mitochondrial(name: Column) -> Column:
    return F.upper(bare(name)).isin("M", "MT")


def is_alternative(name: Column) -> Column:
    """Unplaced, random, alt, decoy and viral contigs."""
    return name.rlike(r"(?i)(_(alt|random|decoy|fix)$|^chrUn|^GL\d|^KI\d|^NC_|^hs\d|^HLA|EBV)")


def chrom_label(numbers_like: Column, letter: str) -> Column:
    """chrX or X, as the given name has a prefix or not."""
    return F.when(numbers_like.rlike("(?i)^chr"), F.lit(f"chr{letter}")).otherwise(F.lit(letter))


def genome_build(name: str) -> dict[str, tuple[int, int]]:
    if name.lower() not in PAR:
        raise ValueError(f"no such genome build: {name}; there are {', '.join(PAR)}")
    return PAR[name.lower()]


def in_par(chromosome: Column, start: Column, end: Column, build: str, sex: str = "X") -> Column:
    """Contained in a pseudoautosomal region of the chromosome."""
    out = F.lit(False)
    for key, (lo, hi) in genome_build(build).items():
        if key.endswith(sex):
            out = out | ((start >= lo) & (end <= hi))
    return (F.upper(bare(chromosome)) == sex) & out
