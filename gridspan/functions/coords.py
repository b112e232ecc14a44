"""Chromosome names, alignment lengths and the span of a record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names tried for each coordinate, first match wins.
CHROM_COLUMNS = (
    "Chromosome", "chromosome", "Chrom", "chrom", "Chr", "chr",
    "CHROM", "#CHROM", "seqname", "seqid", "contig",
)
START_COLUMNS = (
    "Start", "start", "chromStart", "POS", "pos", "Position",
    "position", "txStart", "begin", "Begin",
)
END_COLUMNS = ("End", "end", "chromEnd", "Stop", "stop", "chromStop", "txEnd")

# Length of chromosome 1, assembly, species.
ASSEMBLIES = (
    (248956422, "GRCh38 / hg38", "Homo sapiens"),
    (249250621, "GRCh37 / hg19", "Homo sapiens"),
    (247249719, "NCBI36 / hg18", "Homo sapiens"),
    (248387328, "T2T-CHM13v2.0", "Homo sapiens"),
    (195154279, "GRCm39 / mm39", "Mus musculus"),
    (195471971, "GRCm38 / mm10", "Mus musculus"),
    (197195432, "NCBI37 / mm9", "Mus musculus"),
    (260522016, "mRatBN7.2 / rn7", "Rattus norvegicus"),
    (282763074, "Rnor_6.0 / rn6", "Rattus norvegicus"),
    (59578282, "GRCz11 / danRer11", "Danio rerio"),
)

_STANDARD = "([1-9]|0[1-9]|1[0-9]|2[0-2]|X|Y)"


def standard_name(chrom: Column) -> Column:
    """One name for both spellings of a standard chromosome: chr1 and 1 give 1, chrM, chrMT, M
    and MT give MT; any other name stays."""
    core = F.regexp_extract(chrom, f"^(?:chr)?{_STANDARD}$", 1)
    return (
        F.when(core != "", core).when(chrom.isin("chrM", "chrMT", "MT", "M"), F.lit("MT")).otherwise(chrom)
    )


def spellings(name: str) -> list[str]:
    """Every spelling of a standard chromosome, or the name itself."""
    core = re.fullmatch(f"(?:chr)?{_STANDARD}", name)
    if core:
        return [core[1], f"chr{core[1]}"]
    mitochondrion = ["M", "MT", "chrM", "chrMT"]
    return mitochondrion if name in mitochondrion else [name]


def naming_style(chrom: Column) -> Column:
    """``chr`` or ``plain`` for a standard chromosome, null for any other name."""
    standard = chrom.rlike(f"^(chr)?({_STANDARD}|M|MT)$")
    return F.when(standard, F.when(chrom.startswith("chr"), "chr").otherwise("plain"))


def assembly(chrom: Column, length: Column) -> Column:
    """The assembly that a row for chromosome 1 of this length names, else null."""
    found = F.lit(None).cast("string")
    for chr1, name, species in reversed(ASSEMBLIES):
        found = F.when(length == chr1, f"{name} ({species})").otherwise(found)
    return F.when(chrom.isin("chr1", "1"), found)


def cigar_span(cigar: Column) -> Column:
    """Reference bases an alignment covers: M, D, N, = and X; at least 1, and 1 for ``*``."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(cigar.isNotNull(), F.greatest(total, F.lit(1)))


def coordinate_columns(df: DataFrame, names: tuple[str, str, str] | None = None) -> tuple[str, str, str]:
    """The chromosome, start and end column: as given, else the first known name present."""
    if names is not None:
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"no column named {missing[0]!r}; columns: {', '.join(df.columns)}")
        return names
    found = []
    for role, tried in (("chromosome", CHROM_COLUMNS), ("start", START_COLUMNS), ("end", END_COLUMNS)):
        hit = next((n for n in tried if n in df.columns), None)
        if hit is None:
            raise ValueError(f"no {role} column found; name the three columns explicitly")
        found.append(hit)
    return tuple(found)


def with_span(df: DataFrame, layout: str) -> DataFrame:
    """Add ``_chrom``, ``_start`` and ``_end`` (0-based, half-open) by the rules of a layout.

    bed: as written, a zero-length record covers one base; gff: 1-based closed; vcf: from POS
    over REF, or to INFO END; sam: from POS over the reference length of CIGAR, none for an
    unplaced read; paf: the target; mpileup: the one position.
    """
    c = F.col
    if layout == "bed":
        chrom, start, stop = (c(f"`{n}`") for n in df.columns[:3])
        start, stop = start.cast("long"), stop.cast("long")
        span = (chrom, start, F.when(stop <= start, start + 1).otherwise(stop))
    elif layout == "gff":
        span = (c("seqname"), c("start").cast("long") - 1, c("end").cast("long"))
    elif layout == "vcf":
        start = c("POS").cast("long") - 1
        ends = F.regexp_extract_all(c("INFO"), F.lit(r"(?:^|;)END=(-?\d+)(?=;|$)"), F.lit(1))
        last = F.try_element_at(ends, F.lit(-1)).try_cast("long")
        ref = F.greatest(F.coalesce(F.octet_length("REF"), F.lit(0)), F.lit(1))
        span = (c("CHROM"), start, F.coalesce(last, start + ref))
    elif layout == "sam":
        start = c("POS").cast("long") - 1
        chrom = F.when(c("RNAME") != "*", c("RNAME"))
        span = (chrom, start, start + F.coalesce(cigar_span(c("CIGAR")), F.lit(1)))
    elif layout == "paf":
        span = (c("tname"), c("tstart").cast("long"), c("tend").cast("long"))
    elif layout == "mpileup":
        span = (c("chrom"), c("pos").cast("long") - 1, c("pos").cast("long"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return df.withColumns(dict(zip(("_chrom", "_start", "_end"), span, strict=True)))
