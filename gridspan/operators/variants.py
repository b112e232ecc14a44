"""Per-sample columns and genotype statistics of variant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import called_alleles, field_place, is_hom_alt, is_hom_ref, subfield, typed_field
from ..functions.keyvalue import declared_fields
from .select import require

# The columns of a variant table before its samples.
SITE_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
GT_COLUMNS = ("n_called", "n_het", "n_hom_ref", "n_hom_alt", "n_missing", "AC", "AN", "AF", "call_rate")


def sample_columns(df: DataFrame) -> list[str]:
    """Columns after FORMAT: the samples."""
    require(df, "FORMAT")
    names = df.columns[df.columns.index("FORMAT") + 1 :]
    if not names:
        raise ValueError("no sample columns after FORMAT")
    return names


def gt_stats(df: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Append genotype counts, AC, AN, AF and call rate over the samples of each record.

    Counts over an array of the samples: no shuffle, and the plan does not grow with their
    number. A name in use gets ``_gt`` appended; a record without GT counts all as missing.
    """
    samples = samples or sample_columns(df)
    require(df, "FORMAT", *samples)
    place = F.col("_place")
    packed = F.array(*[F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("")) for s in samples])
    alleles = F.transform(packed, lambda s: called_alleles(subfield(s, place)))
    counted = df.withColumn("_place", field_place(F.col("FORMAT"), "GT")).withColumn("_calls", alleles)
    calls, n = F.col("_calls"), F.lit(len(samples)).cast("long")
    count = lambda test: F.size(F.filter(calls, test)).cast("long")
    called = n - count(lambda c: F.size(c) == 0)
    ref, alt = count(is_hom_ref), count(is_hom_alt)
    every = F.flatten(calls)
    an = F.size(every).cast("long")
    ac = F.size(F.filter(every, lambda a: a > 0)).cast("long")
    values = (called, called - ref - alt, ref, alt, n - called, ac, an, F.when(an > 0, ac / an), called / n)
    out = [
        v.alias(n if n not in df.columns else f"{n}_gt") for n, v in zip(GT_COLUMNS, values, strict=True)
    ]
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], *out)


def _declared(header: list[str] | None, fields: dict | None) -> dict[str, tuple[str, str]]:
    found = fields or declared_fields(header or [], "FORMAT")
    if not found:
        raise ValueError("no ##FORMAT declarations given")
    return found


def samples_struct(
    df: DataFrame,
    header: list[str] | None = None,
    fields: dict[str, tuple[str, str]] | None = None,
    samples: list[str] | None = None,
) -> DataFrame:
    """Each sample becomes a struct typed from the FORMAT declarations; FORMAT is dropped.

    A key the record lacks is null; a sample that is a lone ``.`` is a null struct. All samples
    go through one lambda over an array, so the plan is as small for thousands of samples.
    """
    samples = samples or sample_columns(df)
    fields = _declared(header, fields)
    keys = F.split("FORMAT", ":")

    def unpack(sample: Column) -> Column:
        parts = [
            typed_field(subfield(sample, F.array_position(keys, k)), *fields[k]).alias(k) for k in fields
        ]
        return F.when(sample.isNotNull() & (sample != "."), F.struct(*parts))

    whole = F.transform(F.array(*[F.col(f"`{s}`") for s in samples]), unpack)
    site = [F.col(f"`{c}`") for c in df.columns if c not in samples and c != "FORMAT"]
    unpacked = df.select(*site, whole.alias("_samples"))
    return unpacked.select(*site, *[F.col("_samples")[i].alias(s) for i, s in enumerate(samples)])


def samples_long(
    df: DataFrame,
    header: list[str] | None = None,
    fields: dict[str, tuple[str, str]] | None = None,
    samples: list[str] | None = None,
) -> DataFrame:
    """A row per record and sample: the record's columns, ``sample``, a typed column per key.

    A key whose name is in use gets ``_fmt`` appended.
    """
    samples = samples or sample_columns(df)
    fields = _declared(header, fields)
    site = [c for c in df.columns if c not in samples and c != "FORMAT"]
    packed = F.array(
        *[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").alias("_packed")) for s in samples]
    )
    long = df.select(*[F.col(f"`{c}`") for c in site], "FORMAT", F.inline(packed))
    taken = set(site) | {"sample"}
    out = []
    for k, (kind, number) in fields.items():
        text = subfield(F.col("_packed"), field_place(F.col("FORMAT"), k))
        lone = F.col("_packed") == "."
        value = typed_field(F.when(~lone, text), kind, number)
        out.append(value.alias(k if k not in taken else f"{k}_fmt"))
    return long.select(*[F.col(f"`{c}`") for c in site], "sample", *out)

