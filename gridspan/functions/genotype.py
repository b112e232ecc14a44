"""Genotype calls as column expressions over arrays; no shuffle, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def subfield(sample: Column, place: Column) -> Column:
    """The sub-field of a packed sample at a 1-based place; null when absent."""
    first = F.substring_index(sample, ":", 1)
    other = F.get(F.split(sample, ":"), (place - 1).cast("int"))
    return F.when(place == 1, first).when(place > 1, other)


def field_place(format_: Column, key: str) -> Column:
    """1-based place of a key in a FORMAT list, 0 when absent."""
    return F.array_position(F.split(format_, ":"), key)


def called_alleles(call: Column) -> Column:
    """Allele numbers of a call such as 0/1, 1|1, ./., 0 or 1/2, missing ones left out."""
    alleles = F.split(F.translate(F.coalesce(call, F.lit("")), "|", "/"), "/")
    return F.array_compact(F.transform(alleles, lambda a: a.try_cast("int")))


def is_hom_ref(alleles: Column) -> Column:
    return F.array_max(alleles) == 0


def is_hom_alt(alleles: Column) -> Column:
    return (F.array_min(alleles) > 0) & (F.array_min(alleles) == F.array_max(alleles))


def genotype(call: Column) -> Column:
    """``(kind, an, ac)`` of a call: kind is hom_ref, het, hom_alt or missing; an counts called
    alleles, ac those that are not the reference. Any ploidy and either separator."""
    numbers = called_alleles(call)
    kind = (
        F.when(F.size(numbers) == 0, "missing")
        .when(is_hom_ref(numbers), "hom_ref")
        .when(is_hom_alt(numbers), "hom_alt")
        .otherwise("het")
    )
    ac = F.size(F.filter(numbers, lambda a: a > 0))
    return F.struct(kind.alias("kind"), F.size(numbers).alias("an"), ac.alias("ac"))


def field_type(kind: str, number: str) -> T.DataType:
    """Integer / Float with one value are scalars, with any other number lists; else text."""
    base = {"Integer": T.LongType(), "Float": T.DoubleType()}.get(kind)
    if base is None:
        return T.StringType()
    return base if number == "1" else T.ArrayType(base)


def typed_field(text: Column, kind: str, number: str) -> Column:
    """A sub-field in its declared type; ``.`` and an empty field are null."""
    text = F.when(~text.isin(".", ""), text)
    target = field_type(kind, number)
    if isinstance(target, T.ArrayType):
        base = target.elementType.simpleString()
        return F.transform(F.split(text, ","), lambda x: x.try_cast(base))
    if isinstance(target, T.StringType):
        return text
    return text.try_cast(target.simpleString())
