"""Packed ``key=value`` text, as in VCF INFO and GFF / GTF attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# key, then =value up to ;, or a quoted value; a bare key is a flag
_TOKEN = r'([^=;\s]+)(?:[=\s]+(?:"([^"]*)"?|([^;"][^;]*))?)?'


def _bare(packed: Column) -> Column:
    """No quote and no blank: then ; alone parts the fields and = alone the key."""
    return ~packed.rlike(r'["\s]')


def _fields(packed: Column) -> Column:
    return F.filter(F.split(packed, ";"), lambda p: (p != "") & ~p.startswith("="))


def keys_of(packed: Column) -> Column:
    """The keys of a packed cell, repeats included."""
    bare = F.transform(_fields(packed), lambda p: F.substring_index(p, "=", 1))
    return F.when(_bare(packed), bare).otherwise(F.regexp_extract_all(packed, F.lit(_TOKEN), F.lit(1)))


def _values_of(packed: Column) -> Column:
    after = lambda p: F.when(F.instr(p, "=") > 0, F.ltrim(F.substr(p, F.instr(p, "=") + 1), F.lit("="))).otherwise("")
    quoted = F.regexp_extract_all(packed, F.lit(_TOKEN), F.lit(2))
    plain = F.regexp_extract_all(packed, F.lit(_TOKEN), F.lit(3))
    mixed = F.zip_with(quoted, plain, lambda q, v: F.concat(q, F.rtrim(v)))
    return F.when(_bare(packed), F.transform(_fields(packed), after)).otherwise(mixed)


def key_values(packed: Column) -> Column:
    """A map from key to text, the first of a repeated key winning; flags map to ''."""
    keys, values = keys_of(packed), _values_of(packed)
    distinct = F.array_distinct(keys)
    firsts = F.transform(distinct, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1))
    return F.when(F.size(distinct) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(
        F.map_from_arrays(distinct, firsts)
    )


def looks_packed(packed: Column) -> Column:
    """Whether a cell reads like a packed list: a separator and an assignment or a quote."""
    return packed.contains(";") & (packed.contains("=") | packed.contains('"'))


def declared_fields(header_lines: list[str], section: str) -> dict[str, tuple[str, str]]:
    """``{ID: (Type, Number)}`` of the ``##INFO`` or ``##FORMAT`` header lines, in order."""
    found: dict[str, tuple[str, str]] = {}
    for line in header_lines:
        body = re.fullmatch(rf"##{section}=<(.*)>", line.strip())
        if not body:
            continue
        pairs = dict(re.findall(r'(\w+)=("[^"]*"|[^,]*)', body.group(1)))
        if pairs.get("ID"):
            found.setdefault(pairs["ID"], (pairs.get("Type", "String"), pairs.get("Number", "")))
    return found
