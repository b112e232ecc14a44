"""Label joins: matrix entries, pixels and category codes get their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join


def label_entries(
    entries: DataFrame, features: DataFrame, barcodes: DataFrame, row: str = "row", col: str = "col"
) -> DataFrame:
    """Matrix entries (0-based row, col, value) with the columns of both label tables.

    ``features`` and ``barcodes`` have a 0-based ``index``; their other columns are added. An
    index outside its table gives null.
    """
    named = lookup_join(entries, features.withColumnRenamed("index", row), [row])
    return lookup_join(named, barcodes.withColumnRenamed("index", col), [col])


def decode_categories(df: DataFrame, code: str, categories: DataFrame, name: str = "label") -> DataFrame:
    """Category codes as labels; a negative or unknown code gives null.

    ``categories`` has ``index`` (0-based) and ``label``.
    """
    listed = categories.select(F.col("index").alias(code), F.col("label").alias(name))
    return lookup_join(df, listed, [code])


def join_bins(pixels: DataFrame, bins: DataFrame, balanced: bool = True) -> DataFrame:
    """Pixels (bin1_id, bin2_id, count) with the span of both bins and the balanced count.

    ``bins`` has bin_id, chrom, start, end and weight. The balanced count is the product with
    both weights, null when a weight is null or NaN.
    """
    out = pixels
    for side in ("1", "2"):
        own = [F.col("bin_id").alias(f"bin{side}_id")]
        own += [F.col(c).alias(f"{c}{side}") for c in ("chrom", "start", "end")]
        if balanced:
            own.append(F.when(~F.isnan(F.col("weight").cast("double")), F.col("weight")).alias(f"_w{side}"))
        out = lookup_join(out, bins.select(*own), [f"bin{side}_id"])
    spans = [f"{c}{s}" for s in "12" for c in ("chrom", "start", "end")]
    rest = [c for c in pixels.columns if c not in ("bin1_id", "bin2_id")]
    result = ["bin1_id", "bin2_id", *spans, *rest]
    if balanced:
        return out.select(*result, (F.col("count") * F.col("_w1") * F.col("_w2")).alias("balanced"))
    return out.select(*result)
