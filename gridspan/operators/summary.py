"""Whole-table reports: describe, histograms, value counts, matrix profiles."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arith import epoch_micros
from ..functions.cells import FLOATS, TEMPORAL, column_type, is_number, text_of
from ..plans import quantiles
from .select import require

# 512 registers: up to 16 distinct values fill at most 16 of them, and the estimate is then
# 512 * ln(512 / 496) < 16.3, so an estimate above 17 proves more than 16.
_SKETCH_ERROR = 0.05
# Up to this many values are counted one by one; see plans.quantiles.
IN_BUFFER = quantiles.SMALL
_BATCH = 24


def _clean(df: DataFrame, name: str) -> Column:
    """The cell with NaN as null, for minimum, maximum and percentiles."""
    cell = F.col(f"`{name}`")
    return F.when(~F.isnan(cell), cell) if isinstance(column_type(df, name), FLOATS) else cell


def _share_name(share: float) -> str:
    return f"p{share * 100:g}".replace(".", "_")


def _shown(value, as_text: bool):
    """An exact percentile as the nearest double, or as text."""
    if value is None or not as_text:
        return None if value is None else float(value)
    if isinstance(value, float):
        return repr(value)
    if value.denominator == 1:
        return str(value.numerator)
    with localcontext(prec=60):
        return f"{(Decimal(value.numerator) / Decimal(value.denominator)).normalize():f}"


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def _small_distinct(df: DataFrame, names: list[str], cap: int | None) -> dict[str, int | None]:
    """Exact distinct counts, null where proven to exceed the cap."""
    if not names:
        return {}
    exact = names
    if cap is not None and cap <= 16:
        probe = df.agg(
            *[F.approx_count_distinct(text_of(df, c), _SKETCH_ERROR).alias(f"c{i}") for i, c in enumerate(names)]
        ).first()
        exact = [c for i, c in enumerate(names) if probe[f"c{i}"] <= 17]
    counts: dict[str, int | None] = dict.fromkeys(names)
    if exact:
        cells = F.array(
            *[F.struct(F.lit(i).alias("c"), text_of(df, c).alias("v")) for i, c in enumerate(exact)]
        )
        found = (
            df.select(F.inline(cells)).where("v IS NOT NULL").distinct().groupBy("c").count().collect()
        )
        seen = {r["c"]: r["count"] for r in found}  # one row per column
        for i, c in enumerate(exact):
            n = seen.get(i, 0)
            counts[c] = n if cap is None or n <= cap else None
    return counts


def _aggregates(df: DataFrame, c: str, i: int, numeric: bool) -> list[Column]:
    """The simple aggregates of a column, named by its place."""
    cell, kind = F.col(f"`{c}`"), column_type(df, c)
    wanted = [F.count(cell).alias(f"count{i}")]
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
        return wanted
    wanted += [F.min(_clean(df, c)).alias(f"min{i}"), F.max(_clean(df, c)).alias(f"max{i}")]
    if numeric:
        number = cell.cast("double")
        wanted += [
            F.sum(number).alias(f"sum{i}"),
            F.avg(number).alias(f"mean{i}"),
            F.stddev_samp(number).alias(f"std{i}"),
            F.count(_clean(df, c)).alias(f"finite{i}"),
        ]
    return wanted


def describe(
    df: DataFrame,
    columns: list[str] | None = None,
    percentiles: tuple[float, ...] = (0.25, 0.5, 0.75),
    distinct_cap: int | None = None,
    in_buffer: int = IN_BUFFER,
    as_text: bool = False,
) -> DataFrame:
    """A row per column: type, count, nulls, min, max (as text), mean, sum, std, percentiles,
    distinct.

    Minimum, maximum and percentiles leave NaN out; sum and mean keep it. Percentiles interpolate
    linearly and are exact at any size, found by counting inside narrowing brackets; they are shown as
    the nearest double, or with ``as_text`` as text with all digits, which whole numbers past 2**53 and
    decimals need. ``distinct`` is for columns that are not numeric, and exact; with ``distinct_cap`` it
    is null where there are more.
    """
    names = columns or df.columns
    require(df, *names)
    numeric = [c for c in names if is_number(column_type(df, c))]
    textual = [c for c in names if not is_number(column_type(df, c)) and not isinstance(column_type(df, c), TEMPORAL)]
    # number columns apart from the rest: their aggregates stay in generated code; and a few
    # columns at a time, as each pass reads only its own columns
    others = [c for c in names if c not in numeric]
    batches = [group[i : i + _BATCH] for group in (numeric, others) for i in range(0, len(group), _BATCH)]
    shown: dict = {}
    for batch in batches:
        wanted = [F.count("*").alias("total")]
        for c in batch:
            wanted += _aggregates(df, c, names.index(c), c in numeric)
        # a row of scalars, whatever the size of the table
        wide = df.agg(*wanted)
        texts = [
            text_of(wide, f.name).alias(f.name) if f.name.startswith(("min", "max")) else F.col(f.name)
            for f in wide.schema
        ]
        shown |= wide.select(*texts).first().asDict()
    total = shown["total"]
    distinct = _small_distinct(df, textual, distinct_cap)
    points: dict = {}
    if percentiles and numeric:
        counts = {c: shown[f"finite{names.index(c)}"] for c in numeric}
        for i in range(0, len(numeric), _BATCH):
            batch = numeric[i : i + _BATCH]
            points |= quantiles.exact_percentiles(df, batch, list(percentiles), counts, in_buffer)

    rows = []
    for i, c in enumerate(names):
        get = shown.get
        row = [c, column_type(df, c).simpleString(), get(f"count{i}"), total - get(f"count{i}")]
        row += [get(f"min{i}"), get(f"max{i}"), get(f"mean{i}"), get(f"sum{i}"), get(f"std{i}")]
        inside = [_shown(points.get((c, p)), as_text) for p in percentiles]
        rows.append((*row, *inside, distinct.get(c)))
    fields = "column string, type string, count long, nulls long, min string, max string, mean double, "
    fields += "sum double, std double, "
    fields += "".join(f"{_share_name(p)} {'string' if as_text else 'double'}, " for p in percentiles) + "distinct long"
    return df.sparkSession.createDataFrame(rows, fields)


def describe_times(
    df: DataFrame, columns: list[str] | None = None, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Count, nulls, min, max, mean and percentiles of date and time columns, as times.

    The numbers are taken on microseconds since 1970 and turned back at the end.
    """
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL)]
    require(df, *names)
    micros = df.select(
        *[epoch_micros(F.col(f"`{c}`"), column_type(df, c)).alias(f"t{i}") for i, c in enumerate(names)]
    )
    cells = [f"t{i}" for i in range(len(names))]
    # column names t0, t1 ... keep the report order
    base = describe(micros, cells, percentiles, distinct_cap=None)
    label = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"t{i}"), F.lit(c))])
    as_time = lambda c: F.timestamp_micros(c.cast("long"))
    return base.select(
        label[F.col("column")].alias("column"),
        "count",
        "nulls",
        as_time(F.col("min")).alias("min"),
        as_time(F.col("max")).alias("max"),
        as_time(F.col("mean")).alias("mean"),
        *[as_time(F.col(_share_name(p))).alias(_share_name(p)) for p in percentiles],
    )


def histogram(df: DataFrame, column: str, bins: int = 32) -> DataFrame:
    """Equal-width bins from minimum to maximum: bin, low, high, n.

    The last bin is closed; null, NaN and infinite cells are left out; a single value makes a
    single bin.
    """
    require(df, column)
    value = F.col(f"`{column}`").cast("double")
    finite = df.select(value.alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    )
    low, high = finite.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        bins = 1
    width = (high - low) / bins
    place = F.floor((F.col("v") - low) / F.lit(width)) if width else F.lit(0)
    counts = (
        finite.select(F.greatest(F.least(place.cast("int"), F.lit(bins - 1)), F.lit(0)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * width).alias("low"),
        F.when(F.col("id") == bins - 1, F.lit(high)).otherwise(F.lit(low) + (F.col("id") + 1) * width).alias("high"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, count, fraction of one column; null is a value; most frequent first, then nulls
    last among equals, then by value."""
    require(df, column)
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count"))
    counts = counts.withColumn("fraction", F.col("count") / total)
    return counts.orderBy(F.desc("count"), F.col("value").isNull(), "value")


def value_counts_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text), count, fraction of several columns, in one scan."""
    require(df, *columns)
    total = df.agg(F.count("*")).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(c).alias("column"),
                text_of(df, c).alias("value"),
                (F.col(f"`{c}`").cast("double") if is_number(column_type(df, c)) else F.lit(None).cast("double")).alias(
                    "number"
                ),
            )
            for i, c in enumerate(columns)
        ]
    )
    counts = (
        df.select(F.inline(cells))
        .groupBy("place", "column", "value", "number")
        .agg(F.count("*").alias("count"))
        .withColumn("fraction", F.col("count") / total)
    )
    order = ["place", F.desc("count"), F.col("value").isNull(), "number", "value"]
    return counts.orderBy(*order).select("column", "value", "count", "fraction")


def block_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, sum, mean, min and max over all numeric cells of a block of columns."""
    require(df, *columns)
    cells = F.array(*[_clean(df, c).cast("double") for c in columns if is_number(column_type(df, c))])
    values = df.select(F.explode(cells).alias("v"))
    return values.agg(
        F.count("v").alias("n"),
        F.sum("v").alias("sum"),
        F.avg("v").alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def matrix_profile(entries: DataFrame, value: str, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Stored entries, stored share of the shape, maximum, whether all are whole or zero; over
    every entry."""
    v = F.col(f"`{value}`").cast("double")
    share = F.lit(None).cast("double")
    if n_rows and n_cols:
        share = F.count(v) / F.lit(float(n_rows) * n_cols)
    return entries.agg(
        F.count(v).alias("stored"),
        share.alias("stored_share"),
        F.max(v).alias("max"),
        F.bool_and(v == F.floor(v)).alias("all_whole"),
        F.bool_and(v == 0).alias("all_zero"),
    )


def cell_totals(pixels: DataFrame, cell: str = "cell", count: str = "count") -> DataFrame:
    """cell, pixels and sum of counts."""
    return pixels.groupBy(F.col(f"`{cell}`").alias("cell")).agg(
        F.count("*").alias("pixels"), F.sum(f"`{count}`").alias("sum")
    )


def matrix_grid(df: DataFrame, position: Column, n_rows: int, columns: list[str], height: int) -> DataFrame:
    """Heatmap data: mean of each column per band of rows, scaled to 0-1 over the whole table.

    ``position`` is the 0-based row, ``n_rows`` their number. Cells that are not finite are
    gaps: they enter neither the scale nor the means.
    """
    require(df, *columns)
    value = F.col("v")
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v"))
            for i, c in enumerate(columns)
        ]
    )
    band = F.least(F.floor(position * F.lit(height) / F.lit(max(n_rows, 1))), F.lit(height - 1)).cast("int")
    finite = (
        df.select(band.alias("band"), cells.alias("cells"))
        .select("band", F.inline("cells"))
        .where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    )
    # column-and-band totals first: the scale then comes from as many rows as the grid has cells
    grid = finite.groupBy("band", "slot", "column").agg(
        F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    low, high = grid.agg(F.min("lo")).scalar(), grid.agg(F.max("hi")).scalar()
    scaled = F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0)
    return grid.select("band", "column", scaled.alias("value"))


def schema_report(df: DataFrame) -> DataFrame:
    """position, name, type, nullable and metadata of each column."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, str(f.metadata) if f.metadata else None)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean, metadata string"
    )


def any_null(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])
