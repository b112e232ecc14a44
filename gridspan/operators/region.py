"""Interval overlap: region lists, filters for few windows, joins for many."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import coordinate_columns, spellings, standard_name
from ..plans.joins import fits_broadcast, lookup_join, member_join, small_side
from ..plans.scan import prefix_scan
from ..session import settle

UCSC = ("ucsc", "kent", "0-based", "bed")
NCBI = ("ncbi", "genbank", "1-based", "tabix")
WINDOW_SCHEMA = "chrom string, start long, end long, window_id long"
# Bounds of an open window: far beyond any coordinate, with room for arithmetic.
OPEN_START, OPEN_END = -(1 << 56), 1 << 56


def _one_based(coords: str) -> bool:
    if coords.lower() in UCSC:
        return False
    if coords.lower() in NCBI:
        return True
    raise ValueError(f"unknown coordinate convention {coords!r}")


def parse_regions(text: str, coords: str = "ucsc") -> list[tuple[str, int | None, int | None]]:
    """``chr``, ``chr:a-b``, ``chr:a-``, ``chr:-b`` and ``chr:a`` (one base), comma-separated,
    as 0-based half-open windows; None is an open end."""
    one_based = _one_based(coords)
    windows = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        chrom, colon, rest = part.rpartition(":") if ":" in part else (part, "", "")
        found = re.fullmatch(r"(\d*)(-?)(\d*)", rest)
        if not chrom or not found:
            raise ValueError(f"cannot read region {part!r}")
        a, dash, b = found.groups()
        start = int(a) if a else None
        end = int(b) if b else None
        if one_based and start is not None:
            start = max(start - 1, 0)
        if start is not None and not dash:
            end = start + 1
        windows.append((chrom, start, end))
    if not windows:
        raise ValueError("no region given")
    return windows


def slop(windows: list[tuple], n: int) -> list[tuple]:
    """Widen windows by ``n`` on both sides; starts stop at 0, open ends stay open."""
    return [
        (c, None if s is None else max(s - n, 0), None if e is None else e + n) for c, s, e in windows
    ]


def slop_frame(windows: DataFrame, n: int) -> DataFrame:
    """The same on a frame of windows; null is an open end."""
    return windows.withColumn("start", F.greatest(F.col("start") - n, F.lit(0))).withColumn(
        "end", F.col("end") + n
    )


def to_half_open(windows: DataFrame, coords: str) -> DataFrame:
    """Windows of either convention as 0-based half-open."""
    if not _one_based(coords):
        return windows
    return windows.withColumn("start", F.greatest(F.col("start") - 1, F.lit(0)))


def windows_frame(spark: SparkSession, windows: list[tuple]) -> DataFrame:
    rows = [(c, s, e, i) for i, (c, s, e) in enumerate(windows)]
    return spark.createDataFrame(rows, WINDOW_SCHEMA)


def _chrom(value: Column, alias: bool) -> Column:
    return standard_name(value) if alias else value


def overlaps(chrom: Column, start: Column, end: Column, window: tuple, alias: bool = False) -> Column:
    """Whether a row lies over one window; open ends leave their side out."""
    name, low, high = window
    test = chrom.isin(spellings(name) if alias else [name])
    if high is not None:
        test = test & (start < high)
    if low is not None:
        test = test & (end > low)
    return test


def overlap_filter(
    df: DataFrame, windows: list[tuple], columns: tuple[str, str, str] | None = None, alias: bool = False
) -> DataFrame:
    """Rows over any of a few windows. The comparisons are plain ranges, so the scan skips row
    groups by their statistics."""
    chrom, start, end = (F.col(f"`{c}`") for c in coordinate_columns(df, columns))
    test = F.lit(False)
    for window in windows:
        test = test | overlaps(chrom, start, end, window, alias)
    return df.where(test)


def pruned_overlap_filter(
    df: DataFrame, windows: list[tuple], columns: tuple[str, str, str] | None = None, reach: str = "MaxEndSoFar"
) -> DataFrame:
    """The overlap filter on a sorted table with a running maximum of End.

    ``reach > window start`` follows from ``end > window start``, so it drops no row; on a table
    sorted by start its statistics let the scan skip everything left of the window too.
    """
    chrom, start, end = (F.col(f"`{c}`") for c in coordinate_columns(df, columns))
    test = F.lit(False)
    for window in windows:
        one = overlaps(chrom, start, end, window)
        if window[1] is not None:
            one = one & (F.col(f"`{reach}`") > window[1])
        test = test | one
    return df.where(test)


# Many windows: both sides are cut into bins and joined on (chromosome, cell), a cell being a bin of a level. An
# interval belongs to the finest level whose bins are at least as wide as it is, so it touches
# two bins at most; a pair meets on the coarser of its two levels, in the first bin they share.


_LEVEL_BITS = 3
_MAX_BITS = 62
_LEVEL_STEP = 1 << 54


def _bits(width: Column) -> Column:
    """Smallest b with width <= 2**b, from the digits of width - 1 in base 2."""
    return F.when(width <= 1, 0).otherwise(F.length(F.bin(width - 1))).cast("int")


def _prepare(df: DataFrame, chrom: Column, start: Column, end: Column) -> DataFrame:
    """Add the coordinates the join works on; a zero-length interval keeps its bin."""
    placed = df.withColumns({"_c": chrom, "_s": start.cast("long"), "_e": end.cast("long")})
    placed = placed.where("_c IS NOT NULL AND _s IS NOT NULL AND _e IS NOT NULL")
    last = F.greatest(F.col("_e") - 1, F.col("_s"))
    return placed.withColumn("_t", last).withColumn("_w", _bits(last - F.col("_s") + 1))


def _widths(df: DataFrame) -> dict[int, int]:
    """How many intervals need how many bits: at most 64 rows."""
    return {r["_w"]: r["count"] for r in df.groupBy("_w").count().collect()}


def _usual(widths: dict[int, int]) -> int:
    """The width nine in ten intervals keep to: wider bins make fewer copies, and the few
    intervals beyond go to coarser levels."""
    bound, seen = sum(widths.values()) * 0.9, 0
    for bits in sorted(widths):
        seen += widths[bits]
        if seen >= bound:
            return bits
    return 0


def _emit(df: DataFrame, mine: set[int], other: set[int], base: int) -> DataFrame:
    """One row per cell at which an interval can meet the other side.

    A cell is level * 2**54 + bin: one long, so that the copies are plain number sequences.
    """
    level = F.greatest(F.ceil((F.col("_w") - base) / _LEVEL_BITS), F.lit(0)).cast("int")
    df = df.withColumn("_l", level)
    cells = []
    for at in sorted(mine | other):
        if at in other:
            condition = F.col("_l") <= at
        elif any(o < at for o in other):
            condition = F.col("_l") == at
        else:
            continue
        bits, shift = min(base + _LEVEL_BITS * at, _MAX_BITS), F.lit(at * _LEVEL_STEP)
        run = F.sequence(F.shiftright("_s", bits) + shift, F.shiftright("_t", bits) + shift)
        if max(mine) <= at and (at in other or min(mine) == at):
            cells.append(run)
        else:
            cells.append(F.when(condition, run).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("_cell", F.explode(F.concat(*cells))).drop("_w")


def _salted(rows: DataFrame, wins: DataFrame, key: list[str], share: int) -> tuple[DataFrame, DataFrame]:
    """Spread the rows of crowded cells over salts and repeat their windows per salt.

    Every cell of more than ``share`` rows is crowded, so their table has at most rows / share rows; it
    is broadcast where that is proven small. The salt is a hash of the whole row. Equal copies of one row
    share a salt, and Spark splits those by map output when it handles the skewed partition.
    """
    counted = rows.groupBy(*key).count().where(F.col("count") > share)
    crowded = small_side(counted.select(*key, F.ceil(F.col("count") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    plain = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    salted = rows.join(crowded, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), salts).cast("int")
    )
    repeated = wins.join(crowded, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return salted.drop("_salts"), repeated.drop("_salts")


def _pairs(rows: DataFrame, wins: DataFrame, share: int) -> DataFrame:
    """All overlapping pairs of prepared rows and windows, each once."""
    row_bits, window_bits = _widths(rows), _widths(wins)
    base = max(_usual(row_bits), _usual(window_bits), 4)
    level = lambda b: max(math.ceil((b - base) / _LEVEL_BITS), 0)
    row_levels, window_levels = {level(b) for b in row_bits}, {level(b) for b in window_bits}
    if not row_levels or not window_levels:
        row_levels = window_levels = {0}
    a = _emit(rows, row_levels, window_levels, base)
    b = _emit(wins, window_levels, row_levels, base)
    b = b.select(*[F.col(f"`{c}`").alias(c if c in ("_c", "_cell") else f"w{c}") for c in b.columns])
    key = ["_c", "_cell"]
    if fits_broadcast(b):
        b = F.broadcast(b)
    else:
        a, b = _salted(a, b, key, share)
        key = [*key, "_salt"]
    at = F.greatest("_l", "w_l")
    bits = F.least(F.lit(base) + _LEVEL_BITS * at, F.lit(_MAX_BITS)).cast("int")
    first = F.call_function("shiftright", F.greatest("_s", "w_s"), bits)
    return a.join(b, key).where(
        (F.col("_s") < F.col("w_e"))
        & (F.col("_e") > F.col("w_s"))
        & (F.col("_cell") == at * F.lit(_LEVEL_STEP) + first)
    )


def _window_side(windows: DataFrame, alias: bool) -> DataFrame:
    start = F.coalesce(F.col("start").cast("long"), F.lit(OPEN_START))
    end = F.coalesce(F.col("end").cast("long"), F.lit(OPEN_END))
    return _prepare(windows, _chrom(F.col("chrom"), alias), start, end)


def merged_windows(windows: DataFrame) -> DataFrame:
    """Union of overlapping windows per chromosome, with ``_until``: the end of the one before.

    Touching windows stay apart, since a zero-length row between them lies in neither.
    """
    starts = windows.groupBy("_c", "_s").agg(F.max("_e").alias("_e"))
    reach = prefix_scan(starts, ["_c"], "_s", {"_until": ("max_before", F.col("_e"))})
    opens = F.col("_until").isNull() | (F.col("_s") >= F.col("_until"))
    marked = prefix_scan(reach, ["_c"], "_s", {"_open": ("last", F.when(opens, F.col("_s")))})
    return marked.groupBy("_c", "_open").agg(
        F.max("_e").alias("_e"), F.min_by("_until", "_s").alias("_until")
    ).select("_c", F.col("_open").alias("_s"), "_e", "_until")


def overlap_join(
    df: DataFrame,
    windows: DataFrame,
    mode: str = "per_window",
    columns: tuple[str, str, str] | None = None,
    alias: bool = False,
    share: int = 1_000_000,
) -> DataFrame:
    """Rows over any of many windows (``chrom, start, end`` and further columns, null = open).

    ``per_window`` gives a row for each window it lies over, with the window's columns as
    ``window_<name>``; ``any`` gives each row once, the windows merged first so that no row
    meets more than one partner for it. Windows proven small are broadcast and the rows are not
    shuffled; otherwise both sides are shuffled by bin, crowded bins spread over salts.
    """
    chrom, start, end = (F.col(f"`{c}`") for c in coordinate_columns(df, columns))
    rows = _prepare(df, _chrom(chrom, alias), start, end)
    wins = _window_side(windows, alias)
    names = [F.col(f"`{c}`") for c in df.columns]
    if mode == "per_window":
        kept = wins.columns
        paired = _pairs(rows, wins, share)
        label = lambda c: c if c.startswith("window_") else f"window_{c}"
        extra = [F.col(f"`w{c}`").alias(label(c)) for c in kept if not c.startswith("_")]
        return paired.select(*names, *extra)
    if mode != "any":
        raise ValueError("mode is per_window or any")
    # three jobs read the merged windows, which are no more than the windows given
    union = settle(merged_windows(wins))
    last = F.greatest(F.col("_e") - 1, F.col("_s"))
    union = union.withColumn("_t", last).withColumn("_w", _bits(last - F.col("_s") + 1))
    paired = _pairs(rows, union, share)
    first = F.col("w_until").isNull() | (F.col("w_until") <= F.col("_s"))
    return paired.where(first).select(*names)


def overlap_counts(
    df: DataFrame,
    windows: DataFrame,
    name: str = "n_rows",
    columns: tuple[str, str, str] | None = None,
    alias: bool = False,
) -> DataFrame:
    """Each window with the number of rows it lies over, 0 included; no pair of a row and a window is made.

    That number is the rows that start before the window's end less those that end at its start or before it,
    two running counts over the coordinates, so a window that is open or as wide as a chromosome costs what a
    narrow one does. This holds where start <= end in the row and start < end in the window; pairs with others
    are counted from :func:`overlap_join`.
    """
    chrom, start, end = (F.col(f"`{c}`") for c in coordinate_columns(df, columns))
    rows = df.select(_chrom(chrom, alias).alias("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end")).dropna()
    wins = windows.withColumns({
        "_c": _chrom(F.col("chrom"), alias),
        "_s": F.coalesce(F.col("start").cast("long"), F.lit(OPEN_START)),
        "_e": F.coalesce(F.col("end").cast("long"), F.lit(OPEN_END)),
    })
    point = lambda at, begun, done: F.struct(
        at.alias("_p"), F.lit(begun).cast("long").alias("_begun"), F.lit(done).cast("long").alias("_done"), F.lit(begun + done == 0).alias("_asked")
    )
    ends = rows.where("start <= end").select(F.col("chrom").alias("_c"), F.inline(F.array(point(F.col("start"), 1, 0), point(F.col("end"), 0, 1))))
    asked = wins.where("_c IS NOT NULL AND _s < _e").select("_c", F.inline(F.array(point(F.col("_s"), 0, 0), point(F.col("_e") - 1, 0, 0))))
    points = ends.unionByName(asked).groupBy("_c", "_p").agg(
        F.sum("_begun").alias("_begun"), F.sum("_done").alias("_done"), F.max("_asked").alias("_asked")
    )
    scanned = prefix_scan(points, ["_c"], "_p", {"_b": ("sum", F.col("_begun")), "_d": ("sum", F.col("_done"))})
    # two rows a window at most; the size checks and both joins read it
    scanned = settle(scanned.where("_asked").select("_c", "_p", "_b", "_d"))
    found = lookup_join(wins, scanned.select("_c", F.col("_p").alias("_s"), "_d"), ["_c", "_s"])
    found = lookup_join(found, scanned.select("_c", (F.col("_p") + 1).alias("_e"), "_b"), ["_c", "_e"])
    usual = F.when(F.col("_s") < F.col("_e"), F.coalesce(F.col("_b") - F.col("_d"), F.lit(0))).otherwise(0)
    found = found.withColumn(name, usual.cast("long"))

    backward, flat = rows.where("start > end"), wins.where("_s >= _e")
    for some, others in ((backward, wins.where("_s < _e")), (rows.where("start <= end"), flat)):
        # two reversed intervals never overlap
        if some.isEmpty() or others.isEmpty():
            continue
        over = others.select(F.col("_c").alias("chrom"), F.col("_s").alias("start"), F.col("_e").alias("end")).distinct()
        met = overlap_join(some, over, columns=("chrom", "start", "end")).groupBy("window_chrom", "window_start", "window_end").agg(F.count("*").alias("_more"))
        met = settle(met.select(F.col("window_chrom").alias("_c"), F.col("window_start").alias("_s"), F.col("window_end").alias("_e"), "_more"))
        found = lookup_join(found, met, ["_c", "_s", "_e"])
        found = found.withColumn(name, F.col(name) + F.coalesce("_more", F.lit(0))).drop("_more")
    return found.select(*[F.col(f"`{c}`") for c in windows.columns], name)


def submatrix(
    pixels: DataFrame,
    bins: DataFrame,
    first: list[tuple],
    second: list[tuple] | None = None,
    alias: bool = True,
) -> DataFrame:
    """Pixels whose first bin lies in ``first`` and second bin in ``second`` (or ``first``)."""
    ours = bins.select("bin_id", "chrom", "start", "end")
    columns = ("chrom", "start", "end")
    for side, windows in (("bin1_id", first), ("bin2_id", second or first)):
        inside = overlap_filter(ours, windows, columns, alias).select(F.col("bin_id").alias(side))
        pixels = member_join(pixels, inside, [side], True)
    return pixels


def sequence_blocks(sequences: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(name, block, bases) pieces of at most ``width`` bases from (name, seq)."""
    last = F.greatest(F.floor((F.length("seq") - 1) / width), F.lit(0))
    pieces = sequences.select("name", "seq", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("block"))
    return pieces.select(
        "name",
        F.col("block").cast("long").alias("block"),
        F.expr(f"substring(seq, block * {width} + 1, {width})").alias("bases"),
    )


def sequence_windows(blocks: DataFrame, windows: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Bases of each window: name, start, end, length, seq, window_id.

    ``blocks`` are fixed-width pieces, so no row holds a chromosome; a window touches the few
    blocks it covers. It is cut at the end of its sequence, and windows wholly past it vanish.
    """
    lengths = blocks.groupBy("name").agg(F.sum(F.length("bases").cast("long")).alias("total"))
    wanted = windows.select(
        F.col("chrom").alias("name"),
        F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)).alias("ws"),
        F.coalesce("end", F.lit(OPEN_END)).alias("we"),
        "window_id",
    )
    wanted = wanted.join(F.broadcast(lengths) if fits_broadcast(lengths) else lengths, "name")
    wanted = wanted.withColumn("we", F.least("we", "total")).where("ws < we").drop("total")
    spread = wanted.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("ws") / width), F.floor((F.col("we") - 1) / width)))
    )
    low = F.greatest(F.col("ws") - F.col("block") * width, F.lit(0))
    high = F.least(F.col("we") - F.col("block") * width, F.lit(width))
    piece = F.substring(F.col("bases"), (low + 1).cast("int"), (high - low).cast("int"))
    parts = spread.join(blocks, ["name", "block"]).select(
        "name", "ws", "we", "window_id", F.struct("block", piece.alias("bases")).alias("part")
    )
    # a group is one window: as many parts as the output row itself holds
    joined = parts.groupBy("name", "ws", "we", "window_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda p: p["bases"]), "")
    return joined.select(
        "name",
        F.col("ws").alias("start"),
        F.col("we").alias("end"),
        (F.col("we") - F.col("ws")).alias("length"),
        seq.alias("seq"),
        "window_id",
    )
