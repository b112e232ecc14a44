"""Comparing tables: positional and keyed diff, fingerprints, reference checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..functions.coords import assembly, naming_style, standard_name
from ..plans.joins import small_side
from ..plans.spread import spread
from ..session import settle
from .select import require


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """column and note: only in a, only in b, another type, another order."""
    rows = [(c, "only in a") for c in a.columns if c not in b.columns]
    rows += [(c, "only in b") for c in b.columns if c not in a.columns]
    shared = [c for c in a.columns if c in b.columns]
    for c in shared:
        left, right = a.schema[c].dataType.simpleString(), b.schema[c].dataType.simpleString()
        if left != right:
            rows.append((c, f"type {left} and {right}"))
    if shared != [c for c in b.columns if c in a.columns]:
        rows.append((None, "columns in another order"))
    return a.sparkSession.createDataFrame(rows, "column string, note string")


def _joined(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    def side(df: DataFrame, mark: str) -> DataFrame:
        texts = [text_of(df, c).alias(f"_{mark}{i}") for i, c in enumerate(columns)]
        return df.select(*[F.col(f"`{k}`") for k in keys], *texts, F.lit(True).alias(f"_in_{mark}"))

    return side(a, "a").join(side(b, "b"), keys, "full_outer")


def _compared(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None) -> list[str]:
    shared = columns or [c for c in a.columns if c in b.columns and c not in keys]
    require(a, *keys, *shared)
    require(b, *keys, *shared)
    return shared


def _require_unique(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"keys {keys} are not unique, e.g. {twice[0].asDict()}")


def diff_cells(
    a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None, check_unique: bool = True
) -> DataFrame:
    """The cells that differ: keys, column, a, b (as text; null is apart from any text).

    ``keys`` is the dense position (``["_row"]``) for a positional diff, or key columns, which
    must be unique. Only rows in both tables have cells to compare. Columns compare by text, so
    the same values in another type or column order are no difference.
    """
    shared = _compared(a, b, keys, columns)
    if check_unique:
        _require_unique(a, keys)
        _require_unique(b, keys)
    differs = [~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(shared))]
    # only rows with a difference are taken apart into cells
    both = _joined(a, b, keys, shared).where(reduce(lambda x, y: x | y, differs, F.lit(False)))
    both = both.where("_in_a AND _in_b")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b"))
            for i, c in enumerate(shared)
        ]
    )
    exploded = both.select(*[F.col(f"`{k}`") for k in keys], F.inline(cells))
    return exploded.where(~F.col("a").eqNullSafe(F.col("b")))


def diff_summary(
    a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None, check_unique: bool = True
) -> DataFrame:
    """One row: rows_a, rows_b, compared, rows_differ, cells_differ."""
    shared = _compared(a, b, keys, columns)
    if check_unique:
        _require_unique(a, keys)
        _require_unique(b, keys)
    differs = [(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).cast("long") for i in range(len(shared))]
    cells = reduce(lambda x, y: x + y, differs, F.lit(0).cast("long"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return (
        _joined(a, b, keys, shared)
        .select("_in_a", "_in_b", F.when(both, cells).alias("cells"))
        .agg(
            F.count("_in_a").alias("rows_a"),
            F.count("_in_b").alias("rows_b"),
            F.count("cells").alias("compared"),
            F.count(F.when(F.col("cells") > 0, 1)).alias("rows_differ"),
            F.coalesce(F.sum("cells"), F.lit(0)).alias("cells_differ"),
        )
    )


_PIECES, _DIGITS = 4, 15


def fingerprint(df: DataFrame, columns: list[str] | None = None, position: Column | None = None) -> DataFrame:
    """One row: n_rows and a fingerprint of the names and values as text.

    Each row is hashed on its own and the hashes are added up, so rows are never put in order
    or in one place. Without a position the result does not depend on row order; with a dense
    position each row's place is part of its text. Null is apart from every text, and a length
    before each cell keeps neighbouring cells apart.
    """
    names = columns or df.columns
    require(df, *names)
    texts = [text_of(df, c) for c in names]
    cells = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    if position is not None:
        cells = [F.concat(position.cast("string"), F.lit("@")), *cells]
    digest = F.sha2(F.concat_ws("|", *cells), 256)
    pieces = spread(df).select(
        *[
            F.conv(F.substring(digest, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(38,0)").alias(f"p{i}")
            for i in range(_PIECES)
        ]
    )
    sums = pieces.agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(_PIECES)],
    )
    header = "|".join(names)
    whole = F.concat_ws(
        "|", F.lit(header), F.col("n_rows").cast("string"), *[F.col(f"s{i}") for i in range(_PIECES)]
    )
    return sums.select("n_rows", F.sha2(whole, 256).alias("fingerprint"))


# Rows of a block of positions, blocks under one node of the tree, and bits of a key's hash that name its block.
DIGEST_ROWS, DIGEST_FAN_BITS, DIGEST_KEY_BITS = 1 << 16, 8, 16


def _row_sums(df: DataFrame, names: list[str]) -> list[Column]:
    """The digest of a row in pieces, whose sums are the digest of a set of rows."""
    texts = [text_of(df, c) for c in names]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.sha2(F.concat_ws("|", *cells), 256)
    return [F.conv(F.substring(digest, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(38,0)").alias(f"s{i}") for i in range(_PIECES)]


def _block_of(df: DataFrame, keys: list[str], dense: bool) -> Column:
    if dense:
        return F.floor(F.col(f"`{keys[0]}`") / F.lit(DIGEST_ROWS)).cast("long")
    return F.shiftrightunsigned(F.xxhash64(*[text_of(df, k) for k in keys]), 64 - DIGEST_KEY_BITS)


def digest_tree(df: DataFrame, keys: list[str], columns: list[str] | None = None, dense: bool = False) -> DataFrame:
    """(level, node, n_rows, s0 ..): digests of blocks of rows, and of blocks of blocks up to one root.

    Level 0 are blocks of neighbouring positions if ``keys`` is a ``dense`` position, else of keys with equal
    leading bits of their hash. A node's digest is the sum of its rows' digests, of keys and values as text, so
    it does not depend on their order, and a table's tree can be kept to compare other versions with it.
    Blocks are summed up before they are shuffled: one row per block and task.
    """
    names = columns or [c for c in df.columns if c not in keys]
    require(df, *keys, *names)
    sums = [f"s{i}" for i in range(_PIECES)]
    rows = df.select(_block_of(df, keys, dense).alias("node"), *_row_sums(df, [*keys, *names]))
    total = [F.sum(c).alias(c) for c in sums]
    level = settle(rows.groupBy("node").agg(F.count("*").alias("n_rows"), *total))
    last = level.agg(F.max("node")).first()[0] or 0
    levels, i = [level.select(F.lit(0).alias("level"), "node", "n_rows", *sums)], 0
    while last:
        i, last = i + 1, last >> DIGEST_FAN_BITS
        above = F.shiftright("node", DIGEST_FAN_BITS).alias("node")
        level = level.select(above, "n_rows", *sums).groupBy("node").agg(F.sum("n_rows").alias("n_rows"), *total)
        levels.append(level.select(F.lit(i).alias("level"), "node", "n_rows", *sums))
    return reduce(DataFrame.unionByName, levels)


def unlike_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The blocks (node) whose digests differ in two trees, from the roots down.

    On each level only nodes below unlike ones are compared, so that trees of equal tables are told by their
    roots alone. Blocks that only one tree has are unlike.
    """
    values = ["n_rows", *[f"s{i}" for i in range(_PIECES)]]
    top = max(a.agg(F.max("level")).first()[0] or 0, b.agg(F.max("level")).first()[0] or 0)
    unlike = None
    for level in range(top, -1, -1):
        sides = []
        for tree in (a, b):
            nodes = tree.where(F.col("level") == level).select("node", F.struct(*values).alias("v"))
            if unlike is not None:
                above = unlike.withColumnRenamed("node", "_up")
                nodes = nodes.withColumn("_up", F.shiftright("node", DIGEST_FAN_BITS)).join(above, "_up", "left_semi").drop("_up")
            sides.append(nodes)
        joined = sides[0].withColumnRenamed("v", "x").join(sides[1].withColumnRenamed("v", "y"), "node", "full_outer")
        unlike = small_side(joined.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"))
        if unlike.isEmpty():
            break
    return unlike


def diff_cells_by_digest(
    a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None, dense: bool = False, trees: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """What :func:`diff_cells` gives, with only rows of unlike blocks joined with each other.

    Both tables are read once for their digests, of which a row per block is shuffled (or not even that, where
    ``trees`` of both were kept), and once more for the rows of the blocks that differ. Keys must be unique.
    """
    shared = _compared(a, b, keys, columns)
    left, right = trees or (digest_tree(a, keys, shared, dense), digest_tree(b, keys, shared, dense))
    unlike = unlike_blocks(left, right).withColumnRenamed("node", "_block")
    kept = [df.withColumn("_block", _block_of(df, keys, dense)).join(unlike, "_block", "left_semi").drop("_block") for df in (a, b)]
    if not dense:
        for df in kept:
            _require_unique(df, keys)
    return diff_cells(*kept, keys, shared, check_unique=False)


def sequence_names(df: DataFrame, chrom: str, length: str | None = None) -> DataFrame:
    """The distinct sequences of a table: name and length (null when not known)."""
    size = F.max(F.col(f"`{length}`").cast("long")) if length else F.lit(None).cast("long")
    return df.where(F.col(f"`{chrom}`").isNotNull()).groupBy(F.col(f"`{chrom}`").alias("name")).agg(size.alias("length"))


def _styled(names: DataFrame) -> DataFrame:
    """naming and assembly of one table: chr wins a tie, null without a standard chromosome."""
    style = naming_style(F.col("name"))
    counted = names.agg(
        F.count(F.when(style == "chr", 1)).alias("chr"),
        F.count(F.when(style == "plain", 1)).alias("plain"),
        F.max(assembly(F.col("name"), F.col("length"))).alias("assembly"),
    )
    naming = F.when(F.col("chr") + F.col("plain") > 0, F.when(F.col("chr") >= F.col("plain"), "chr").otherwise("plain"))
    return counted.select(naming.alias("naming"), "assembly")


def check_reference(reference: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Problems of each table against the reference: table, problem, name, detail.

    All are frames of (name, length) from :func:`sequence_names`. Problems are ``naming``
    (chr1 against 1), ``missing`` names, another ``length``, and another ``assembly``; both
    spellings of a standard chromosome count as one.
    """
    key = standard_name(F.col("name"))
    ours = reference.where("name IS NOT NULL").select(key.alias("_key"), F.col("length").alias("_ours"))
    ours = ours.groupBy("_key").agg(F.max("_ours").alias("_ours"))
    own = {c: _styled(reference).select(c).scalar() for c in ("naming", "assembly")}
    found = []
    for table, names in tables.items():
        keyed = names.where("name IS NOT NULL").withColumn("_key", key)
        label = F.lit(table).alias("table")
        missing = keyed.join(ours, "_key", "left_anti").select(
            label, F.lit("missing").alias("problem"), "name", F.lit(None).cast("string").alias("detail")
        )
        lengths = (
            keyed.join(ours, "_key")
            .where("length > 0 AND _ours > 0 AND length <> _ours")
            .select(label, F.lit("length"), "name", F.concat(F.col("length").cast("string"), F.lit(" vs "), F.col("_ours").cast("string")))
        )
        style = _styled(names)
        notes = []
        for problem, ours_ in own.items():
            both = style.select(F.col(problem).alias("theirs"), ours_.alias("ours"))
            detail = F.concat("theirs", F.lit(" vs "), "ours")
            notes.append(
                both.where("theirs <> ours").select(label, F.lit(problem), F.lit(None).cast("string"), detail)
            )
        found += [missing, lengths, *notes]
    return reduce(DataFrame.union, found)


def contigs(names: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Sequences of a header (name, length), with record counts of a (chrom) frame when given.

    A sequence with records but without a header line is added with a null length.
    """
    if records is None:
        return names.select("name", F.col("length").cast("long").alias("length"))
    counts = (
        records.where(F.col(records.columns[0]).isNotNull())
        .groupBy(F.col(records.columns[0]).alias("name"))
        .agg(F.count("*").alias("records"))
    )
    return names.join(counts, "name", "full_outer").select(
        "name", F.col("length").cast("long").alias("length"), F.coalesce("records", F.lit(0)).alias("records")
    )


def detected_assembly(names: DataFrame) -> DataFrame:
    """The assembly the length of chromosome 1 names, null when unknown."""
    return names.agg(F.max(assembly(F.col("name"), F.col("length"))).alias("assembly"))
