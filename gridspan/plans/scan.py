"""Running values over ordered data without one task per group.

A window over a whole group would put a chromosome or a file into one task. Here the
order column is cut into blocks of a fixed width: each block is scanned by itself, a table
with one row per block carries the values across, and both are joined on the block, which
is how the rows are already partitioned. The table of blocks is scanned the same way, in blocks
of blocks. No window holds more than ``block`` rows as long as positions are distinct within a
group and below the cube of ``block`` (2**48).

Every kind of scan is a state that is joined associatively: what is scanned within a block,
carried over blocks and carried over blocks of blocks is the same state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
_BEFORE = ("sum_before", "max_before", "lag")
_KINDS = ("sum", "max", "last", "since", *_BEFORE)


def _block_of(position: str, block: int) -> Column:
    return F.floor(F.col(position) / F.lit(block)).cast("long")


def fullest_block(df: DataFrame, group: list[str], position: str, block: int = BLOCK) -> tuple[int, int]:
    """How many rows the largest window of a scan would hold, and how many rows have a null group or position."""
    counts = df.groupBy(*group, _block_of(position, block).alias("_block")).count()
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*group, "_block"]])
    found = counts.agg(F.max(F.when(known, F.col("count"))), F.sum(F.when(~known, F.col("count")))).first()
    return found[0] or 0, found[1] or 0


def _local(df: DataFrame, key: list[str], place: list[str], kinds: list[str], before: list[bool]) -> DataFrame:
    """Scan the states ``_v`` within each ``key`` in the order of ``place``, into ``_l``.

    A ``since`` has two more columns: ``_o`` is the running sum at a row that opens a section, and ``_m`` tells
    whether a section was opened within the key.
    """
    inside = (Window.partitionBy(*key) if key else Window.partitionBy()).orderBy(*place)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_s{i}": F.sum(f"_v{i}").over(upto) for i, kind in enumerate(kinds) if kind == "since"}
    if sums:
        df = df.withColumns(sums)
        df = df.withColumns({f"_o{i}": F.col(f"_s{i}") - F.col(f"_r{i}") for i, kind in enumerate(kinds) if kind == "since"})
    found = {}
    for i, kind in enumerate(kinds):
        frame = earlier if before[i] else upto
        if kind == "since":
            origin = F.last(f"_o{i}", ignorenulls=True).over(frame)
            through = F.col(f"_s{i}") - F.col(f"_v{i}") if before[i] else F.col(f"_s{i}")
            found[f"_l{i}"] = through - F.coalesce(origin, F.lit(0))
            found[f"_m{i}"] = origin.isNotNull()
        elif kind.startswith("sum"):
            found[f"_l{i}"] = F.sum(f"_v{i}").over(frame)
        elif kind.startswith("max"):
            found[f"_l{i}"] = F.max(f"_v{i}").over(frame)
        else:
            found[f"_l{i}"] = F.last(f"_v{i}", ignorenulls=True).over(frame)
    return df.withColumns(found)


def _states(df: DataFrame, key: list[str], place: str, kinds: list[str]) -> DataFrame:
    """One row per ``key``: the state of all its rows together."""
    parts = []
    for i, kind in enumerate(kinds):
        value, at = F.col(f"_v{i}"), F.col(place)
        if kind == "since":
            last = F.max(F.when(F.col(f"_o{i}").isNotNull(), F.struct(at.alias("p"), F.col(f"_o{i}").alias("o"))))["o"]
            parts += [F.sum(value).alias(f"_v{i}"), (F.sum(value) - last).alias(f"_r{i}")]
        elif kind.startswith("sum"):
            parts.append(F.sum(value).alias(f"_v{i}"))
        elif kind.startswith("max"):
            parts.append(F.max(value).alias(f"_v{i}"))
        else:
            parts.append(F.max(F.when(value.isNotNull(), F.struct(at.alias("p"), value.alias("v"))))["v"].alias(f"_v{i}"))
    return df.groupBy(*key).agg(*parts)


def _joined(local: DataFrame, carries: DataFrame, key: list[str], kinds: list[str]) -> DataFrame:
    """``_l`` (and ``_m``) of the whole group: what was carried to the key, then what was scanned within it."""
    joined = local.join(carries, key, "left")
    whole = {}
    for i, kind in enumerate(kinds):
        mine, carry = F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind == "since":
            whole[f"_l{i}"] = F.when(F.col(f"_m{i}"), mine).otherwise(mine + F.coalesce(carry, F.lit(0)))
            whole[f"_m{i}"] = F.col(f"_m{i}") | F.coalesce(F.col(f"_d{i}"), F.lit(False))
        elif kind.startswith("sum"):
            whole[f"_l{i}"] = F.coalesce(mine, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind.startswith("max"):
            whole[f"_l{i}"] = F.greatest(mine, carry)
        else:
            whole[f"_l{i}"] = F.coalesce(mine, carry)
    return joined.withColumns(whole)


def _carried(states: DataFrame, group: list[str], kinds: list[str], block: int, levels: int) -> DataFrame:
    """``_c`` (and ``_d``) of each block: the states of all blocks before it in its group, together."""
    before = [True] * len(kinds)
    if levels:
        key = [*group, "_above"]
        cut = states.withColumn("_above", F.floor(F.col("_block") / F.lit(block)).cast("long"))
        local = _local(cut, key, ["_block"], kinds, before)
        source = local if "since" in kinds else cut
        above = _states(source, key, "_block", kinds).withColumnRenamed("_above", "_block")
        above = _carried(above, group, kinds, block, levels - 1).withColumnRenamed("_block", "_above")
        scanned = _joined(local, above, key, kinds)
    else:
        scanned = _local(states, group, ["_block"], kinds, before)
    out = [F.col(f"_l{i}").alias(f"_c{i}") for i in range(len(kinds))]
    out += [F.col(f"_m{i}").alias(f"_d{i}") for i, kind in enumerate(kinds) if kind == "since"]
    return scanned.select(*group, "_block", *out)


def prefix_scan(
    df: DataFrame,
    group: list[str],
    position: str,
    wanted: dict[str, tuple[str, Column | tuple[Column, Column]]],
    block: int = BLOCK,
    tasks: int | None = None,
    then: list[str] | None = None,
) -> DataFrame:
    """Add one column per entry of ``wanted``, scanned in ``position`` order per group.

    Kinds: ``sum`` / ``max`` / ``last`` take this row and all before it, ``sum_before`` /
    ``max_before`` only the rows before it, ``lag`` the row before. ``last`` skips nulls. ``since`` takes
    (opens, weight): the sum of the weights after the last row that opens a section, this row included,
    and 0 at such a row; rows before the first section are counted from the start. Group columns must not
    be null and ``position`` is a long, distinct within a group. It may repeat if ``then`` names the columns that
    order the rows of one position, for sums and maxima; all of these rows are in one window (see :func:`fullest_block`).
    """
    kinds = [kind for kind, _ in wanted.values()]
    for kind in kinds:
        if kind not in _KINDS:
            raise ValueError(f"unknown scan kind {kind!r}")
        if then and not kind.startswith(("sum", "max")):
            raise ValueError(f"a scan of kind {kind!r} needs distinct positions")
    key = [*group, "_block"]
    cut = df.withColumn("_block", _block_of(position, block))
    values = {}
    for i, (kind, value) in enumerate(wanted.values()):
        if kind == "since":
            opens, weight = value
            values |= {f"_v{i}": F.coalesce(weight, F.lit(0)), f"_r{i}": F.when(opens, F.lit(0))}
        else:
            # a null is a value of the row before as well
            values[f"_v{i}"] = F.struct(value.alias("v")) if kind == "lag" else value
    cut = cut.withColumns(values)
    dealt = cut.repartition(tasks, *key) if tasks else cut
    local = _local(dealt, key, [position, *(then or [])], kinds, [kind in _BEFORE for kind in kinds])
    # the order within a block matters to sections; its rows lie sorted there already
    blocks = _states(local if "since" in kinds else cut, key, position, kinds)
    whole = _joined(local, _carried(blocks, group, kinds, block, 1), key, kinds)
    out = [(F.col(f"_l{i}.v") if kind == "lag" else F.col(f"_l{i}")).alias(name) for i, (name, kind) in enumerate(zip(wanted, kinds))]
    return whole.select(*df.columns, *out)
