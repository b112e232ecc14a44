"""The scalable building blocks against plain windows and brute force, large paths forced."""

import bisect
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.operators import intervals, order, region, summary
from gridspan.plans import joins, quantiles
from gridspan.plans.position import numbered_by, numbered_parquet, text_lines
from gridspan.plans.scan import prefix_scan
from tests.conftest import rows
from tests.oracle import plan

RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("block", [97, 8])
def test_scan_equals_window(spark, sf, block):
    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity", "l_orderkey"])
    mark = F.when(F.col("l_quantity") > 48, F.col("_row"))
    wanted = {
        "s": ("sum", F.col("l_quantity")),
        "sb": ("sum_before", F.col("l_quantity")),
        "m": ("max", F.col("l_orderkey")),
        "mb": ("max_before", F.col("l_orderkey")),
        "l": ("last", mark),
        "g": ("lag", F.col("l_orderkey")),
    }
    got = prefix_scan(df, ["l_returnflag"], "_row", wanted, block=block)
    df.createOrReplaceTempView("scanned")
    want = spark.sql(
        "select *, sum(l_quantity) over w s, coalesce(sum(l_quantity) over b, 0) sb, max(l_orderkey) over w m, max(l_orderkey) over b mb, "
        "last(case when l_quantity > 48 then _row end, true) over w l, lag(l_orderkey) over (partition by l_returnflag order by _row) g from scanned "
        "window w as (partition by l_returnflag order by _row rows between unbounded preceding and current row), "
        "b as (partition by l_returnflag order by _row rows between unbounded preceding and 1 preceding)"
    )
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("block", [1 << 16, 10, 3])
def test_sections_are_scanned_over_blocks_of_blocks(spark, block):
    """With blocks of three rows there are more blocks than one block holds, and more blocks of blocks."""
    rng = np.random.default_rng(block)
    data = [("a", i, bool(rng.random() < 0.02), None if rng.random() < 0.1 else int(rng.integers(0, 9))) for i in range(600) if rng.random() < 0.9]
    data += [("b", i, False, 1) for i in range(40)] + [("c", 5, True, 3)]
    df = spark.createDataFrame(data, "g string, p long, opens boolean, w long").repartition(5)
    wanted = {"since": ("since", (F.col("opens"), F.col("w"))), "name": ("last", F.when(F.col("opens"), F.col("p"))), "n": ("sum_before", F.lit(1))}
    got = {(r["g"], r["p"]): (r["since"], r["name"], r["n"]) for r in prefix_scan(df, ["g"], "p", wanted, block=block).collect()}
    state: dict = {}
    for g, p, opens, w in sorted(data):
        total, name, n = state.get(g, (0, None, 0))
        total, name = (0, p) if opens else (total + (w or 0), name)
        assert got[(g, p)] == (total, name, n)
        state[g] = (total, name, n + 1)
    assert len(got) == len(data)


def test_many_blocks_of_one_group(spark):
    df = spark.range(200_000).select(F.lit("one").alias("g"), F.col("id").alias("p"))
    got = prefix_scan(df, ["g"], "p", {"n": ("sum", F.lit(1)), "l": ("lag", F.col("p"))}, block=60)
    right = (F.col("n") == F.col("p") + 1) & F.coalesce(F.col("l") == F.col("p") - 1, F.col("p") == 0)
    assert got.agg(F.sum(right.cast("int"))).first()[0] == 200_000


def test_numbering(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = df.count()
    out = numbered_by(df, df.columns)
    got = out.agg(F.min("_row"), F.max("_row"), F.count_distinct("_row")).first()
    assert tuple(got) == (0, n - 1, n)
    ordered = [r[:4] for r in rows(out.orderBy("_row"))]
    assert ordered == sorted(ordered)


def test_numbering_over_files(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(1000).repartitionByRange(7, "id").write.parquet(path)
    got = rows(numbered_parquet(spark, path))
    assert sorted(r[1] for r in got) == list(range(1000))


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i}\n" * (1 if i % 5 else 2) for i in range(3000)))
    want = path.read_text().splitlines()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(rows(text_lines(spark, str(path)).select("line_no", "line")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))


@pytest.mark.parametrize("small", [1, 50])
def test_exact_percentiles(spark, sf, small):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_quantity", F.lit(3.0).alias("same"))
    shares = [0.0, 0.013, 0.5, 0.9, 1.0]
    counts = dict.fromkeys(df.columns, df.count())
    got = quantiles.exact_percentiles(df, df.columns, shares, counts, small)
    for c in df.columns:
        want = df.select(F.percentile(c, F.array(*map(F.lit, shares)))).first()[0]
        assert [got[(c, p)] for p in shares] == pytest.approx(want, rel=1e-12)


def test_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.5).alias("v"))
    got = quantiles.exact_percentiles(df, ["v"], [0.2, 0.4, 0.7], {"v": 30000}, 1)
    want = df.select(F.percentile("v", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.7)))).first()[0]
    assert [got[("v", p)] for p in (0.2, 0.4, 0.7)] == pytest.approx(want)


def test_percentiles_skip_nan_and_take_infinity(spark):
    special = F.when(F.col("id") % 10 == 0, float("nan")).when(F.col("id") % 10 == 1, None).when(F.col("id") % 100 == 2, float("inf"))
    df = spark.range(20000).select(special.otherwise(F.col("id") * 0.25 - 900).alias("v"))
    n = df.where("v is not null and not isnan(v)").count()
    got = quantiles.exact_percentiles(df, ["v"], [0.0, 0.1, 0.5, 1.0], {"v": n}, 10)
    clean = df.where("v is not null and not isnan(v)")
    want = clean.select(F.percentile("v", F.array(*map(F.lit, [0.0, 0.1, 0.5, 1.0])))).first()[0]
    assert [got[("v", p)] for p in (0.0, 0.1, 0.5, 1.0)] == want


def test_first_rows_by_counting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TOP", 10)
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), "id")
    got = quantiles.first_rows(df, [F.col("k"), F.col("id")], 3333)
    want = df.orderBy("k", "id").limit(3333)
    assert got.exceptAll(want).count() == 0 and got.count() == 3333
    assert quantiles.first_rows(df, [F.col("k")], 9999).count() == 5000


def test_first_rows_under_keys_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TOP", 10)
    df = spark.range(3000).select(
        F.concat(F.lit("https://example.org/"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("string")).alias("t"),
        (F.pmod(F.xxhash64("id"), F.lit(7)) / 3 - 1).alias("d"), F.expr("timestamp_seconds(id % 13)").alias("s"), "id",
    )
    keys = [F.col("t"), F.col("d"), F.col("s"), F.col("id")]
    for n in (11, 1500, 2999):
        got, want = quantiles.first_rows(df, keys, n), df.orderBy(*keys).limit(n)
        assert got.exceptAll(want).count() == 0 and got.count() == n
    assert quantiles.first_rows(df, keys[:1], 500).count() == 500


def test_a_large_head_is_not_a_top_k(spark):
    df = spark.range(600_000).withColumn("p", F.col("id") * 3 + (1 << 60))
    got = quantiles.first_rows(df, [F.col("p")], 500_000)
    assert "TakeOrdered" not in got._jdf.queryExecution().toString()
    assert got.agg(F.count("*"), F.max("id")).first() == (500_000, 499_999)


def select(spark, values, kind, small=3):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    ranks = list(range(len([v for v in values if v is not None and v == v])))
    got = quantiles.exact_ranks(df, {"v": ranks}, small)
    return [got[("v", r)] for r in ranks]


def test_ranks_of_doubles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None]
    values += [float(x) for x in rng.normal(size=40) * 10.0 ** rng.integers(-300, 300, 40)]
    for e in (-1074, -1023, -1022, -1, 0, 1, 52, 53, 1023):
        values += [2.0**e, float(np.nextafter(2.0**e, 0)), float(np.nextafter(2.0**e, 4.0)), -(2.0**e)]
    assert select(spark, values, "double") == sorted(v for v in values if v is not None and v == v)


def test_ranks_of_whole_numbers_decimals_and_texts_are_exact(spark):
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, (1 << 53) + 1, (1 << 53) + 1, (1 << 53) + 3, None]
    assert select(spark, ends, "long") == sorted(v for v in ends if v is not None)
    wide = [Decimal(x).scaleb(-3) for x in (0, 1, -1, 10**37, -(10**37), 10**26, 10**26 - 1, -(10**26) - 1, 10**13, -(10**13), 5 * 10**12)]
    assert select(spark, wide, "decimal(38,3)") == sorted(wide)
    narrow = [Decimal(x).scaleb(-2) for x in (0, 5, -5, 10**15, -(10**15))]
    assert select(spark, narrow, "decimal(18,2)") == sorted(narrow)
    texts = ["", "a", "a\0", "a\0b", "abcdefg", "abcdefgh", "abcdefg\0", "abcdefghijklmnopqrstu", "abcdefghijklmnopqrstuv", "é", "z", "東京", "a", None]
    assert select(spark, texts, "string") == sorted((t for t in texts if t is not None), key=lambda t: t.encode())


def test_percentiles_past_doubles(spark):
    df = spark.createDataFrame([((1 << 53) + 1,), ((1 << 53) + 1,), ((1 << 53) + 3,)], "v long")
    assert quantiles.exact_percentiles(df, ["v"], [0.5], {"v": 3})[("v", 0.5)] == (1 << 53) + 1
    shown = summary.describe(df, percentiles=(0.5, 0.75), as_text=True).first()
    assert (shown["p50"], shown["p75"]) == (str((1 << 53) + 1), str((1 << 53) + 2))


def test_jobs_do_not_grow_with_columns(spark, monkeypatch):
    turns = []
    turn = quantiles._turn
    monkeypatch.setattr(quantiles, "_turn", lambda df, keys, places, small: turns.append(len(places)) or turn(df, keys, places, small))
    rng = spark.range(20000)
    for n in (1, 12):
        turns.clear()
        df = rng.select(*[(F.xxhash64("id", F.lit(i)) % 100000).alias(f"c{i}") for i in range(n)])
        got = quantiles.exact_percentiles(df, df.columns, [0.25, 0.5], dict.fromkeys(df.columns, 20000), small=100)
        assert len(got) == 2 * n and len(turns) <= 5


def test_sample_is_exact_and_stable(spark):
    df = spark.range(20000)
    a = order.sample(df, 500, ["id"], seed=1)
    b = order.sample(df.repartition(13), 500, ["id"], seed=1)
    assert rows(a) == rows(b) and a.count() == 500
    assert rows(order.sample(df, 500, ["id"], seed=2)) != rows(a)
    draws = order.sample(df, 10000, ["id"], seed=3)
    assert 9000 < draws.agg(F.avg("id")).first()[0] < 11000


def test_lookup_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 200)
    left = spark.range(6000).select(hot.alias("k"), "id")
    right = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = joins.lookup_join(left, right, ["k"], how)
        want = left.join(right, "k", how)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_member_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 200)
    left = spark.range(3000).select(hot.alias("k"), "id")
    members = spark.range(150).select(F.col("id").alias("k"))
    members = members.union(members)
    for keep, test in ((True, "k < 150"), (False, "k >= 150")):
        got = joins.member_join(left, members, ["k"], keep)
        want = left.where(test)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def _pairs(a, w):
    return sorted((i, j) for i, (c, s, e) in enumerate(a) for j, (d, x, y) in enumerate(w) if c == d and s < y and e > x)


spans = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.sampled_from([0, 1, 2, 7, 40, 300])).map(lambda t: (t[0], t[1], t[1] + t[2])),
    min_size=1,
    max_size=40,
)


@pytest.mark.parametrize("broadcast", [True, False])
@RELAXED
@given(a=spans, w=spans)
def test_overlap_join_against_brute_force(spark, broadcast, a, w):
    with pytest.MonkeyPatch.context() as patch:
        if not broadcast:
            patch.setattr(region, "fits_broadcast", lambda *x, **k: False)
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "chrom string, start long, end long, i int")
        wins = spark.createDataFrame([(*r, j) for j, r in enumerate(w)], region.WINDOW_SCHEMA)
        got = rows(region.overlap_join(df, wins, share=3).select("i", "window_id"))
        assert sorted(got) == _pairs(a, w)
        once = [r[0] for r in rows(region.overlap_join(df, wins, "any", share=3).select("i"))]
        assert sorted(once) == sorted({i for i, _ in _pairs(a, w)})


@RELAXED
@given(a=spans)
def test_running_max_against_brute_force(spark, a):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "chrom string, start long, end long, i int")
    got = {r[3]: r[4] for r in rows(intervals.running_max_end(df))}
    for i, (c, s, e) in enumerate(a):
        assert got[i] == max(z for d, x, z in a if d == c and (x, z) <= (s, e))


@RELAXED
@given(a=spans, crowd=st.sampled_from([0, 1 << 20]))
def test_running_max_with_nulls(spark, monkeypatch, a, crowd):
    """By rows, and by distinct starts where a block is crowded; a row without chromosome or start takes its end."""
    a = [(None if i % 7 == 3 else c, None if i % 5 == 2 else s, None if i % 6 == 1 else e) for i, (c, s, e) in enumerate(a)]
    monkeypatch.setattr(intervals, "CROWD", crowd)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "chrom string, start long, end long, i int")
    got = {r[3]: r[4] for r in rows(intervals.running_max_end(df))}
    low = float("-inf")
    for i, (c, s, e) in enumerate(a):
        so_far = [z for d, x, z in a if None not in (c, s, d, x, z) and d == c and (x, z) <= (s, low if e is None else e)]
        assert got[i] == max(so_far, default=None if c is not None and s is not None else e)
    assert len(got) == len(a)


def test_running_max_shuffles_rows_by_blocks_only(spark, monkeypatch):
    """No join of the rows with a table of all starts."""
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    df = spark.range(3000).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 2).alias("end"))
    dealt = [line for line in plan(intervals.running_max_end(df)).splitlines() if "hashpartitioning" in line or "Join" in line]
    assert any("_block#" in line for line in dealt) and not any("start#" in line for line in dealt)


def test_a_scan_over_repeated_positions_is_for_sums_and_maxima(spark):
    df = spark.range(4).select((F.col("id") % 2).alias("p"), "id")
    with pytest.raises(ValueError, match="distinct positions"):
        prefix_scan(df, [], "p", {"l": ("lag", F.col("id"))}, then=["id"])
    got = prefix_scan(df, [], "p", {"s": ("sum", F.col("id")), "m": ("max", F.col("id"))}, block=1, then=["id"])
    assert sorted(rows(got)) == [(0, 0, 0, 0), (0, 2, 2, 2), (1, 1, 3, 2), (1, 3, 6, 3)]


def test_numbering_counts_its_rows_once(spark):
    """The count of each part is settled, so later passes over the numbered rows do not count again."""
    got = numbered_by(spark.range(100), ["id"])
    assert "Aggregate" not in plan(got)


def test_a_crowded_bin_is_spread(spark, monkeypatch):
    """A third of the rows in one bin end up in several tasks, and no pair is lost."""
    monkeypatch.setattr(region, "fits_broadcast", lambda *a, **k: False)
    df = spark.range(9000).select(
        F.lit("c").alias("chrom"),
        F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") * 50).alias("start"),
        F.when(F.col("id") % 3 == 0, 110).otherwise(F.col("id") * 50 + 10).alias("end"),
        F.col("id").alias("i"),
    )
    wins = spark.createDataFrame([("c", 105, 108, 0), ("c", 5000, 9000, 1)], region.WINDOW_SCHEMA)
    prepared = region._prepare(df, F.col("chrom"), F.col("start"), F.col("end"))
    a = region._emit(prepared, {0}, {0}, 6)
    b = region._emit(region._window_side(wins, False), {0, 3}, {0}, 6)
    salted, repeated = region._salted(a, b, ["_c", "_cell"], share=200)
    hot = salted.where("start = 100").groupBy("_salt").count()
    assert hot.count() >= 15 and hot.agg(F.max("count")).first()[0] < 400
    got = region.overlap_join(df, wins, share=200).count()
    want = sum(1 for i in range(9000) for x, y in ((105, 108), (5000, 9000)) if _over(i, x, y))
    assert got == want


def _over(i, x, y):
    s, e = (100, 110) if i % 3 == 0 else (i * 50, i * 50 + 10)
    return s < y and e > x


def test_open_windows(spark):
    df = spark.createDataFrame([("c", i, i + 2, i) for i in range(100)], "chrom string, start long, end long, i int")
    wins = spark.createDataFrame([("c", None, 10, 0), ("c", 90, None, 1), ("c", None, None, 2)], region.WINDOW_SCHEMA)
    got = region.overlap_join(df, wins).groupBy("window_id").count()
    assert dict(rows(got)) == {0: 10, 1: 11, 2: 100}
    assert region.overlap_join(df, wins, "any").count() == 100


@RELAXED
@given(a=spans, w=spans, seed=st.integers(0, 3))
def test_overlap_counts_against_brute_force(spark, a, w, seed):
    """Open windows at either side, and with some seeds reversed rows and windows."""
    a = [(c, e, s) if seed & 1 and i % 5 == 0 else (c, s, e) for i, (c, s, e) in enumerate(a)]
    w = [(c, e, s) if seed & 2 and j % 5 == 0 else (c, None if j % 7 == 1 else s, None if j % 4 == 3 else e) for j, (c, s, e) in enumerate(w)]
    df = spark.createDataFrame(a, "chrom string, start long, end long")
    wins = spark.createDataFrame([(*r, j) for j, r in enumerate(w)], region.WINDOW_SCHEMA)
    far = 1 << 56
    pairs = _pairs(a, [(c, -far if s is None else s, far if e is None else e) for c, s, e in w])
    want = {j: sum(1 for _, k in pairs if k == j) for j in range(len(w))}
    assert dict(rows(region.overlap_counts(df, wins).select("window_id", "n_rows"))) == want


def test_overlap_counts_make_no_pairs(spark):
    """3000 open windows over 3000 rows: what is grouped and joined is a few rows each, not their product."""
    df = spark.range(3000).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 2).alias("end"))
    wins = spark.range(3000).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), F.lit(None).cast("long").alias("end"), F.col("id").alias("window_id"))
    got = region.overlap_counts(df, wins)
    assert dict(rows(got.select("window_id", "n_rows"))) == {i: min(3001 - i, 3000) for i in range(3000)}
    assert "_cell" not in plan(got)


def test_far_coordinates(spark):
    far = (1 << 50) + 5
    df = spark.createDataFrame([("c", far, far + 3), ("c", 0, far * 2), ("c", 4, 4)], "chrom string, start long, end long")
    wins = spark.createDataFrame([("c", far + 1, far + 2, 0), ("c", 3, 5, 1)], region.WINDOW_SCHEMA)
    assert sorted(rows(region.overlap_join(df, wins).select("start", "window_id"))) == [(0, 0), (0, 1), (4, 1), (far, 0)]


def test_bisect_is_the_same_merge(spark):
    wins = [("c", 0, 6), ("c", 5, 10), ("c", 10, 12), ("c", 20, 30), ("c", 22, 25)]
    frame = region._window_side(spark.createDataFrame([(*w, i) for i, w in enumerate(wins)], region.WINDOW_SCHEMA), False)
    merged = sorted(r[1:] for r in rows(region.merged_windows(frame)))
    assert merged == [(0, 10, None), (10, 12, 10), (20, 30, 12)]
    assert bisect.bisect([m[0] for m in merged], 11) == 2
