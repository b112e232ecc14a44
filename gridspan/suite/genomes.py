"""Queries on intervals, variants, reads, sequences, labels and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coords import assembly, cigar_span, standard_name, with_span
from ..operators import compare, interval_layout, intervals, json_ops, labels, reads, region, reshape, sequences, signal, variants
from ..plans.position import numbered_by
from ..session import scratch_path, settle
from . import base
from .base import FORMAT_FIELDS, INTERVALS_SQL, WINDOWS_SQL, genotypes, genotypes_sql, query, shares, table, windows

_COORDS = ("chrom", "start", "end")
_IV = f"({INTERVALS_SQL}) i"
_ROW = "i.chrom, i.start, i.\"end\", i.l_linenumber, i.l_partkey, i.l_suppkey"
_KEEP = ["chrom", "start", "end", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "R_1_region_list",
    "SELECT n_name AS chrom, CASE n_nationkey % 3 WHEN 2 THEN NULL ELSE n_nationkey END AS start, "
    "CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 9 WHEN 1 THEN NULL ELSE n_nationkey + 1 END AS \"end\" FROM nation",
)
def region_list(spark, sf):
    first = (F.col("n_nationkey") + 1).cast("string")
    closed = F.concat(first, F.lit("-"), (F.col("n_nationkey") + 9).cast("string"))
    kind = F.col("n_nationkey") % 3
    spot = F.when(kind == 0, closed).when(kind == 1, F.concat(first, F.lit("-"))).otherwise(F.concat(F.lit("-"), first))
    texts = table(spark, sf, "nation").select(F.concat("n_name", F.lit(":"), spot).alias("region"))
    # a list that a user writes: one row per nation
    parsed = region.parse_regions(",".join(r["region"] for r in texts.collect()), "NCBI")
    return region.windows_frame(spark, parsed).drop("window_id")


@query(
    "R_2_half_open",
    f"SELECT chrom, greatest(start - 1, 0) AS start, \"end\", window_id FROM ({WINDOWS_SQL}) w",
)
def half_open(spark, sf):
    return region.to_half_open(windows(spark, sf), "1-based")


@query(
    "R_3_slop",
    f"SELECT chrom, greatest(start - 25, 0) AS start, \"end\" + 25 AS \"end\", window_id FROM ({WINDOWS_SQL}) w",
)
def slopped(spark, sf):
    return region.slop_frame(windows(spark, sf), 25)


@query(
    "R_4_regions_from_a_frame",
    f"SELECT {_ROW} FROM {_IV} WHERE EXISTS (SELECT 1 FROM (SELECT chrom, start, \"end\" FROM ({WINDOWS_SQL}) v UNION ALL SELECT 'A', 100, 400) w "
    "WHERE w.chrom = i.chrom AND i.start < w.\"end\" AND i.\"end\" > w.start)",
)
def regions_and_list(spark, sf):
    both = windows(spark, sf).unionByName(region.windows_frame(spark, [("A", 100, 400)]))
    return region.overlap_join(base.intervals(spark, sf), both, "any").select(*_KEEP)


@query(
    "R_5_coordinate_columns",
    "SELECT l_returnflag AS seqname, l_orderkey AS \"chromStart\", l_orderkey + 3 AS stop FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey < 900 AND l_orderkey + 3 > 500",
)
def named_columns(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("seqname"), F.col("l_orderkey").alias("chromStart"), (F.col("l_orderkey") + 3).alias("stop")
    )
    return region.overlap_filter(df, [("N", 500, 900)])


@query(
    "R_6_overlap_filter",
    f"SELECT {_ROW} FROM {_IV} WHERE (chrom = 'A' AND start < 300 AND \"end\" > 100) OR (chrom = 'R' AND start < 2000 AND \"end\" > 1950) OR (chrom = 'N' AND \"end\" > 14000)",
)
def overlap_filter(spark, sf):
    wanted = region.parse_regions("A:100-300,R:1950-2000,N:14000-")
    return region.overlap_filter(base.intervals(spark, sf), wanted).select(*_KEEP)


_PAIRS = f"FROM {_IV} JOIN ({WINDOWS_SQL}) w ON w.chrom = i.chrom AND i.start < w.\"end\" AND i.\"end\" > w.start"


@query("R_7_overlap_join_per_window", f"SELECT {_ROW}, w.window_id {_PAIRS}")
def per_window(spark, sf):
    return region.overlap_join(base.intervals(spark, sf), windows(spark, sf)).select(*_KEEP, "window_id")


@query(
    "R_7_overlap_join_any",
    f"SELECT {_ROW} FROM {_IV} WHERE EXISTS (SELECT 1 FROM ({WINDOWS_SQL}) w WHERE w.chrom = i.chrom AND i.start < w.\"end\" AND i.\"end\" > w.start)",
)
def any_window(spark, sf):
    return region.overlap_join(base.intervals(spark, sf), windows(spark, sf), "any").select(*_KEEP)


@query("R_12_layout_overlap_join", f"SELECT {_ROW}, w.window_id {_PAIRS} AND w.window_id % 7 < 3 AND w.start > (SELECT max(o_orderkey) FROM orders) * 3 // 4")
def layout_join(spark, sf):
    """A table in folders by chromosome and bin; the windows lie in a quarter of it."""
    path = scratch_path(spark, "layout")
    interval_layout.write_layout(base.intervals(spark, sf), path, bits=10)
    last = table(spark, sf, "orders").agg(F.floor(F.max("o_orderkey") * 3 / 4)).scalar()
    wanted = windows(spark, sf).where((F.col("window_id") % 7 < 3) & (F.col("start") > last))
    return interval_layout.layout_overlap_join(spark, path, wanted).select(*_KEEP, "window_id")


_WIDE = (
    "SELECT chrom, start - window_id % 4 * 300 AS start, CASE WHEN window_id % 97 = 0 THEN NULL ELSE \"end\" + window_id % 3 * 700 END AS \"end\", "
    f"window_id FROM ({WINDOWS_SQL}) v"
)


@query(
    "R_7_overlap_join_mixed_widths",
    f"SELECT w.window_id, count(*) AS rows_over FROM {_IV} JOIN ({_WIDE}) w ON w.chrom = i.chrom AND i.\"end\" > w.start AND (w.\"end\" IS NULL OR i.start < w.\"end\") GROUP BY 1",
)
def mixed_widths(spark, sf):
    key = F.col("window_id")
    wide = windows(spark, sf).select(
        "chrom",
        (F.col("start") - key % 4 * 300).alias("start"),
        F.when(key % 97 != 0, F.col("end") + key % 3 * 700).alias("end"),
        "window_id",
    )
    met = region.overlap_counts(base.intervals(spark, sf).select(*_COORDS), wide, "rows_over")
    return met.where("rows_over > 0").groupBy("window_id").agg(F.sum("rows_over").alias("rows_over"))


_ALIAS_SQL = (
    "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'chr1' WHEN 1 THEN '1' WHEN 2 THEN 'chrM' ELSE 'scaffold1' END AS chrom FROM orders"
)


@query(
    "R_9_chromosome_alias",
    f"SELECT o_orderkey, CASE chrom WHEN 'chr1' THEN '1' WHEN 'chrM' THEN 'MT' ELSE chrom END AS name FROM ({_ALIAS_SQL}) t WHERE chrom IN ('chr1', '1', 'chrM')",
)
def aliased(spark, sf):
    key = F.col("o_custkey") % 4
    chrom = F.when(key == 0, "chr1").when(key == 1, "1").when(key == 2, "chrM").otherwise("scaffold1")
    df = table(spark, sf, "orders").select(
        "o_orderkey", chrom.alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end")
    )
    kept = region.overlap_filter(df, [("1", None, None), ("MT", None, None)], alias=True)
    return kept.select("o_orderkey", standard_name(F.col("chrom")).alias("name"))


@query(
    "R_8_spans",
    "SELECT o_orderkey, o_orderkey - 1 AS _start, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey + 50 ELSE o_orderkey - 1 + o_custkey % 4 + 1 END AS _end FROM orders",
)
def spans(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.expr("repeat('A', cast(o_custkey % 4 + 1 as int))")
    info = F.when(cust % 3 == 0, F.concat(F.lit("DP=3;END="), (key + 50).cast("string"))).otherwise("XEND=4")
    df = table(spark, sf, "orders").select(
        key, F.lit("1").alias("CHROM"), key.alias("POS"), ref.alias("REF"), info.alias("INFO")
    )
    return with_span(df, "vcf").select("o_orderkey", "_start", "_end")


@query(
    "R_8_spans_of_other_layouts",
    "SELECT 'bed' AS layout, l_orderkey, l_linenumber, l_returnflag AS _chrom, l_orderkey AS _start, CASE WHEN l_linenumber = 1 THEN l_orderkey + 1 ELSE l_orderkey + l_linenumber - 1 END AS _end FROM lineitem "
    "UNION ALL SELECT 'gff', l_orderkey, l_linenumber, l_returnflag, l_orderkey - 1, l_orderkey + l_linenumber - 1 FROM lineitem "
    "UNION ALL SELECT 'paf', l_orderkey, l_linenumber, l_returnflag, l_orderkey, l_orderkey + l_linenumber - 1 FROM lineitem "
    "UNION ALL SELECT 'mpileup', l_orderkey, l_linenumber, l_returnflag, l_orderkey - 1, l_orderkey FROM lineitem",
)
def other_spans(spark, sf):
    names = {"bed": ("Chr", "[Beg", "End)"), "gff": ("seqname", "start", "end"), "paf": ("tname", "tstart", "tend"), "mpileup": ("chrom", "pos", "depth")}
    at, stop = F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber") - 1
    found = None
    for layout, columns in names.items():
        cells = [c.alias(n) for c, n in zip((F.col("l_returnflag"), at, stop), columns)]
        df = with_span(table(spark, sf, "lineitem").select(*cells, "l_orderkey", "l_linenumber"), layout)
        df = df.select(F.lit(layout).alias("layout"), "l_orderkey", "l_linenumber", "_chrom", "_start", "_end")
        found = df if found is None else found.unionByName(df)
    return found


_CIGAR_SQL = "(CAST(l_quantity AS BIGINT) || 'M' || l_linenumber || 'I2D5S')"


@query(
    "C12_cigar_span",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {_CIGAR_SQL} AS cigar, CAST(l_quantity AS BIGINT) + 2 AS span FROM lineitem",
)
def cigar(spark, sf):
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("I2D5S"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("cigar"))
    return df.withColumn("span", cigar_span(F.col("cigar")))


@query(
    "C13_assembly",
    "SELECT n_name, CASE n_nationkey WHEN 0 THEN 'GRCh38 / hg38 (Homo sapiens)' WHEN 1 THEN 'GRCm39 / mm39 (Mus musculus)' END AS found FROM nation",
)
def assemblies(spark, sf):
    key = F.col("n_nationkey")
    length = F.when(key == 1, 195154279).otherwise(248956422)
    name = F.when(key == 0, "chr1").when(key == 1, "1").otherwise("chr2")
    return table(spark, sf, "nation").select("n_name", assembly(name, length).alias("found"))


def _pixels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("bin1_id"), F.col("l_suppkey").alias("bin2_id"), F.col("l_quantity").alias("count"), "l_orderkey", "l_linenumber"
    )


def _bins(spark, sf):
    key = F.col("p_partkey")
    weight = F.when(key % 11 == 0, float("nan")).otherwise(F.col("p_size") / 64)
    return table(spark, sf, "part").select(
        key.alias("bin_id"),
        F.concat(F.lit("chr"), (F.floor(key / 100) + 1).cast("string")).alias("chrom"),
        (key % 100 * 1000).alias("start"),
        (key % 100 * 1000 + 1000).alias("end"),
        weight.alias("weight"),
    )


_BIN_COLUMNS = (
    "'chr' || (b{s}.p_partkey // 100 + 1) AS chrom{s}, b{s}.p_partkey % 100 * 1000 AS start{s}, b{s}.p_partkey % 100 * 1000 + 1000 AS end{s}"
)


@query(
    "J_b_join_bins",
    f"SELECT l_partkey AS bin1_id, l_suppkey AS bin2_id, {_BIN_COLUMNS.format(s=1)}, {_BIN_COLUMNS.format(s=2)}, l_quantity AS count, l_orderkey, l_linenumber, "
    "CASE WHEN b1.p_partkey % 11 <> 0 AND b2.p_partkey % 11 <> 0 THEN l_quantity * (b1.p_size / 64) * (b2.p_size / 64) END AS balanced "
    "FROM lineitem LEFT JOIN part b1 ON b1.p_partkey = l_partkey LEFT JOIN part b2 ON b2.p_partkey = l_suppkey",
)
def bin_join(spark, sf):
    return labels.join_bins(_pixels(spark, sf), _bins(spark, sf))


@query(
    "R_10_submatrix",
    "SELECT l_partkey AS bin1_id, l_suppkey AS bin2_id, l_quantity AS count, l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_partkey // 100 = 1 AND l_partkey % 100 < 40 AND l_suppkey // 100 = 0 AND l_suppkey % 100 >= 20",
)
def submatrix(spark, sf):
    return region.submatrix(
        _pixels(spark, sf), _bins(spark, sf), region.parse_regions("2:0-40000"), region.parse_regions("chr1:20000-")
    )


@query(
    "J_a_label_entries",
    "SELECT l_orderkey, l_linenumber, l_partkey AS row, l_suppkey AS col, n_name AS feature, r_name AS barcode FROM lineitem LEFT JOIN nation ON n_nationkey = l_partkey "
    "LEFT JOIN region ON r_regionkey = l_suppkey",
)
def labelled(spark, sf):
    entries = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))
    features = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("feature"))
    barcodes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("index"), F.col("r_name").alias("barcode"))
    return labels.label_entries(entries, features, barcodes)


@query(
    "J_e_decode_categories",
    "SELECT s_suppkey, s_nationkey - 2 AS code, n_name AS label FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey - 2",
)
def decoded(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("label"))
    coded = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") - 2).alias("code"))
    return labels.decode_categories(coded, "code", names)


@query(
    "P10_edge_list",
    "SELECT c_nationkey AS i, c_custkey % 30 AS j, a.n_name AS name_i, b.n_name AS name_j, c_acctbal AS weight FROM customer "
    "LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 30",
)
def edges(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    e = table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") % 30).alias("k"), "c_acctbal")
    return reshape.edge_list(e, names, "c_nationkey", "k", "c_acctbal")


_REACH = 'max("end") OVER (PARTITION BY chrom ORDER BY start, "end" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'


@query("W1_running_max_end", f"SELECT {_ROW}, {_REACH} AS \"MaxEndSoFar\" FROM {_IV}")
def running_max(spark, sf):
    return intervals.running_max_end(base.intervals(spark, sf)).select(*_KEEP, "MaxEndSoFar")


@query(
    "R_12_pruned_region_read",
    f"SELECT {_ROW} FROM {_IV} WHERE chrom = 'N' AND start < 5200 AND \"end\" > 5000",
)
def pruned(spark, sf):
    path = base.scratch_path(spark, "sorted")
    intervals.sorted_layout(base.intervals(spark, sf)).write.parquet(path)
    return region.pruned_overlap_filter(spark.read.parquet(path), [("N", 5000, 5200)]).select(*_KEEP)


@query(
    "W3_out_of_order",
    "SELECT count(*) AS n_rows FROM (SELECT start, \"end\", lag(start) OVER w AS ps, lag(\"end\") OVER w AS pe FROM (SELECT l_returnflag AS chrom, l_orderkey AS start, "
    "l_orderkey + CAST(l_quantity AS BIGINT) AS \"end\", row_number() OVER () AS r FROM lineitem) t WINDOW w AS (PARTITION BY chrom ORDER BY r)) q "
    "WHERE ps IS NOT NULL AND (start < ps OR (start = ps AND \"end\" < pe))",
)
def unsorted(spark, sf):
    from ..plans.position import numbered_parquet

    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_orderkey", "l_quantity"])
    df = df.select(
        F.col("l_returnflag").alias("chrom"),
        F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
        "_row",
    )
    return intervals.out_of_order(df, "_row").agg(F.count("*").alias("n_rows"))


def _sorted_with_reach(spark, sf):
    """A sorted-interval table with its row number. Rows alike in all three columns may take each other's place."""
    rows = base.intervals(spark, sf).select(*_COORDS)
    # several passes read it
    return settle(intervals.running_max_end(numbered_by(rows, _COORDS)))


@query(
    "R5_validate",
    f"WITH t AS (SELECT chrom, start, \"end\", {_REACH} AS reach FROM {_IV}) SELECT * FROM (VALUES ('chrom is text', 'PASS', 0), ('start is a whole number', 'PASS', 0), "
    "('end is a whole number', 'PASS', 0), ('MaxEndSoFar is a whole number', 'PASS', 0), ('no null coordinates', 'PASS', 0), ('each chromosome is one block', 'PASS', 0), "
    "('rows are sorted by (start, end)', 'PASS', 0)) v(\"check\", status, violations) UNION ALL "
    "SELECT 'MaxEndSoFar is the running maximum of end', 'FAIL', count(CASE WHEN start % 500 = 0 AND reach <> \"end\" - 1 THEN 1 END) FROM t",
)
def validated(spark, sf):
    df = _sorted_with_reach(spark, sf)
    wrong = F.when(F.col("start") % 500 == 0, F.col("end") - 1).otherwise(F.col("MaxEndSoFar"))
    return intervals.validate_intervals(df.withColumn("MaxEndSoFar", wrong), "_row").drop("examples")


@query(
    "R5_validate_blocks",
    f"SELECT 'the blocks hold every row once' AS \"check\", 'PASS' AS status, 0 AS violations UNION ALL "
    f"SELECT 'every row has the chromosome of its block', 'FAIL', count(CASE WHEN start % 333 = 0 AND chrom <> 'N' THEN 1 END) FROM {_IV}",
)
def validated_blocks(spark, sf):
    """Labels against the blocks written beside the table; some rows carry another chromosome's name."""
    df = _sorted_with_reach(spark, sf)
    blocks = intervals.chromosome_blocks(df, "_row")
    named = df.withColumn("chrom", F.when(F.col("start") % 333 == 0, "N").otherwise(F.col("chrom")))
    report = intervals.validate_intervals(named, "_row", blocks=blocks).drop("examples")
    return report.where(F.col("check").like("%block%") & ~F.col("check").like("each%"))


_BINNED = (
    f"WITH w AS (SELECT chrom, start AS ws, \"end\" AS we, window_id, least(6, \"end\" - start) AS n FROM ({WINDOWS_SQL}) v), "
    "s AS (SELECT chrom, ws, we, window_id, n, i AS bin, ws + (we - ws) * i // n AS bs, ws + (we - ws) * (i + 1) // n AS be FROM (SELECT *, unnest(range(n)) AS i FROM w) q) "
    "SELECT s.window_id, s.chrom, bs AS start, be AS \"end\", bin, round(sum(value * (least(i.\"end\", be) - greatest(i.start, bs))) / sum(least(i.\"end\", be) - greatest(i.start, bs)), 10) AS mean, "
    "min(value) AS min, max(value) AS max, round(sum(CASE WHEN i.start IS NULL THEN 0 ELSE least(i.\"end\", be) - greatest(i.start, bs) END) / (be - bs), 7) AS coverage "
    f"FROM s LEFT JOIN {_IV} ON i.chrom = s.chrom AND i.start < be AND i.\"end\" > bs GROUP BY s.window_id, s.chrom, bs, be, bin"
)


@query("A10_binned_signal", _BINNED)
def binned(spark, sf):
    out = signal.binned_signal(base.intervals(spark, sf), windows(spark, sf), 6)
    return shares(shares(out, "mean", digits=10), "coverage")


def _gt_sql() -> str:
    calls = genotypes_sql()
    kind = "CASE WHEN lone OR gt IN ('./.', '.') THEN 'missing' WHEN gt IN ('0/0', '0') THEN 'ref' WHEN gt = '1/1' THEN 'alt' ELSE 'het' END"
    an = "CASE WHEN lone OR gt IN ('./.', '.') THEN 0 WHEN gt = '0' THEN 1 ELSE 2 END"
    ac = "CASE WHEN lone THEN 0 WHEN gt IN ('1/1', '1|2') THEN 2 WHEN gt = '0/1' THEN 1 ELSE 0 END"
    return (
        f"SELECT POS, n_called, n_het, n_hom_ref, n_hom_alt, n_missing, AC, AN, CASE WHEN AN > 0 THEN AC / AN END AS AF, n_called / 4 AS call_rate FROM ("
        f"SELECT o_orderkey AS POS, count(CASE WHEN k <> 'missing' THEN 1 END) AS n_called, count(CASE WHEN k = 'het' THEN 1 END) AS n_het, "
        f"count(CASE WHEN k = 'ref' THEN 1 END) AS n_hom_ref, count(CASE WHEN k = 'alt' THEN 1 END) AS n_hom_alt, count(CASE WHEN k = 'missing' THEN 1 END) AS n_missing, "
        f"CAST(sum(ac) AS BIGINT) AS AC, CAST(sum(an) AS BIGINT) AS AN FROM (SELECT o_orderkey, {kind} AS k, {an} AS an, {ac} AS ac FROM {calls} c) t GROUP BY 1) g"
    )


@query("P12_gt_stats", _gt_sql())
def gt(spark, sf):
    return variants.gt_stats(genotypes(spark, sf)).drop("CHROM", "FORMAT", "S1", "S2", "S3", "S4")


@query(
    "C10_classify_genotypes",
    f"SELECT o_orderkey AS \"POS\", sample, CASE WHEN lone OR gt IN ('./.', '.') THEN 'missing' WHEN gt IN ('0/0', '0') THEN 'hom_ref' WHEN gt = '1/1' THEN 'hom_alt' ELSE 'het' END AS kind FROM {genotypes_sql()} c",
)
def classified(spark, sf):
    from ..functions.genotype import genotype

    long = variants.samples_long(genotypes(spark, sf), fields=FORMAT_FIELDS)
    return long.select("POS", "sample", genotype(F.col("GT"))["kind"].alias("kind"))


@query(
    "P8_samples_long",
    f"SELECT o_orderstatus AS \"CHROM\", o_orderkey AS \"POS\", sample, CASE WHEN NOT lone AND gt <> '.' THEN gt END AS \"GT\", CASE WHEN NOT lone THEN ad0 END AS ad0, "
    f"CASE WHEN NOT lone THEN ad1 END AS ad1, CASE WHEN NOT lone THEN dp END AS \"DP\" FROM {genotypes_sql()} c",
)
def long_samples(spark, sf):
    out = variants.samples_long(genotypes(spark, sf), fields=FORMAT_FIELDS)
    return out.withColumns({"ad0": F.col("AD")[0], "ad1": F.col("AD")[1]}).drop("AD")


@query(
    "P7_samples_struct",
    f"SELECT o_orderkey AS \"POS\", max(CASE WHEN i = 1 THEN lone::INT END) = 1 AS \"S1_missing\", max(CASE WHEN i = 1 AND NOT lone AND gt <> '.' THEN gt END) AS \"S1.GT\", "
    "max(CASE WHEN i = 2 AND NOT lone THEN dp END) AS \"S2.DP\", max(CASE WHEN i = 4 AND NOT lone THEN ad1 END) AS ad1 "
    f"FROM {genotypes_sql()} c GROUP BY 1",
)
def struct_samples(spark, sf):
    out = variants.samples_struct(genotypes(spark, sf), fields=FORMAT_FIELDS)
    flat = reshape.flatten(out.withColumn("S1_missing", F.col("S1").isNull()))
    return flat.select("POS", "S1_missing", "`S1.GT`", "`S2.DP`", F.col("`S4.AD`")[1].alias("ad1"))


@query(
    "P11_decode_pileup",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k < 3 THEN k END IS NOT NULL AS low, "
    "(CASE WHEN ref = 'A' THEN 2 ELSE 0 END) + 1 AS \"A\", (CASE WHEN ref = 'C' THEN 2 ELSE 0 END) + 1 AS \"C\", (CASE WHEN ref = 'G' THEN 2 ELSE 0 END) + n AS \"G\", 1 AS \"T\", "
    "(CASE WHEN ref = 'N' THEN 2 ELSE 0 END) AS \"N\", 1 AS del_placeholder, 1 AS ins, CAST(k > 2 AS BIGINT) AS del, 2 AS fwd, 3 + n AS rev, "
    "round((40 + 40 + 40 + 30 + 0 + n * 20) / (5 + n)::DOUBLE, 7) AS mean_qual FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber AS k, CAST(l_quantity AS BIGINT) % 4 AS n, "
    "['A', 'C', 'G', 'N'][CAST(l_partkey % 4 AS INTEGER) + 1] AS ref FROM lineitem) t",
)
def pileup_cells(spark, sf):
    n = (F.col("l_quantity").cast("long") % 4).cast("int")
    ref = F.get(F.array(*[F.lit(x) for x in "acgn"]), (F.col("l_partkey") % 4).cast("int"))
    # . and , match; A forward; t reverse after an insertion; * deleted; g reverse n times
    indel = F.when(F.col("l_linenumber") > 2, "-12ACGTACGTACGT").otherwise("")
    bases = F.concat(F.lit("^+.$,"), indel, F.lit("A+3gattc*"), F.call_function("repeat", F.lit("g"), n), F.lit(">"))
    quals = F.concat(F.lit("III?!~"), F.call_function("repeat", F.lit("5"), n), F.lit("~"))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") < 3).alias("low"), ref.alias("ref"), bases.alias("bases"), quals.alias("quals")
    )
    return shares(reads.decode_pileup(df).drop("ref", "bases", "quals"), "mean_qual")


def _alignments(spark, sf):
    k = F.col("l_linenumber")
    long = F.call_function("repeat", F.lit("ACGT"), F.lit(4))
    seq = F.concat(F.lit("NN"), F.substring(long, F.lit(1), k), F.lit("TT"))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("QNAME"),
        F.when(F.col("l_linestatus") == "F", 16).otherwise(0).alias("FLAG"),
        F.col("l_returnflag").alias("RNAME"),
        (F.col("l_orderkey") + 1).alias("POS"),
        (k * 10).alias("MAPQ"),
        F.concat(F.lit("2S"), k.cast("string"), F.lit("M3D2M")).alias("CIGAR"),
        seq.alias("SEQ"),
        F.concat(F.lit("##"), F.call_function("repeat", F.lit("I"), k), F.lit("5+")).alias("QUAL"),
    )


_PILED = (
    "WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS name, l_returnflag AS chrom, l_orderkey + 1 AS p, l_linenumber AS k, l_linestatus = 'F' AS rev FROM lineitem "
    "WHERE l_linenumber >= 2), b AS (SELECT name, chrom, p, k, p + i AS pos, substr('ACGTACGTACGT', CAST(i + 1 AS INTEGER), 1) AS s, 40 AS q, rev, i = k - 1 AS dels, i = 0 AS head FROM "
    "(SELECT *, unnest(range(k)) AS i FROM r) t UNION ALL SELECT name, chrom, p, k, p + k + i, '*', 20, rev, false, false FROM (SELECT *, unnest(range(3)) AS i FROM r) t UNION ALL "
    "SELECT name, chrom, p, k, p + k + 3, 'T', 20, rev, false, false FROM r UNION ALL SELECT name, chrom, p, k, p + k + 4, 'T', 10, rev, false, false FROM r) "
)


@query(
    "A11_pileup",
    _PILED + "SELECT chrom, pos, count(CASE WHEN q > 12 THEN 1 END) AS depth, count(CASE WHEN s = 'A' THEN 1 END) AS \"A\", count(CASE WHEN s = 'C' THEN 1 END) AS \"C\", "
    "count(CASE WHEN s = 'G' THEN 1 END) AS \"G\", count(CASE WHEN s = 'T' AND q > 12 THEN 1 END) AS \"T\", 0 AS \"N\", count(CASE WHEN s = '*' THEN 1 END) AS del_placeholder, 0 AS ins, "
    "count(CASE WHEN dels THEN 1 END) AS del, count(CASE WHEN s <> '*' AND q > 12 AND NOT rev THEN 1 END) AS fwd, count(CASE WHEN s <> '*' AND q > 12 AND rev THEN 1 END) AS rev, "
    "round(avg(CASE WHEN s <> '*' AND q > 12 THEN q END), 7) AS mean_qual FROM b GROUP BY 1, 2",
)
def piled(spark, sf):
    # the second base after the deletion has quality 10 and falls below the bound
    return shares(reads.pileup(_alignments(spark, sf), min_mapq=20), "mean_qual")


@query(
    "A11_pileup_text",
    _PILED + "SELECT chrom, pos, 'N' AS ref, 0 AS part, count(*) AS depth, string_agg((CASE WHEN head THEN '^' || chr(CAST(k * 10 + 33 AS INTEGER)) ELSE '' END) || CASE WHEN rev THEN lower(s) ELSE s END || "
    "(CASE WHEN dels AND rev THEN '-3nnn' WHEN dels THEN '-3NNN' ELSE '' END) , '' ORDER BY p, name) AS bases, string_agg(chr(q + 33), '' ORDER BY p, name) AS quals FROM b WHERE q > 12 GROUP BY 1, 2",
)
def piled_text(spark, sf):
    return reads.pileup_text(_alignments(spark, sf), min_mapq=20)


def _mates(spark, sf):
    """Two reads of ten bases a line, the second up to five bases on and in a third of the pairs begun by another letter."""
    shift = F.col("l_linenumber") % 6
    long = F.call_function("repeat", F.lit("ACGT"), F.lit(6))
    letters = lambda at: F.substring(long, (at % 4 + 1).cast("int"), F.lit(10))
    second = letters(F.col("l_orderkey") + shift)
    second = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("N"), F.substring(second, 2, 9))).otherwise(second)
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    read = lambda flag, at, seq, qual: F.struct(
        F.lit(flag).alias("FLAG"), (at + 1).alias("POS"), seq.alias("SEQ"), F.call_function("repeat", F.lit(qual), F.lit(10)).alias("QUAL")
    )
    both = F.array(read(99, F.col("l_orderkey"), letters(F.col("l_orderkey")), "I"), read(147, F.col("l_orderkey") + shift, second, "5"))
    return table(spark, sf, "lineitem").select(
        name.alias("QNAME"), F.col("l_returnflag").alias("RNAME"), F.lit("=").alias("RNEXT"), F.lit(60).alias("MAPQ"), F.lit("10M").alias("CIGAR"), F.inline(both)
    )


@query(
    "A11_pileup_of_overlapping_mates",
    "WITH l AS (SELECT l_returnflag AS chrom, l_orderkey + 1 AS p, l_linenumber % 6 AS d, l_partkey % 3 = 0 AS odd FROM lineitem), "
    "t AS (SELECT chrom, p, d, odd, unnest(range(10)) AS i FROM l), "
    "b AS (SELECT chrom, p + i AS pos, CASE WHEN i < d THEN 40 WHEN i = d AND odd THEN 32 ELSE 60 END AS q, false AS rev, substr('ACGT', CAST((p + i - 1) % 4 + 1 AS INTEGER), 1) AS s FROM t "
    "UNION ALL SELECT chrom, p + d + i, CASE WHEN i < 10 - d THEN 0 ELSE 20 END, true, CASE WHEN i = 0 AND odd THEN 'N' ELSE substr('ACGT', CAST((p + d + i - 1) % 4 + 1 AS INTEGER), 1) END FROM t) "
    "SELECT chrom, pos, count(*) FILTER (WHERE q > 12) AS depth, count(*) FILTER (WHERE q > 12 AND s = 'A') AS \"A\", count(*) FILTER (WHERE q > 12 AND s = 'C') AS \"C\", "
    "count(*) FILTER (WHERE q > 12 AND s = 'G') AS \"G\", count(*) FILTER (WHERE q > 12 AND s = 'T') AS \"T\", count(*) FILTER (WHERE q > 12 AND s = 'N') AS \"N\", "
    "count(*) FILTER (WHERE q > 12 AND NOT rev) AS fwd, count(*) FILTER (WHERE q > 12 AND rev) AS rev, round(avg(q) FILTER (WHERE q > 12), 7) AS mean_qual FROM b GROUP BY 1, 2",
)
def piled_mates(spark, sf):
    return shares(reads.pileup(_mates(spark, sf)).drop("del_placeholder", "ins", "del"), "mean_qual")


@query(
    "A11_pileup_mates_counted_twice",
    "WITH l AS (SELECT l_returnflag AS chrom, l_orderkey + 1 AS p, l_linenumber % 6 AS d FROM lineitem), t AS (SELECT chrom, p, d, unnest(range(10)) AS i FROM l) "
    "SELECT chrom, pos, count(*) AS depth FROM (SELECT chrom, p + i AS pos FROM t UNION ALL SELECT chrom, p + d + i FROM t) b GROUP BY 1, 2",
)
def piled_mates_twice(spark, sf):
    return reads.pileup(_mates(spark, sf), mates_once=False).select("chrom", "pos", "depth")


_DNA = "upper(regexp_replace(text, '[^acgtnACGTN]', '', 'g'))"


@query(
    "A9_seq_stats",
    f"WITH s AS (SELECT {_DNA} AS q FROM documents), l AS (SELECT length(q) AS n FROM s), c AS (SELECT n, sum(n) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, "
    "(SELECT sum(n) FROM l) AS total FROM l) SELECT 'FASTA' AS format, 'DNA' AS type, (SELECT count(*) FROM s) AS num_seqs, (SELECT CAST(sum(n) AS BIGINT) FROM l) AS sum_len, "
    "(SELECT min(n) FROM l) AS min_len, (SELECT round(avg(n), 7) FROM l) AS avg_len, (SELECT max(n) FROM l) AS max_len, (SELECT max(n) FROM c WHERE 2 * run >= total) AS n50, "
    "(SELECT round(100.0::DOUBLE * sum(length(regexp_replace(q, '[^GC]', '', 'g'))) / sum(length(regexp_replace(q, 'N', '', 'g'))), 7) FROM s) AS gc_pct",
)
def sequence_summary(spark, sf):
    df = table(spark, sf, "documents").select(F.upper(F.regexp_replace("text", "[^acgtnACGTN]", "")).alias("seq"))
    return shares(sequences.seq_stats(df).drop("q20_pct", "q30_pct"), "avg_len", "gc_pct")


@query(
    "W2_n50_of_texts",
    "WITH c AS (SELECT n_chars AS n, sum(n_chars) OVER (ORDER BY n_chars DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, (SELECT sum(n_chars) FROM documents) AS total FROM documents) "
    "SELECT max(n) AS n50 FROM c WHERE 2 * run >= total",
)
def texts_n50(spark, sf):
    return sequences.n50(table(spark, sf, "documents"), "n_chars")


@query(
    "R_11_sequence_windows",
    f"SELECT doc_id AS window_id, '' || doc_id AS name, doc_id % 50 AS start, least(doc_id % 50 + 200, length(q)) AS \"end\", least(200, length(q) - doc_id % 50) AS length, "
    f"substr(q, doc_id % 50 + 1, 200) AS seq FROM (SELECT doc_id, {_DNA} AS q FROM documents) t WHERE length(q) > doc_id % 50",
)
def windows_of_sequences(spark, sf):
    seqs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.upper(F.regexp_replace("text", "[^acgtnACGTN]", "")).alias("seq"), "doc_id"
    )
    wanted = seqs.select(
        F.col("name").alias("chrom"),
        (F.col("doc_id") % 50).alias("start"),
        (F.col("doc_id") % 50 + 200).alias("end"),
        F.col("doc_id").alias("window_id"),
    )
    blocks = region.sequence_blocks(seqs.select("name", "seq"), 64)
    return region.sequence_windows(blocks, wanted, 64)


@query(
    "A14_alignment_stats",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr('ACGTACGT-AC', 1 + l_partkey % 3, 6) || CASE WHEN l_suppkey % 2 = 0 THEN '-' ELSE 'a' END AS text, "
    "l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS place FROM lineitem), f AS (SELECT l_orderkey, arg_min(text, place) AS ref FROM t GROUP BY 1), "
    "x AS (SELECT t.*, f.ref, (SELECT count(*) FROM range(1, 8) g(i) WHERE substr(text, i::INT, 1) <> '-' AND substr(ref, i::INT, 1) <> '-') AS shared, "
    "(SELECT count(*) FROM range(1, 8) g(i) WHERE substr(text, i::INT, 1) <> '-' AND upper(substr(text, i::INT, 1)) = upper(substr(ref, i::INT, 1))) AS same FROM t JOIN f USING (l_orderkey)) "
    "SELECT l_orderkey, l_linenumber, l_partkey, text, length(replace(text, '-', '')) AS length, 7 - length(replace(text, '-', '')) AS gaps, "
    "floor(1000.0::DOUBLE * same / shared + 0.5) / 10 AS identity FROM x",
)
def aligned(spark, sf):
    start = (F.col("l_partkey") % 3 + 1).cast("int")
    text = F.concat(F.substring(F.lit("ACGTACGT-AC"), start, F.lit(6)), F.when(F.col("l_suppkey") % 2 == 0, "-").otherwise("a"))
    place = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", place.alias("place"), text.alias("text"))
    return sequences.alignment_stats(df, "l_orderkey", "place").drop("place")


_NAMES = "CASE WHEN n_nationkey < 22 THEN 'chr' || (n_nationkey + 1) WHEN n_nationkey = 22 THEN 'chrX' ELSE 'alt' || n_nationkey END"


@query(
    "R6_check_reference",
    "SELECT 'plain' AS \"table\", 'naming' AS problem, NULL AS name, 'plain vs chr' AS detail UNION ALL "
    "SELECT 'plain', 'missing', CASE WHEN n_nationkey >= 23 THEN 'alt' || n_nationkey END, NULL FROM nation WHERE n_nationkey = 24 UNION ALL "
    "SELECT 'plain', 'length', CAST(n_nationkey + 1 AS VARCHAR), (n_nationkey * 1000 + 6) || ' vs ' || (n_nationkey * 1000 + 5) FROM nation WHERE n_nationkey = 7 UNION ALL "
    "SELECT 'plain', 'assembly', NULL, 'GRCh37 / hg19 (Homo sapiens) vs GRCh38 / hg38 (Homo sapiens)' UNION ALL "
    "SELECT 'plain', 'length', '1', '249250621 vs 248956422'",
)
def checked(spark, sf):
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    name = F.when(key < 22, F.concat(F.lit("chr"), (key + 1).cast("string"))).when(key == 22, "chrX").otherwise(F.concat(F.lit("alt"), key.cast("string")))
    sized = n.select(key.alias("k"), name.alias("name"), F.when(key == 0, 248956422).otherwise(key * 1000 + 5).alias("length"))
    ref = sized.where("k <> 24")
    other = sized.select(
        F.regexp_replace("name", "^chr", "").alias("name"),
        F.when(F.col("k") == 0, 249250621).when(F.col("k") == 7, F.col("length") + 1).otherwise(F.col("length")).alias("length"),
    )
    listed = lambda df: compare.sequence_names(df, "name", "length")
    return compare.check_reference(listed(ref), {"plain": listed(other), "same": listed(ref)})


@query(
    "J_c_names_missing",
    "SELECT DISTINCT l_returnflag AS name FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
)
def names_missing(spark, sf):
    lines = compare.sequence_names(table(spark, sf, "lineitem"), "l_returnflag")
    known = lines.where("name IN ('A', 'N')")
    found = compare.check_reference(known, {"t": lines})
    return found.where("problem = 'missing'").select("name")


@query(
    "S32_contigs_with_counts",
    "SELECT coalesce(n.name, c.name) AS name, length, coalesce(records, 0) AS records FROM (VALUES ('A', 100), ('B', 200), ('N', NULL)) n(name, length) "
    "FULL JOIN (SELECT l_returnflag AS name, count(*) AS records FROM lineitem GROUP BY 1) c ON c.name = n.name",
)
def contig_counts(spark, sf):
    header = spark.createDataFrame([("A", 100), ("B", 200), ("N", None)], "name string, length long")
    return compare.contigs(header, table(spark, sf, "lineitem").select("l_returnflag"))


@query(
    "J1_json_paths_flat",
    "SELECT event_id, '.k' AS path, json_extract_string(props, '$.k') AS value FROM events",
)
def flat_paths(spark, sf):
    return json_ops.json_paths(table(spark, sf, "events").select("event_id", "props"), "props")


@query(
    "J1_json_paths_repeated_key",
    "SELECT event_id, '.k' AS path, CAST(user_id AS VARCHAR) AS value FROM events",
)
def repeated_paths(spark, sf):
    user = F.col("user_id").cast("string")
    doc = F.concat(F.lit('{"k":"first","k":'), user, F.lit("}"))
    return json_ops.json_paths(table(spark, sf, "events").select("event_id", doc.alias("doc")), "doc")


def _nested(spark, sf):
    meta = F.struct(F.col("turn"), F.array(F.col("role"), F.lit("x")).alias("odd tags"), F.array().cast("array<int>").alias("none"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.col("conv_id").alias("id"), meta.alias("meta"))).alias("doc")
    )


@query(
    "J1_json_paths_nested",
    "SELECT conv_id, turn, '.[' || conv_id || '].id' AS path, CAST(conv_id AS VARCHAR) AS value FROM conversations UNION ALL "
    "SELECT conv_id, turn, '.[' || conv_id || '].meta.turn', CAST(turn AS VARCHAR) FROM conversations UNION ALL "
    "SELECT conv_id, turn, '.[' || conv_id || '].meta[\"odd tags\"][0]', '\"' || role || '\"' FROM conversations UNION ALL "
    "SELECT conv_id, turn, '.[' || conv_id || '].meta[\"odd tags\"][1]', '\"x\"' FROM conversations UNION ALL "
    "SELECT conv_id, turn, '.[' || conv_id || '].meta.none', '[]' FROM conversations",
)
def nested_paths(spark, sf):
    prefix = F.concat(F.lit(".["), F.col("conv_id").cast("string"), F.lit("]"))
    return json_ops.json_paths(_nested(spark, sf), "doc", prefix)


@query(
    "J2_invalid_json",
    "SELECT event_id FROM events WHERE event_id % 13 = 0",
)
def invalid(spark, sf):
    # some texts lose their end, which is wrong; some repeat a key, which is not
    twice = F.concat(F.lit('{"k":0,'), F.substring(F.col("props"), F.lit(2), F.length("props")))
    key = F.col("event_id")
    props = F.when(key % 13 == 0, F.regexp_replace("props", "[}]$", "")).when(key % 13 == 1, twice).otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_id", props.alias("props"))
    return json_ops.invalid_json(df, "props").select("event_id")


@query(
    "J2_places_of_errors",
    "WITH e AS (SELECT event_id, event_id % 8 AS kind, octet_length(encode(props)) AS n FROM events) "
    "SELECT event_id, CASE kind WHEN 0 THEN n - 1 WHEN 1 THEN 5 WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN n + 4 WHEN 5 THEN 3 ELSE 7 END AS byte, "
    "CASE kind WHEN 4 THEN 3 ELSE 1 END AS line, CASE kind WHEN 0 THEN n WHEN 1 THEN 6 WHEN 2 THEN n + 1 WHEN 3 THEN n + 1 WHEN 4 THEN 1 WHEN 5 THEN 4 ELSE 8 END AS \"column\", "
    "CASE kind WHEN 0 THEN 'the text ends too early' WHEN 1 THEN 'a colon is expected' WHEN 2 THEN 'there is text after the value' WHEN 3 THEN 'a key is expected' "
    "WHEN 4 THEN 'a comma or ] is expected' WHEN 5 THEN 'a string is broken off, or holds what must be escaped' ELSE 'a comma or } is expected' END AS cause FROM e WHERE kind < 7",
)
def error_places(spark, sf):
    """One kind of error for seven of eight texts."""
    kind, text = F.col("event_id") % 8, F.col("props")
    broken = [
        F.regexp_replace(text, "[}]$", ""),
        F.regexp_replace(text, ":", ""),
        F.concat(text, F.lit(",")),
        F.regexp_replace(text, "[}]$", ",}"),
        F.concat(F.lit("[\n"), text, F.lit(" \n"), text, F.lit("]")),
        F.regexp_replace(text, "k", "k\t"),
        F.regexp_replace(text, ": ", ": 0"),
    ]
    props = text
    for i, other in enumerate(broken):
        props = F.when(kind == i, other).otherwise(props)
    return json_ops.json_errors(table(spark, sf, "events").select("event_id", props.alias("props")), "props")


@query(
    "J4_records_at_a_path",
    "SELECT o_orderkey, o_custkey AS id, o_orderstatus AS name FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, NULL FROM orders",
)
def records(spark, sf):
    first = F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name"))
    second = F.struct((F.col("o_custkey") + 1).alias("id"), F.lit(None).cast("string").alias("name"))
    doc = F.struct(F.struct(F.array(first, second).alias("cells")).alias("body"))
    df = table(spark, sf, "orders").select("o_orderkey", F.to_json(doc).alias("doc"))
    return json_ops.records_at(df, "doc", ".body.cells", "id long, name string")


@query(
    "J3_nested_records",
    "SELECT conv_id AS id, turn, role FROM conversations",
)
def nested_records(spark, sf):
    path = base.written_text(_nested(spark, sf).select("doc"), "nested")
    df = spark.read.json(path)
    return df.select("id", F.col("meta.turn").alias("turn"), F.col("meta.`odd tags`")[0].alias("role"))


