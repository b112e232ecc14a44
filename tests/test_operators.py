import random
import re

import pytest
from pyspark.sql import functions as F

from gridspan.operators import compare, filter as f, intervals, json_ops, order, reads, region, reshape, select
from gridspan.operators import sequences, signal, summary, variants
from gridspan.sinks import files as sinks
from gridspan.sources import delimited
from tests.conftest import rows
from tests.oracle import plan


@pytest.fixture(scope="module")
def traps(spark):
    return spark.createDataFrame(
        [(1, 0.05, float("nan"), "a", True, 7, "2024-01-01"), (2, 0.1, 1.0, "2", False, 4, "2024-06-15"), (None, None, None, None, None, None, None)],
        "i int, f float, d double, s string, b boolean, flag int, day string",
    ).withColumn("day", F.col("day").cast("date"))


@pytest.mark.parametrize(
    ("atom", "want"),
    [
        (("f", "==", 0.05), [1]), (("d", "==", float("nan")), []), (("d", ">=", 0), [2]), (("d", "!=", 1), [1]), (("s", "==", 2), [2]),
        (("s", "!=", 2), [1]), (("i", "==", "2"), [2]), (("i", "in", ["1", 5]), [1]), (("i", "not in", [1]), [2]), (("i", "is null"), [None]),
        (("b", "==", True), [1]), (("b", "!=", True), [2]), (("flag", "has", "PAIRED,UNMAP"), [1]), (("flag", "lacks", "0x1"), [2]),
        (("day", ">=", "2024-06-15"), [2]), (("day", "<", "2024-06-15 00:00:01"), [1, 2]), (("s", "~", "^[a-z]$"), [1]), (("i", "~", "1"), []),
        (("s", ">", "1"), [1, 2]), (("s", "contains", "a"), [1]), (("d", "in", [1]), [2]),
    ],
)
def test_atoms(traps, atom, want):
    assert [r["i"] for r in traps.where(f.where(traps, *atom)).collect()] == want


@pytest.mark.parametrize(
    ("atom", "message"),
    [
        (("nope", "==", 1), "no column"), (("dd", "==", 1), "did you mean 'd'"), (("s", "~", "("), "bad regular"), (("i", "==", "x"), "not a number"),
        (("s", "<", 3), "quoted"), (("b", "<", True), "boolean"), (("flag", "has", "WRONG"), "unknown flag"), (("day", "==", "soon"), "not a date"),
    ],
)
def test_bad_atoms(traps, atom, message):
    with pytest.raises(ValueError, match=message):
        f.where(traps, *atom)


def test_narrow(traps):
    keep = traps.where(f.narrow(traps, "i", [1, None])).count()
    drop = traps.where(f.narrow(traps, "i", [1, None], keep=False)).collect()
    assert keep == 2 and [r["i"] for r in drop] == [2]


def test_search_literal_when_pattern_is_invalid(spark):
    df = spark.createDataFrame([("a(b", 1), ("ab", 2)], "t string, n int")
    assert rows(f.search(df, "A(")) == [("a(b", 1, ["t"])]


def test_member_file(spark, lines):
    listed = f.member_file(spark, lines("ids.txt", "1\tx\n\n3\n"))
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "i int")
    assert sorted(rows(f.members_of(df, "i", listed))) == [(1,), (3,)]
    assert rows(f.members_of(df, "i", listed, keep=False)) == [(2,)]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("c,a", ["c", "a"]), ("2-3", ["b", "c"]), ("3-", ["c", "a_pct", "log2-ratio"]), ("*,!*_pct", ["a", "b", "c", "log2-ratio"]),
        ("log2-ratio", ["log2-ratio"]), ("@numeric", ["a", "a_pct"]), ("!@string", ["a", "c", "a_pct", "log2-ratio"]), ("?,a", ["a", "b", "c"]),
    ],
)
def test_select(spark, spec, want):
    df = spark.createDataFrame([(1, "x", True, 0.5, [1])], "a int, b string, c boolean, a_pct double, `log2-ratio` array<int>")
    assert select.resolve_columns(df, spec) == want


@pytest.mark.parametrize(("spec", "message"), [("x*", "matches no column"), ("*,!*", "leaves no column"), ("a_pc", "did you mean 'a_pct'"), ("@odd", "unknown class")])
def test_select_errors(spark, spec, message):
    df = spark.createDataFrame([(1, 0.5)], "a int, a_pct double")
    with pytest.raises(ValueError, match=message):
        select.resolve_columns(df, spec)


def test_ranges_are_off_when_a_column_looks_like_one(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`2-4` int, b int, c int")
    assert select.resolve_columns(df, "2-4") == ["2-4"]
    with pytest.raises(ValueError, match="no column '1-2'"):
        select.resolve_columns(df, "1-2")


INTERVALS = [("chr1", 100, 200, 0.5), ("chr1", 500, 800, 0.7), ("chr1", 1000, 1200, 0.2), ("chr2", 200, 400, 0.9), ("chr2", 1500, 1800, 0.1)]


@pytest.fixture(scope="module")
def peaks(spark):
    return spark.createDataFrame(INTERVALS, "Chromosome string, Start int, End int, Score double")


def test_describe_known_values(peaks):
    got = {r["column"]: r for r in summary.describe(peaks).collect()}
    start = got["Start"]
    assert (start["count"], start["min"], start["max"], start["mean"]) == (5, "100", "1500", 660.0)
    assert (start["p25"], start["p50"], start["p75"]) == (200.0, 500.0, 1000.0)
    assert start["std"] == pytest.approx(585.662, abs=1e-3) and got["Chromosome"]["distinct"] == 2
    big = {r["column"]: r for r in summary.describe(peaks, in_buffer=0).collect()}
    assert big["Start"] == start


def test_describe_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = summary.describe(df).first()
    assert (row["count"], row["nulls"], row["min"], row["max"], row["p50"]) == (3, 1, "1", "3", 2.0)
    assert row["mean"] != row["mean"]


def test_distinct_cap(spark):
    df = spark.range(100).select((F.col("id") % 17).cast("string").alias("s"), (F.col("id") % 16).cast("string").alias("t"))
    assert [r["distinct"] for r in summary.describe(df, distinct_cap=16).collect()] == [None, 16]
    assert [r["distinct"] for r in summary.describe(df).collect()] == [17, 16]


def test_value_counts_order(peaks, spark):
    assert rows(summary.value_counts(peaks, "Chromosome")) == [("chr1", 3, 0.6), ("chr2", 2, 0.4)]
    df = spark.createDataFrame([(10,), (9,), (None,)], "n int")
    assert [r[0] for r in rows(summary.value_counts(df, "n"))] == [9, 10, None]
    assert [r[1] for r in rows(summary.value_counts_of(df, ["n"]))] == ["9", "10", None]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert rows(summary.histogram(df, "v")) == [(0, 2.0, 2.0, 2)]
    assert summary.histogram(df.where("v > 5 and not isnan(v)"), "v").count() == 0


def test_distinct_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "b", [1]), (1, "a", [1]), (2, "b", [1]), (4, None, None), (5, None, None)], "p int, s string, l array<int>")
    assert rows(order.distinct(df, ["s", "l"], F.col("p"))) == [("a", [1]), ("b", [1]), (None, None)]


def test_distinct_maps(spark):
    df = spark.sql("select map('a', 1) m, 1 p union all select map('a', 1), 2 union all select map('a', 2), 3")
    assert rows(order.distinct(df, ["m"], F.col("p"))) == [({"a": 1},), ({"a": 2},)]


def test_sort_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, 4), (1.0, 5)], "v double, p int")
    assert [r["p"] for r in order.sort(df, ["v"], ["p"]).collect()] == [1, 5, 4, 2, 3]
    assert [r["p"] for r in order.sort(df, ["v:desc"], ["p"]).collect()] == [4, 1, 5, 2, 3]
    assert [r["p"] for r in order.tail(df, 2, F.col("p")).collect()] == [4, 5]


def test_regions(peaks):
    count = lambda text, **k: region.overlap_filter(peaks, region.parse_regions(text, **k)).count()
    assert count("chr1:78-99") == 0 and count("chr1:199-200") == 1 and count("chr1:200-500") == 0
    assert count("chr1:101-200", coords="NCBI") == 1 and count("chr1:") == 3 and count("chr2:-201") == 1
    assert count("chr1:500-,chr2:0-1000") == 3 and count("chr1:150") == 1
    with pytest.raises(ValueError, match="cannot read"):
        region.parse_regions("chr1:5x")
    assert region.slop([("c", 5, None), ("c", None, 9)], 10) == [("c", 0, None), ("c", None, 19)]


def test_a_row_in_two_windows(peaks, spark):
    wins = region.windows_frame(spark, [("chr1", 0, 600), ("chr1", 700, 900)])
    assert region.overlap_join(peaks, wins).count() == 3 and region.overlap_join(peaks, wins, "any").count() == 2


def test_validate(peaks):
    good = intervals.running_max_end(peaks).withColumn("_row", F.monotonically_increasing_id())
    good = good.coalesce(1).orderBy("Chromosome", "Start").drop("_row").withColumn("_row", F.monotonically_increasing_id())
    assert {r["status"] for r in intervals.validate_intervals(good, "_row").collect()} == {"PASS"}
    bad = good.withColumn("Start", F.when(F.col("_row") == 2, 0).otherwise(F.col("Start")))
    bad = bad.withColumn("Chromosome", F.when(F.col("_row") == 4, "chr1").otherwise(F.col("Chromosome")))
    failed = [r["check"] for r in intervals.validate_intervals(bad, "_row").collect() if r["status"] == "FAIL"]
    assert failed == ["each chromosome is one block", "rows are sorted by (Start, End)", "MaxEndSoFar is the running maximum of End"] or failed[:2] == [
        "each chromosome is one block", "rows are sorted by (Start, End)",
    ]
    nulls = good.withColumn("End", F.when(F.col("_row") != 1, F.col("End")))
    report = {r["check"]: r["status"] for r in intervals.validate_intervals(nulls, "_row").collect()}
    assert report["no null coordinates"] == "FAIL" and report["each chromosome is one block"] == "PASS"


def test_validation_reads_the_table_three_times(spark):
    """Once for the extents and twice for one scan, whatever is wrong; examples come from the bad rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(i):
        read.add(1)
        return ("c", 5 if i == 700 else i, i + 2, i + (3 if i % 100 == 0 else 2), i)

    data = spark.sparkContext.parallelize(range(1000), 4).map(counted)
    df = spark.createDataFrame(data, "chrom string, start long, end long, MaxEndSoFar long, _row long")
    report = {r["check"]: (r["violations"], r["examples"]) for r in intervals.validate_intervals(df, "_row").collect()}
    assert report["rows are sorted by (start, end)"] == (1, "row 700 c:5-702")
    wrong = "; ".join(f"row {i}: {i + 3} is not {i + 2}" for i in range(0, 500, 100))
    assert report["MaxEndSoFar is the running maximum of end"] == (10, wrong)
    assert report["each chromosome is one block"] == report["no null coordinates"] == (0, None)
    assert 0 < read.value <= 3000


def test_blocks_are_checked_in_one_more_reading(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(i):
        read.add(1)
        return ("b" if i % 100 == 0 else "a", i, i + 2, i + 2, i)

    data = spark.sparkContext.parallelize(range(1000), 4).map(counted)
    df = spark.createDataFrame(data, "chrom string, start long, end long, MaxEndSoFar long, _row long")
    blocks = spark.createDataFrame([("a", 0, 1000)], "chrom string, row_offset long, n_rows long")
    report = {r["check"]: (r["violations"], r["examples"]) for r in intervals.validate_intervals(df, "_row", blocks=blocks).collect()}
    assert report["the blocks hold every row once"] == (0, None)
    assert report["every row has the chromosome of its block"] == (10, "; ".join(f"row {i}: b" for i in range(0, 500, 100)))
    assert 0 < read.value <= 4000


def test_bins(spark):
    sig = spark.createDataFrame([("c", 0, 5, 1.0), ("c", 7, 10, 3.0)], "chrom string, start long, end long, value double")
    wins = region.windows_frame(spark, [("c", 0, 10), ("c", 20, 22)])
    got = sorted(rows(signal.binned_signal(sig, wins, 3).drop("chrom")))
    assert got == [
        (0, 0, 3, 0, 1.0, 1.0, 1.0, 1.0), (0, 3, 6, 1, 1.0, 1.0, 1.0, 2 / 3), (0, 6, 10, 2, 3.0, 3.0, 3.0, 0.75),
        (1, 20, 21, 0, None, None, None, 0.0), (1, 21, 22, 1, None, None, None, 0.0),
    ]


@pytest.mark.parametrize(
    ("bases", "quals", "ref", "want"),
    [
        (".,", "II", "A", (2, 0, 0, 0, 0, 0, 0, 0, 1, 1, 40.0)),
        ("^I.$+2ACtT*", "I5?!", "c", (0, 1, 0, 2, 0, 1, 1, 0, 2, 1, 30.0)),
        ("^+.-1G,>n", "?AB#", "g", (0, 0, 2, 0, 1, 0, 0, 1, 1, 2, (30 + 32 + 2) / 3)),
        ("", "", "N", (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None)),
        ("AC", "I", "T", (1, 1, 0, 0, 0, 0, 0, 0, 2, 0, 40.0)),
    ],
)
def test_decode_pileup(spark, bases, quals, ref, want):
    df = spark.createDataFrame([(ref, bases, quals)], "ref string, bases string, quals string")
    got = rows(reads.decode_pileup(df).drop("ref", "bases", "quals"))[0]
    assert got[:-1] == want[:-1] and (got[-1] == pytest.approx(want[-1]) if want[-1] is not None else got[-1] is None)


def test_pileup_filters(spark):
    sam = spark.createDataFrame(
        [("a", 0, "c", 10, 60, "2S2M1I1M", "NNACGT", "IIII#I"), ("b", 1, "c", 10, 60, "3M", "AAA", "III"), ("c", 4, "c", 10, 60, "3M", "AAA", "III"),
         ("d", 16, "c", 11, 5, "1M1D1M", "CT", "II")],
        "QNAME string, FLAG int, RNAME string, POS int, MAPQ int, CIGAR string, SEQ string, QUAL string",
    )
    depth = lambda **k: {r["pos"]: r["depth"] for r in reads.pileup(sam, **k).collect()}
    assert depth() == {10: 1, 11: 2, 12: 2, 13: 1}
    assert depth(count_orphans=True) == {10: 2, 11: 3, 12: 3, 13: 1}
    assert depth(min_mapq=6) == {10: 1, 11: 1, 12: 1}
    row = reads.pileup(sam).where("pos = 11").first()
    assert (row["C"], row["ins"], row["del"], row["rev"]) == (2, 1, 1, 1)


def test_pileup_text(spark):
    sam = spark.createDataFrame(
        [("a", 0, "c", 10, 60, "1S2M1I2N1M", "NACGT", "IIII5"), ("b", 16, "c", 10, 99, "2M1D1M", "ACG", "*")],
        "QNAME string, FLAG int, RNAME string, POS int, MAPQ int, CIGAR string, SEQ string, QUAL string",
    )
    got = {r["pos"]: (r["depth"], r["bases"], r["quals"]) for r in reads.pileup_text(sam).collect()}
    assert got == {
        10: (2, "^]A^~a", "I!"), 11: (2, "C+1Gc-1n", "I!"), 12: (2, ">*", "5!"), 13: (2, ">g$", "5!"), 14: (1, "T$", "5"),
    }
    parts = reads.pileup_text(sam, share=1).where("pos = 10").collect()
    assert sum(r["depth"] for r in parts) == 2
    assert {r["pos"]: r["depth"] for r in reads.pileup(sam, min_baseq=30).collect()} == {10: 2, 11: 2, 12: 1, 13: 1, 14: 0}


MATES = "QNAME string, FLAG int, RNAME string, POS int, MAPQ int, CIGAR string, RNEXT string, SEQ string, QUAL string"


def _walk(cigar, pos, seq, qual):
    """{position: (letter, score)} of the bases of a read."""
    out, q = {}, 0
    for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if k in "M=X":
                out[pos] = (seq[q], ord(qual[q]) - 33)
            pos += k in "MDN=X"
            q += k in "MIS=X"
    return out


def brute_mates(sam):
    """Depth per position at a score of 13, mates counted once."""
    walks = [_walk(r[5], r[3], r[7], r[8]) for r in sam]
    scores = [{p: q for p, (_, q) in w.items()} for w in walks]
    for i, a in enumerate(sam):
        for j, b in enumerate(sam):
            names = [r for r in sam if r[0] == a[0]]
            if i == j or a[0] != b[0] or len(names) != 2 or not (a[1] & 3 == b[1] & 3 == 3 and a[1] & 64 and b[1] & 128) or a[6] != "=":
                continue
            first = (a[3], 1) < (b[3], 2)
            for p in walks[i].keys() & walks[j].keys():
                (x, m), (y, n) = walks[i][p], walks[j][p]
                if x == y:
                    scores[i][p], scores[j][p] = (min(m + n, 200), 0) if first else (0, min(m + n, 200))
                elif m > n or (m == n and first):
                    scores[i][p], scores[j][p] = m * 4 // 5, 0
                else:
                    scores[i][p], scores[j][p] = 0, n * 4 // 5
    depth: dict = {}
    for s in scores:
        for p, q in s.items():
            depth[p] = depth.get(p, 0) + (q >= 13)
    return depth


def test_overlapping_mates_count_once(spark):
    rng = random.Random(4)
    sam = []
    for i in range(40):
        for which in (64, 128):
            cigar = rng.choice(["12M", "3S9M", "5M2I5M", "4M3D8M", "4M20N8M", "6=1X5=", "2H12M"])
            sam.append((f"r{i}", 3 | which, "c", 10 + rng.randrange(12), 60, cigar, "=", "".join(rng.choice("AC") for _ in range(12)), "".join(chr(33 + rng.randrange(5, 60)) for _ in range(12))))
    # a name of three reads, a pair on two chromosomes, one that is not proper, one that only touches
    sam += [("three", 3 | w, "c", 12, 60, "12M", "=", "A" * 12, "I" * 12) for w in (64, 128, 128)]
    sam += [("apart", 3 | w, "c", 12, 60, "12M", "d", "A" * 12, "I" * 12) for w in (64, 128)]
    sam += [("touch", 3 | 64, "c", 10, 60, "5M", "=", "AAAAA", "IIIII"), ("touch", 3 | 128, "c", 15, 60, "5M", "=", "AAAAA", "IIIII")]
    df = spark.createDataFrame(sam, MATES).repartition(3)
    bases = lambda **options: {r["pos"]: r["fwd"] + r["rev"] for r in reads.pileup(df, **options).collect()}
    got = bases()
    want = brute_mates(sam)
    assert {p: got.get(p, 0) for p in want} == want
    twice = bases(mates_once=False, min_baseq=0)
    assert all(twice[p] >= n for p, n in want.items()) and sum(twice.values()) > sum(want.values())


def test_pileup_deals_reads_by_place(spark, monkeypatch):
    """Reads that lie scattered are brought together before they become bases; text needs no shuffle of bases at all."""
    rng = random.Random(5)
    sam = [(f"r{i}", 16 * (i % 2), "c", 1 + rng.randrange(60), 60, rng.choice(["9M", "3M2D4M2S", "2M30N7M", "4M2I3M"]), "*", "ACGTACGTA", "IIIII5555") for i in range(60)]
    sam += [(f"m{i}", 3 | w, "c", 20 + i + w // 64, 60, "9M", "=", "ACGTACGTA", "IIIII5555") for i in range(20) for w in (64, 128)]
    sam += [("often", 3 | w, "c", 12, 60, "9M", "=", "ACGTACGTA", "IIIII5555") for w in (64, 64, 128)]
    df = spark.createDataFrame(sam, MATES).repartition(5)
    counts, text = reads.pileup(df), reads.pileup_text(df)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(counts)
    bases_dealt = [x for x in plan(text).splitlines() if "Exchange" in x and "pos" in x]
    assert not bases_dealt
    want, written = sorted(rows(counts)), sorted(rows(text))
    monkeypatch.setattr(reads, "_BIN_BITS", 2)
    assert sorted(rows(reads.pileup(df))) == want and sorted(rows(reads.pileup_text(df))) == written
    # bins beyond the share, none of whose positions is
    deepest = max(r[4] for r in written)
    assert sorted(rows(reads.pileup_text(df, share=deepest))) == written


def test_mates_show_one_base_with_both_scores(spark):
    sam = [("a", 99, "c", 10, 60, "3M", "=", "ACG", "II5"), ("a", 147, "c", 11, 60, "3M", "=", "CTT", "55I")]
    df = spark.createDataFrame(sam, MATES)
    got = {r["pos"]: (r["depth"], r["bases"], r["quals"]) for r in reads.pileup_text(df).collect()}
    assert got == {10: (1, "^]A", "I"), 11: (1, "C", chr(33 + 60)), 12: (1, "G$", chr(33 + 16)), 13: (1, "t$", "I")}


def test_sequence_types(spark):
    kind = lambda *s: sequences.seq_stats(spark.createDataFrame([(x,) for x in s], "seq string")).first()
    assert kind("ACGTN", "acg")["type"] == "DNA" and kind("ACGU")["type"] == "RNA"
    protein = kind("MKVLAAGI")
    assert protein["type"] == "Protein" and protein["gc_pct"] is None
    assert kind("A" * 10, "C" * 4, "G" * 3)["n50"] == 10 and kind("AAAA", "CC", "GG")["n50"] == 4


def test_quality_shares(spark):
    df = spark.createDataFrame([("ACGT", "I5?!")], "seq string, qual string")
    row = sequences.seq_stats(df, qual="qual").first()
    assert (row["format"], row["q20_pct"], row["q30_pct"]) == ("FASTQ", 75.0, 50.0)


def test_alphabet(spark):
    df = spark.createDataFrame([("AC-GT",), ("A.N~",)], "text string")
    assert sequences.alphabet(df).first()[0] == "nucleotide"


def test_json_paths(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"odd \\"key":"x","e":{},"n":[]}'), (2, "[[true]]"), (3, "5"), (4, "{bad")], "id int, j string")
    got = {(r["id"], r["path"]): r["value"] for r in json_ops.json_paths(df, "j").collect()}
    assert got == {
        (1, ".a[0]"): "1", (1, ".a[1].b"): "null", (1, '.["odd \\"key"]'): '"x"', (1, ".e"): "{}", (1, ".n"): "[]", (2, ".[0][0]"): "true", (3, "."): "5", (4, None): None,
    }
    twice = spark.createDataFrame([('{"a":1,"a":2}',), (None,)], "j string")
    assert [tuple(r) for r in json_ops.json_paths(twice, "j").collect()] == [(".a", "2")]
    assert [r["id"] for r in json_ops.invalid_json(df, "j").collect()] == [4]


def test_json_validity(spark):
    good = ['{"a":1,"a":2}', ' [1, -0.5e+3, "x\\u00e9\\n", true, null] ', '""', "0", "{}", "[[],[{}]]", '["' + "y" * 100_000 + '"]', '{"s v":{"t":[1 ,2 ]}}']
    bad = ["", " ", "01", "1 2", "[1 2]", "[1,]", "{a:1}", "{'a':1}", '{"a"}', "tru", "[true false]", '"\\x"', '"a\nb"', "[1", "]1[", "{}{}", "1.", "- 1", "[1,2", "\u0002", "NaN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "id int, j string")
    got = sorted(r["id"] for r in json_ops.invalid_json(df, "j").collect())
    assert got == list(range(len(good), len(good) + len(bad)))


def test_expand_discovers_every_key(spark):
    df = spark.createDataFrame([(i, f"k{i}=1;same=2") for i in range(30)], "p int, INFO string")
    assert reshape.packed_keys(df, "INFO", F.col("p"))[:3] == ["k0", "same", "k1"]
    with pytest.raises(ValueError, match="more than 10 keys"):
        reshape.packed_keys(df, "INFO", max_keys=10)
    clash = reshape.expand(df.withColumn("same", F.lit(1)), "INFO", keys=["same"])
    assert clash.columns[-1] == "same_INFO"
    with pytest.raises(ValueError, match="key=value"):
        reshape.expand(spark.createDataFrame([("x",)], "t string"), "t")


def test_gt_stats_name_clash(spark):
    df = spark.createDataFrame([("GT", "0/1", "1/1", 5)], "FORMAT string, S1 string, S2 string, AC int")
    out = variants.gt_stats(df, ["S1", "S2"])
    assert out.first()["AC"] == 5 and out.first()["AC_gt"] == 3
    with pytest.raises(ValueError, match="no sample"):
        variants.sample_columns(df.select("FORMAT"))


def test_diff_needs_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        compare.diff_cells(df, df, ["k"])


def test_fingerprint_depends_on_values_only(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.5)], "i int, s string, f double")
    b = a.withColumn("i", F.col("i").cast("long")).repartition(4).orderBy(F.desc("i"))
    print_ = lambda df, **k: compare.fingerprint(df, **k).first()["fingerprint"]
    assert print_(a) == print_(b)
    assert print_(a) != print_(a.withColumn("s", F.coalesce("s", F.lit(""))))
    assert print_(a) != print_(a.union(a.limit(1)))
    assert print_(a, position=F.col("i")) != print_(a, position=3 - F.col("i"))


def test_csv_and_parquet_have_one_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,\"y", 0.1), (2, None, 2.0), (3, "z", None)], "i long, s string, f double")
    sinks.write_delimited(df, str(tmp_path / "c"), sep=",")
    sinks.write_parquet(df, str(tmp_path / "p"))
    csv = delimited.read_delimited(spark, str(tmp_path / "c")).table
    assert rows(compare.fingerprint(csv)) == rows(compare.fingerprint(spark.read.parquet(str(tmp_path / "p"))))


def test_sinks_refuse_their_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="is an input"):
        sinks.write_parquet(spark.read.parquet(path), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 3


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="no"):
        sinks.write_parquet(bad, path)
    assert not [p for p in (tmp_path / "t").glob("part-*")] if (tmp_path / "t").exists() else True


def test_changed_rows_do_not_verify(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_parquet(spark.range(5), path, provenance={"source": "r"}, with_fingerprint=True)
    assert sinks.verify_fingerprint(spark, path)
    assert "provenance" in spark.read.parquet(path).schema["id"].metadata
    spark.range(1).write.mode("append").parquet(path)
    assert not sinks.verify_fingerprint(spark, path)


def test_markdown(spark):
    df = spark.createDataFrame([(1000, "a|b\nc", None)], "n int, t string, e string")
    assert rows(sinks.markdown_rows(df)) == [("| 1_000 | a\\|b<br>c |  |",)]
    assert sinks.markdown_header(df) == ["| n | t | e |", "| --- | --- | --- |"]


def test_java_patterns(spark):
    df = spark.createDataFrame([("éa",), ("12",)], "t string")
    assert rows(f.keep_rows(df, ("t", "~", r"^\p{L}+$"))) == [("éa",)]
    assert [r["t"] for r in f.search(df, r"\p{Nd}{2}").collect()] == ["12"]
    assert f.search(df, "(").count() == 0
    with pytest.raises(ValueError):
        f.keep_rows(df, ("t", "~", "("))


def test_many_packed_keys(spark):
    df = spark.createDataFrame([(";".join(f"k{i}={i}" for i in range(j, j + 200)),) for j in (0, 150)], "INFO string")
    assert len(reshape.packed_keys(df, "INFO")) == 350


def test_matrix_grid(spark):
    df = spark.createDataFrame([(i, float(i), float("inf") if i else 1.0) for i in range(4)], "p long, a double, b double")
    got = {(r["band"], r["column"]): r["value"] for r in summary.matrix_grid(df, F.col("p"), 4, ["a", "b"], 2).collect()}
    assert got == {(0, "a"): pytest.approx(0.5 / 3), (1, "a"): pytest.approx(2.5 / 3), (0, "b"): pytest.approx(1 / 3)}


def viable(text: str) -> int | None:
    """The least byte with which a text can no longer become JSON, by a walk over characters; None for a valid text."""
    import json

    data = text.encode()

    def valid(t):
        try:
            json.loads(t, parse_constant=lambda _: 1 / 0)
            return not re.search("^\\s*$|[\\x0b\\x0c]", t) and t.strip(" \t\n\r") == t.strip()
        except (ValueError, ZeroDivisionError, RecursionError):
            return False

    if valid(text):
        return None
    # a prefix is viable if one of a few continuations makes it valid
    ends = ["", '"', "0", "1", "true", "rue", "ue", "e", "alse", "lse", "se", "ull", "ll", "l", '":1', '"k":1', ":1", ',"k":1', "n\"", '0000"', '000"', '00"', '0"', 'n":1', '0000":1', '000":1', '00":1', '0":1', "-1", "1}", "0}"]
    longest = 0
    for i in range(len(text) + 1):
        head, stack, inside, escaped = text[:i], [], False, False
        for c in head:
            if inside:
                escaped, inside = (not escaped and c == "\\"), not (c == '"' and not escaped)
            elif c == '"':
                inside, escaped = True, False
            elif c in "[{":
                stack.append("]" if c == "[" else "}")
            elif c in "]}" and stack:
                stack.pop()
        close = "".join(reversed(stack))
        if any(valid(head + e + close) for e in ends):
            longest = len(head.encode())
    return min(longest, len(data))


ERRORS = [
    ("", 0), ("{", 1), ("[1,", 3), ("[1 2]", 3), ('{"a" 1}', 5), ('{"a":1,}', 7), ("{a:1}", 1), ('{"a":tru }', 8), ("[01]", 2), ("[1.]", 3), ("[1e+]", 4), ("[-]", 2),
    ('["a\tb"]', 3), ('["\\x"]', 3), ('["\\u12g4"]', 6), ('["abc', 5), ("nul", 3), ("nulx", 3), ("true false", 5), ('{"é":}', 6), ("[1]]", 3), ("[\n1,\n\n?]", 6), (",", 0), ("]", 0),
    ('{"a":[{"b":[1,2}]}', 15), ("[1,]", 3), ('{"a"', 4), ('{"a":', 5), ("\u00a01", 0), ("[\"\\", 3), ("-", 1), ("1.5e", 4), ("\x0b1", 0), ('{"a":1 "b":2}', 7), ("{}{}", 2),
]


def test_places_of_json_errors(spark):
    valid = ["1", " [1, {\"a\": [true, null, -0.5e+3, \"\\u00e9\\n\"]}] ", '"x"', "{}", "[]", '{"a":1,"a":2}']
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ERRORS)] + [(100 + i, t) for i, t in enumerate(valid)] + [(200, None)], "i long, t string")
    got = {r["i"]: r for r in json_ops.json_errors(df, "t").collect()}
    assert sorted(got) == list(range(len(ERRORS)))
    for i, (text, byte) in enumerate(ERRORS):
        before = text.encode()[:byte]
        assert (got[i]["byte"], got[i]["line"], got[i]["column"]) == (byte, before.count(b"\n") + 1, len(before) - before.rfind(b"\n")), (text, got[i])
    assert got[ERRORS.index(("[1,", 3))]["cause"] == "the text ends too early"
    assert got[ERRORS.index(("[1 2]", 3))]["cause"] == "a comma or ] is expected"


def test_places_of_json_errors_against_a_walk(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(150):
        text = list(rng.choice(['{"a":[1,{"b":"c\\n"}],"d":-1.5e3}', "[true,false,null,0]", '["x","\\u00e9",[[]],{}]', '{"k":{"k":{"k":[]}}}']))
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "x", ",", '"', "}", "]", "1", " ", "\n", "\\", "[", ":"])
        texts.append("".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["byte"] for r in json_ops.json_errors(df, "t").collect()}
    for i, text in enumerate(texts):
        assert got.get(i) == viable(text), (text, got.get(i), viable(text))


def test_tree_nodes_are_few_and_hold_the_bins(spark):
    ranges = [(0, 0), (0, 1), (1, 2), (3, 11), (1, 15), (0, 16), (5, 5), (7, 6), (1, 999_999), (2, 1_000_000)]
    df = spark.createDataFrame(ranges, "a long, b long")
    for r in df.select("a", "b", signal.tree_nodes(F.col("a"), F.col("b"), 20).alias("nodes")).collect():
        held = [(n["at"] << n["level"], (n["at"] + 1) << n["level"]) for n in r["nodes"]]
        at = r["a"]
        for low, high in sorted(held):
            assert low == at
            at = high
        assert at == max(r["a"], r["b"]) and len(held) < 48


def test_binned_signal_of_wide_intervals_against_brute_force(spark):
    rng = random.Random(6)
    sig = [("c", a, a + rng.randrange(1, 900), round(rng.random(), 3)) for a in (rng.randrange(0, 900) for _ in range(40))]
    df = spark.createDataFrame(sig, "chrom string, start long, end long, value double")
    wins = spark.createDataFrame([("c", 3, 1000, 1), ("c", 500, 507, 2), ("d", 0, 10, 3)], "chrom string, start long, end long, window_id long")
    got = {(r["window_id"], r["bin"]): r for r in signal.binned_signal(df, wins, 37).collect()}
    for w, start, end, n in ((1, 3, 1000, 37), (2, 500, 507, 7), (3, 0, 10, 10)):
        for i in range(n):
            low, high = start + (end - start) * i // n, start + (end - start) * (i + 1) // n
            met = [(v, min(b, high) - max(a, low)) for c, a, b, v in sig if w != 3 and a < high and b > low]
            r = got.pop((w, i))
            assert (r["start"], r["end"]) == (low, high)
            if met:
                assert r["mean"] == pytest.approx(sum(v * k for v, k in met) / sum(k for _, k in met))
                assert (r["min"], r["max"]) == (min(v for v, _ in met), max(v for v, _ in met))
                assert r["coverage"] == pytest.approx(sum(k for _, k in met) / (high - low))
            else:
                assert (r["mean"], r["coverage"]) == (None, 0)
    assert not got


def test_diff_by_digests_reads_only_unlike_blocks(spark, monkeypatch):
    monkeypatch.setattr(compare, "DIGEST_ROWS", 100)
    monkeypatch.setattr(compare, "DIGEST_FAN_BITS", 2)
    a = spark.range(5000).select(F.col("id").alias("_row"), (F.col("id") % 7).alias("x"), F.col("id").cast("string").alias("t")).repartition(4)
    changed = F.when(F.col("_row") == 1234, None).otherwise(F.col("x"))
    b = a.withColumn("x", changed).withColumn("t", F.when(F.col("_row") == 1299, "?").otherwise(F.col("t"))).repartition(3)
    tree = compare.digest_tree(a, ["_row"], dense=True)
    assert {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()} == {0: 50, 1: 13, 2: 4, 3: 1}
    assert compare.unlike_blocks(tree, compare.digest_tree(a.repartition(2), ["_row"], dense=True)).count() == 0
    assert rows(compare.unlike_blocks(tree, compare.digest_tree(b, ["_row"], dense=True))) == [(12,)]
    got = compare.diff_cells_by_digest(a, b, ["_row"], dense=True)
    assert sorted(rows(got)) == sorted(rows(compare.diff_cells(a, b, ["_row"]))) == [(1234, "x", "2", None), (1299, "t", "1299", "?")]
    # a table that goes on, and one without rows
    more = a.unionByName(spark.range(5000, 30000).select(F.col("id").alias("_row"), F.lit(0).cast("long").alias("x"), F.lit("n").alias("t")))
    longer = compare.digest_tree(more, ["_row"], dense=True)
    assert sorted(r["node"] for r in compare.unlike_blocks(tree, longer).collect()) == list(range(50, 300))
    assert compare.diff_cells_by_digest(a, more, ["_row"], dense=True, trees=(tree, longer)).count() == 0
    assert compare.diff_cells_by_digest(a, a.limit(0), ["_row"], dense=True).count() == 0


def test_diff_by_digests_of_keys(spark):
    a = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("key") == "k77", F.lit(-1)).otherwise(F.col("v")))
    unlike = compare.unlike_blocks(compare.digest_tree(a, ["key"]), compare.digest_tree(b, ["key"]))
    assert unlike.count() == 1
    assert rows(compare.diff_cells_by_digest(a, b, ["key"])) == [("k77", "v", "154", "-1")]


def test_rows_are_checked_against_blocks(spark):
    data = [("a", 1, 5, 5, 0), ("a", 2, 3, 5, 1), ("b", 1, 9, 9, 2), ("c", 4, 6, 6, 3)]
    df = spark.createDataFrame(data, "chrom string, start long, end long, MaxEndSoFar long, _row long")
    blocks = intervals.chromosome_blocks(df, "_row")
    assert sorted(rows(blocks)) == [("a", 0, 2), ("b", 2, 1), ("c", 3, 1)]
    status = lambda t, b: {r["check"]: (r["status"], r["violations"]) for r in intervals.validate_intervals(t, "_row", blocks=b).collect()}
    whole, label = "the blocks hold every row once", "every row has the chromosome of its block"
    assert [status(df, blocks)[c] for c in (whole, label)] == [("PASS", 0), ("PASS", 0)]
    wrong = df.withColumn("chrom", F.when(F.col("_row") == 1, "b").when(F.col("_row") == 3, "z").otherwise(F.col("chrom")))
    assert status(wrong, blocks)[label] == ("FAIL", 2)
    gaps = spark.createDataFrame([("a", 0, 2), ("b", 3, 1), ("c", 3, 1)], "chrom string, row_offset long, n_rows long")
    assert status(df, gaps)[whole] == ("FAIL", 2)
    short = spark.createDataFrame([("a", 0, 2), ("b", 2, 1)], "chrom string, row_offset long, n_rows long")
    assert status(df, short)[whole] == ("FAIL", 1) and status(df, short)[label] == ("FAIL", 1)
