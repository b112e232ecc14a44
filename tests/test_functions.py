import math
import time

import pytest
from pyspark.sql import functions as F

from gridspan.functions import arith
from gridspan.functions.cells import cell_text, sparkline, text_of, type_class
from gridspan.functions.coords import assembly, cigar_span, naming_style, standard_name, with_span
from gridspan.functions.genotype import genotype
from gridspan.functions.keyvalue import declared_fields, key_values
from gridspan.operators.compute import compute
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (0.1, "0.1"), (100.0, "100"), (-0.0, "-0"), (1e300, "1e+300"), (1.5e-7, "1.5e-07"), (123456789.25, "123456789.25"),
        (float("nan"), "nan"), (float("inf"), "inf"), (float("-inf"), "-inf"), (-2.5, "-2.5"), (1e22, "1e+22"),
    ],
)
def test_float_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(text_of(df, "v")).first()[0] == text


def test_nested_text(spark):
    df = spark.createDataFrame(
        [([1, None], {"k": 1.0}, (1, None, "x"), bytearray(b"\x00\xff"), bytearray(b"ab"), None)],
        "l array<int>, m map<string,double>, s struct<a:int,b:int,c:string>, b binary, t binary, n struct<a:int>",
    )
    texts = rows(df.select(*[text_of(df, c) for c in df.columns]))[0]
    assert texts == ("[1, ∅]", "{k: 1}", "{a: 1, c: x}", "0x00ff", "ab", None)
    assert [type_class(f.dataType) for f in df.schema][:2] == ["list", "other"]


def test_times_as_text(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 12:34:56.999' a, timestamp'1969-12-31 23:59:59+00:00' b, date'2024-01-02' c")
    assert rows(df.select(*[text_of(df, c) for c in "abc"]))[0] == (
        "2024-02-29 12:34:56.999000", "1969-12-31 23:59:59.000000Z", "2024-01-02",
    )


def test_sparkline(spark):
    assert one(spark, sparkline(F.array(*map(F.lit, [0, 1, 4, 8])))) == " ▁▄█"


def test_arithmetic_nulls(spark):
    df = spark.createDataFrame(
        [(2**63 - 1, 0, float("inf"), None, 5), (-(2**63), 7, 2.5, 1, -25)], "big long, d int, f double, n int, r int"
    )
    out = compute(
        df,
        over=lambda n: n("big") + 1,
        neg=lambda n: -n("big"),
        size=lambda n: arith.absolute(n("big")),
        div=lambda n: n("r") / n("d"),
        inf=lambda n: n("f") * 2,
        gone=lambda n: n("n") + 1,
        tens=lambda n: arith.rounded(n("r"), -1),
        low=lambda n: arith.smallest(n("n"), n("d")),
        log=lambda n: arith.log10(n("d")),
    ).drop(*df.columns)
    assert rows(out)[0] == (None, -(2**63 - 1), 2**63 - 1, None, None, None, 10, None, None)
    second = rows(out)[1]
    assert second[:8] == (-(2**63) + 1, None, None, -25 / 7, 5.0, 2, -30, 1)
    assert math.isclose(second[8], math.log10(7))


@pytest.mark.parametrize(
    ("value", "digits", "want"),
    [(2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (1234.5, -2, 1200.0), (1e300, 2, 1e300), (9e18, 0, 9e18), (-0.4, 0, 0.0)],
)
def test_round(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert compute(df, r=lambda n: arith.rounded(n("v"), digits)).first()["r"] == want


def test_times_do_not_depend_on_the_session(spark):
    df = spark.sql("select timestamp_ntz'2024-07-01 00:00:01' n, date'1970-01-03' d, timestamp'2024-07-01 00:00:01+00:00' t")
    want = (1719792001000000, 2, 1719792001000000)
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        out = compute(df, a=lambda n: n("n"), b=lambda n: n("d"), c=lambda n: n("t")).select("a", "b", "c")
        assert tuple(out.first()) == want


def test_text_is_no_number(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(TypeError, match="length"):
        compute(df, x=lambda n: n("t") + 1)
    with pytest.raises(ValueError, match="there already"):
        compute(df, t=lambda n: arith.as_number(1))


def test_chromosome_names(spark):
    names = ["chr1", "1", "chrX", "22", "23", "chrM", "MT", "chrUn_1", "M"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows(df.select(standard_name(F.col("n")), naming_style(F.col("n"))))
    assert [g[0] for g in got] == ["1", "1", "X", "22", "23", "MT", "MT", "chrUn_1", "MT"]
    assert [g[1] for g in got] == ["chr", "plain", "chr", "plain", None, "chr", "plain", None, "plain"]
    assert one(spark, assembly(F.lit("1"), F.lit(249250621))) == "GRCh37 / hg19 (Homo sapiens)"


@pytest.mark.parametrize(("cigar", "n"), [("10M2I3D5S", 13), ("*", 1), ("5S", 1), ("3=1X2N", 6)])
def test_cigar(spark, cigar, n):
    assert one(spark, cigar_span(F.lit(cigar))) == n


def test_spans(spark):
    bed = spark.createDataFrame([("c", 5, 5), ("c", 5, 9)], "Chr string, `[Beg` long, `End)` long")
    assert [r[-2:] for r in rows(with_span(bed, "bed"))] == [(5, 6), (5, 9)]
    vcf = spark.createDataFrame(
        [("c", 10, "ACG", "AF=1"), ("c", 10, "A", "X=1;END=40"), ("c", 10, "A", "BEND=4")], "CHROM string, POS int, REF string, INFO string"
    )
    assert [r[-2:] for r in rows(with_span(vcf, "vcf"))] == [(9, 12), (9, 40), (9, 10)]


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("0/1", ("het", 2, 1)), ("1|1", ("hom_alt", 2, 2)), ("./.", ("missing", 0, 0)), ("0", ("hom_ref", 1, 0)), ("1/2", ("het", 2, 2)),
        ("0/0/1", ("het", 3, 1)), ("./1", ("hom_alt", 1, 1)), (".", ("missing", 0, 0)), (None, ("missing", 0, 0)), ("2|2|2", ("hom_alt", 3, 3)),
    ],
)
def test_genotype(spark, call, want):
    assert tuple(one(spark, genotype(F.lit(call).cast("string")))) == want


@pytest.mark.parametrize(
    ("packed", "want"),
    [
        ("AF=0.5;DB;AC=3;AF=9", {"AF": "0.5", "DB": "", "AC": "3"}), ('gene_id "x; y"; tag "a"; tag "b";', {"gene_id": "x; y", "tag": "a"}),
        (" k = v ;; j=", {"k": "v", "j": ""}), ("ID=a b;P=x=y", {"ID": "a b", "P": "x=y"}), ("", {}),
    ],
)
def test_key_values(spark, packed, want):
    assert one(spark, key_values(F.lit(packed))) == want


def test_declared_fields():
    header = ['##INFO=<ID=A,Number=1,Type=Integer,Description="x, y">', "##FORMAT=<ID=B,Number=R,Type=Float>", "##INFO=<Number=1>"]
    assert declared_fields(header, "INFO") == {"A": ("Integer", "1")}
    assert declared_fields(header, "FORMAT") == {"B": ("Float", "R")}


def test_variant_text(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"a":[1]}')).alias("v"))
    assert df.select(cell_text(F.col("v"), df.schema["v"].dataType)).first()[0] == '{"a":[1]}'


def test_whole_numbers_overflow_without_an_exception(spark):
    """Exact at the bounds of 64 bits, and rows far beyond are told before anything is thrown."""
    low, high = -(1 << 63), (1 << 63) - 1
    edge = [low, low + 1, -(1 << 32), -3, -1, 0, 1, 2, 3, 1 << 31, (1 << 32) + 1, 3037000499, 3037000500, high // 3, high - 1, high, None]
    pairs = [(a, b) for a in edge for b in edge]
    df = spark.createDataFrame(pairs, "a long, b long")
    out = compute(df, s=lambda n: n("a") + n("b"), d=lambda n: n("a") - n("b"), m=lambda n: n("a") * n("b"), g=lambda n: -n("a"))
    fits = lambda x: x if x is not None and low <= x <= high else None
    for r in out.collect():
        a, b = r["a"], r["b"]
        known = a is not None and b is not None
        want = [fits(f(a, b)) if known else None for f in (int.__add__, int.__sub__, int.__mul__)]
        assert [r["s"], r["d"], r["m"]] == want and r["g"] == (None if a is None else fits(-a))

    many = spark.range(400_000).select((F.col("id") + 3).alias("a"))
    timed = lambda frame: min(_seconds(lambda: frame.agg(F.count("x")).collect()) for _ in range(3))
    plain = timed(many.select(F.try_multiply(F.col("a") % 2, F.lit(1 << 62)).alias("x")))
    assert timed(compute(many, x=lambda n: n("a") * (1 << 62))) < 0.5 + 3 * plain


def _seconds(work):
    begun = time.monotonic()
    work()
    return time.monotonic() - begun


def test_a_long_chain_of_whole_numbers_stays_small(spark):
    def chain(n):
        total = n("a")
        for i in range(12):
            total = total * 3 + n("a") - i
        return total

    df = spark.createDataFrame([(1,), (1 << 45,)], "a long")
    want = chain(lambda _: 1)
    assert [r["x"] for r in compute(df, x=chain).orderBy("a").collect()] == [want, None]
