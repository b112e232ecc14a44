import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from gridspan.operators import compare, region, reshape, variants
from gridspan.sinks import files
from gridspan.sources import dataset, delimited, genomic
from tests.conftest import rows
from tests.oracle import plan


def test_header_is_found(spark, lines):
    df = delimited.read_delimited(spark, lines("a.csv", "name,count,ratio\na,1,0.5\nb,2,1.5\n")).table
    assert df.dtypes == [("name", "string"), ("count", "bigint"), ("ratio", "double")]
    assert sorted(rows(df)) == [("a", 1, 0.5), ("b", 2, 1.5)]


def test_no_header(spark, lines):
    df = delimited.read_delimited(spark, lines("a.tsv", "a\t1\nb\t2\n"), sep="tab").table
    assert df.columns == ["f0", "f1"] and df.count() == 2


def test_quotes(spark, lines):
    text = 'a,b\r\n"x, ""y""",1\r\n,2\r\n"NA",3\r\nNA,4\r\n""," 5"\r\n'
    df = delimited.read_delimited(spark, lines("q.csv", text), header="on", types={"b": "string"}).table
    assert sorted(rows(df.select("b", "a"))) == [(" 5", ""), ("1", 'x, "y"'), ("2", None), ("3", "NA"), ("4", None)]


def test_row_names_header(spark, lines):
    df = delimited.read_delimited(spark, lines("r.csv", "x,y\ng1,1,2\ng2,3,4\n")).table
    assert df.columns == ["index", "x", "y"] and sorted(rows(df))[0] == ("g1", 1, 2)


@pytest.mark.parametrize("head", ["name,,x", "name,x,x"])
def test_header_over_columns_that_are_empty_at_first(spark, lines, head):
    text = head + "\n" + "a,b,\n" * 300 + "a,b,5\n"
    df = delimited.read_delimited(spark, lines("late.csv", text)).table
    assert df.columns[0] == "name" and df.count() == 301 and df.agg(F.sum(df.columns[2])).first()[0] == 5


def test_wide_rows_at_the_start_are_malformed(spark, lines):
    path = lines("wide.csv", "a,b\n" + "1,2,3\n" * 200 + "4,5\n" * 300)
    got = delimited.read_delimited(spark, path, on_bad_row="skip")
    assert got.table.columns == ["a", "b"] and got.table.count() == 300 and got.bad_rows.count() == 200
    with pytest.raises(ValueError, match="line 2: expected 2 fields, got 3"):
        delimited.read_delimited(spark, path)
    path = lines("narrow.csv", "a,b\n" + "1,2,3\n" * 300 + "4,5\n")
    got = delimited.read_delimited(spark, path, on_bad_row="skip")
    assert got.table.columns == ["index", "a", "b"] and got.table.count() == 300 and got.bad_rows.count() == 1


def test_types(spark, lines):
    path = lines("t.csv", "id,n,z\n1,1,007\n2,2.5,1\n3,x,2\n")
    assert [t for _, t in delimited.read_delimited(spark, path).table.dtypes] == ["bigint", "string", "string"]
    given = delimited.read_delimited(spark, path, types={"*": "string", "id": "float"}).table
    assert [t for _, t in given.dtypes] == ["double", "string", "string"]
    with pytest.raises(ValueError, match="no column"):
        delimited.read_delimited(spark, path, types={"nope": "int"})


def test_malformed_rows(spark, lines, tmp_path):
    path = lines("m.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n")
    with pytest.raises(ValueError, match="line 3: expected 2 fields, got 1: 3"):
        delimited.read_delimited(spark, path)
    skipped = delimited.read_delimited(spark, path, on_bad_row="skip")
    assert sorted(rows(skipped.table)) == [(1, 2), (7, 8)]
    padded = delimited.read_delimited(spark, path, on_bad_row="null").table
    assert sorted(rows(padded)) == [(1, 2), (3, None), (4, 5), (7, 8)]
    out = str(tmp_path / "bad")
    delimited.write_bad_rows(skipped.bad_rows, out)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["3\t3", "4\t4,5,6"]


def test_many_files_with_headers(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(100).select("id", (F.col("id") / 2).alias("half")).repartition(5).write.csv(path, header=True)
    df = delimited.read_delimited(spark, path).table
    assert df.agg(F.count("*"), F.sum("id")).first() == (100, 4950)


def test_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    df = delimited.read_delimited(spark, str(tmp_path)).table
    assert sorted(rows(df.select("a", "b"))) == [(1, "x"), (2, "y")]
    (tmp_path / "c.csv").write_text("a,c\n3,z\n")
    with pytest.raises(ValueError, match="names columns"):
        delimited.read_delimited(spark, str(tmp_path))


def test_comment_lines_before_the_header(spark, lines):
    df = delimited.read_delimited(spark, lines("c.csv", "# made by x\na,b\n1,2\n# end\n3,4\n"), comment="#").table
    assert df.columns == ["a", "b"] and sorted(rows(df)) == [(1, 2), (3, 4)]


def test_a_line_break_inside_a_cell_is_malformed(spark, lines):
    path = lines("b.csv", 'a,b\n1,"x\ny"\n2,z\n')
    with pytest.raises(ValueError, match="line 2"):
        delimited.read_delimited(spark, path)
    got = delimited.read_delimited(spark, path, on_bad_row="skip")
    assert rows(got.table) == [(2, "z")] and got.bad_rows.count() == 2


def test_partition_keys(spark, tmp_path):
    path = str(tmp_path / "lake")
    df = spark.range(20).select("id", F.lit(2024).alias("year"), F.lpad((F.col("id") % 3 + 1).cast("string"), 2, "0").alias("month"))
    df.write.partitionBy("year", "month").parquet(path)
    got = dataset.read_dataset(spark, path)
    assert got.dtypes == [("id", "bigint"), ("year", "bigint"), ("month", "string")]
    assert got.where("month = '01'").count() == 7


def test_same_schema(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(3).coalesce(1).write.parquet(path)
    assert dataset.read_dataset(spark, path).count() == 3
    spark.range(3).select(F.col("id").cast("string").alias("id")).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="different schemas"):
        dataset.read_dataset(spark, path)


def test_repeated_key_and_depth_of_files(spark, tmp_path):
    path = str(tmp_path / "b")
    spark.range(3).coalesce(1).write.parquet(f"{path}/part=1")
    spark.range(3).select("id", F.lit("x").alias("extra")).coalesce(1).write.parquet(f"{path}/part=2")
    with pytest.raises(ValueError, match="extra"):
        dataset.read_dataset(spark, path)


BED = "track name=x\n# c\nchr1\t100\t200\tpeak_0\t0.0\t+\nchr2\t5\t9\tpeak_1\t1.5\t.\n"


def test_bed(spark, lines):
    df = genomic.read_bed(spark, lines("a.bed", BED))
    assert df.columns == ["Chr", "[Beg", "End)", "Name", "Score", "Str"]
    assert sorted(rows(df)) == [("chr1", 100, 200, "peak_0", 0.0, "+"), ("chr2", 5, 9, "peak_1", 1.5, ".")]
    odd = genomic.read_bed(spark, lines("b.bed", "chr1\t1\t2\tn\tnot_a_score\t7\n"))
    assert odd.columns == ["Chr", "[Beg", "End)", "Name", "+1", "+2"]


def test_peaks(spark, lines):
    df = genomic.read_bed(spark, lines("a.narrowPeak", "chr1\t1\t2\tp\t9\t+\t2.5\t3\t-1\t7\n"), "narrowPeak")
    assert rows(df) == [("chr1", 1, 2, "p", 9.0, "+", 2.5, 3.0, -1.0, 7)]


VCF = (
    '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=1,Type=Float,Description="f">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="x">\n'
    "##FORMAT=<ID=GT,Number=1,Type=String>\n##FORMAT=<ID=DP,Number=1,Type=Integer>\n##contig=<ID=chr1,length=1000>\n##contig=<ID=chr9>\n"
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    "chr1\t100\t.\tA\tT\t.\tPASS\tAF=0.5;DB\tGT:DP\t0/1:11\t.\nchr1\t200\trs1\tAC\tT\t30\tq10\tAF=.\tDP\t3\t4\n"
)


def test_vcf(spark, lines):
    source = genomic.read_vcf(spark, lines("a.vcf", VCF))
    assert source.table.columns[-3:] == ["FORMAT", "S1", "S2"]
    assert sorted(rows(source.table.select("POS", "QUAL"))) == [(100, None), (200, 30.0)]
    header = source.header_lines()
    out = reshape.expand(source.table, "INFO", header=header)
    assert sorted(rows(out.select("POS", "AF", "DB"))) == [(100, 0.5, True), (200, None, False)]
    long = variants.samples_long(source.table, header)
    assert sorted(rows(long.select("POS", "sample", "GT", "DP")), key=str) == [
        (100, "S1", "0/1", 11), (100, "S2", None, None), (200, "S1", None, 3), (200, "S2", None, 4),
    ]
    contigs = compare.contigs(genomic.header_contigs(source), source.table.select("CHROM"))
    assert sorted(rows(contigs)) == [("chr1", 1000, 2), ("chr9", None, 0)]
    sites = genomic.read_vcf(spark, lines("b.vcf", VCF), samples=False).table
    assert sites.columns[-1] == "INFO" and sites.count() == 2


def test_gff_ends_at_fasta(spark, lines):
    text = '##gff-version 3\nc\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g"; tag "a"; tag "b";\n# note\nc\ts\texon\t2\t3\t5\t-\t0\tID=x\n##FASTA\n>c\nACGT\n'
    source = genomic.read_gff(spark, lines("a.gff", text))
    assert sorted(rows(source.table.select("feature", "start", "score"))) == [("exon", 2, 5.0), ("gene", 1, None)]
    out = reshape.expand(source.table, "attributes", keys=["gene_id", "tag", "ID"])
    assert sorted(rows(out.select("gene_id", "tag", "ID")), key=str) == [("g", "a", None), (None, None, "x")]


def test_sam_and_tags(spark, lines):
    text = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:248956422\n@r\t0\tchr1\t5\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:2\tRG:Z:a:b\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\txx:f:1.5\n"
    source = genomic.read_sam(spark, lines("a.sam", text))
    out = reshape.tags(source.table, "optional", ["NM", "RG", "xx"])
    assert sorted(rows(out.select("QNAME", "NM", "RG", "xx")), key=str) == [("@r", 2, "a:b", None), ("r2", None, None, 1.5)]
    names = genomic.header_contigs(source)
    assert rows(names) == [("chr1", 248956422)]
    assert compare.detected_assembly(names).first()[0].startswith("GRCh38")


def test_mpileup_samples(spark, lines):
    df = genomic.read_mpileup(spark, lines("a.pileup", "c\t1\tA\t2\t.,\tII\t1\tT\tI\n"))
    assert df.columns == ["chrom", "pos", "ref", "depth_1", "bases_1", "quals_1", "depth_2", "bases_2", "quals_2"]


def test_matrix_market(spark, lines):
    good = "%%MatrixMarket matrix coordinate integer general\n% c\n3 2 2\n1 2 5\n3 1 7\n"
    assert sorted(rows(genomic.read_matrix_market(spark, lines("a.mtx", good)))) == [(0, 1, 5.0), (2, 0, 7.0)]
    with pytest.raises(ValueError, match="2 entries, the file has 1"):
        genomic.read_matrix_market(spark, lines("b.mtx", good.replace("3 1 7\n", "")))
    with pytest.raises(ValueError, match="outside"):
        genomic.read_matrix_market(spark, lines("c.mtx", good.replace("3 1 7", "4 1 7")))
    with pytest.raises(ValueError, match="symmetric"):
        genomic.read_matrix_market(spark, lines("d.mtx", good.replace("general", "symmetric")))
    pattern = genomic.read_matrix_market(spark, lines("e.mtx", good.replace("integer", "pattern")))
    assert pattern.columns == ["row", "col"]


def test_tenx(spark, lines):
    m = lines("m.mtx", "%%MatrixMarket matrix coordinate integer general\n2 3 2\n1 3 5\n2 1 7\n")
    f, b = lines("f.tsv", "g1\tG1\tGene\ng2\tG2\tGene\n"), lines("b.tsv", "AA\nBB\nCC\n")
    out = genomic.read_tenx(spark, m, f, b)["matrix"]
    assert sorted(rows(out.select("feature_name", "barcode", "value"))) == [("G1", "CC", 5.0), ("G2", "AA", 7.0)]
    with pytest.raises(ValueError, match="does not fit"):
        genomic.read_tenx(spark, m, f, lines("b2.tsv", "AA\n"))


def test_wiggle(spark, lines):
    text = "track type=wiggle_0\nfixedStep chrom=c start=11 step=5 span=2\n1\n2.5\nvariableStep chrom=d span=3\n101 9\n200 8\nfixedStep chrom=c start=1\n4\n"
    got = sorted(rows(genomic.read_wiggle(spark, lines("a.wig", text))))
    assert got == [("c", 0, 1, 4.0), ("c", 10, 12, 1.0), ("c", 15, 17, 2.5), ("d", 100, 103, 9.0), ("d", 199, 202, 8.0)]


def test_alignment_blocks(spark, lines):
    text = "##maf version=1\na score=5.0\ns hg.1 10 3 + 90 AC-T\ns mm.2 5 4 - 80 ACGT\n\na\ns hg.1 20 2 + 90 AC\n"
    df = genomic.read_alignment_blocks(spark, lines("a.maf", text)).drop("file", "line_no")
    assert sorted(rows(df), key=str) == [
        (1, 5.0, "hg.1", 10, 3, "+", 90, "AC-T"), (1, 5.0, "mm.2", 5, 4, "-", 80, "ACGT"), (2, None, "hg.1", 20, 2, "+", 90, "AC"),
    ]


FASTA = ">a one two\nACGT\nAC\n>b\n\n>c\nGGGGGGGGGG\n"


def test_fasta(spark, lines):
    got = sorted(rows(genomic.read_fasta(spark, lines("a.fa", FASTA))))
    assert got == [("a", "one two", "ACGTAC"), ("b", None, ""), ("c", None, "GGGGGGGGGG")]


def test_fasta_blocks_and_windows(spark, lines):
    blocks = genomic.read_fasta_blocks(spark, lines("a.fa", FASTA), 4)
    assert sorted(rows(blocks)) == [("a", 0, "ACGT"), ("a", 1, "AC"), ("c", 0, "GGGG"), ("c", 1, "GGGG"), ("c", 2, "GG")]
    wanted = region.windows_frame(spark, region.parse_regions("a:2-100,c:3-9,b:0-4,a"))
    got = sorted(rows(region.sequence_windows(blocks, wanted, 4)))
    assert got == [("a", 0, 6, 6, "ACGTAC", 3), ("a", 2, 6, 4, "GTAC", 0), ("c", 3, 9, 6, "GGGGGG", 1)]


def test_fastq(spark, lines):
    got = sorted(rows(genomic.read_fastq(spark, lines("a.fq", "@r1 x\nACG\n+\nIII\n@r2\nT\n+r2\n!\n")).drop("file", "record")))
    assert got == [("r1", "x", "ACG", "III"), ("r2", None, "T", "!")]
    with pytest.raises(Exception, match="malformed record"):
        genomic.read_fastq(spark, lines("b.fq", "@r1\nACG\n+\nII\n")).collect()
    with pytest.raises(Exception, match="malformed record"):
        genomic.read_fastq(spark, lines("b.fq", "@r1\nACG\n+\nII\n")).select("name").collect()
    with pytest.raises(Exception, match="malformed record"):
        genomic.read_fastq(spark, lines("b.fq", "@r1\nACG\n+\nII\n")).count()


def test_gzip(spark, tmp_path):
    path = tmp_path / "a.bed.gz"
    path.write_bytes(gzip.compress(BED.encode()))
    assert genomic.read_bed(spark, str(path)).count() == 2


@pytest.mark.parametrize(
    ("layout", "text", "columns"),
    [
        ("pvar", "##x\n#CHROM\tPOS\tID\n1\t5\trs1\n", [("CHROM", "string"), ("POS", "bigint"), ("ID", "string")]),
        ("pairs", "## pairs\n#columns: readID chr1 pos1\nr\t1\t5\n", [("readID", "string"), ("chr1", "string"), ("pos1", "bigint")]),
        ("gct", "#1.2\n1\t1\nName\tDescription\tS1\ng\td\t0.5\n", [("Name", "string"), ("Description", "string"), ("S1", "double")]),
        ("maf", "#version 2.4\nHugo_Symbol\tStart\nTP53\t7\n", [("Hugo_Symbol", "string"), ("Start", "bigint")]),
    ],
)
def test_headed_layouts(spark, lines, layout, text, columns):
    df = delimited.read_headed_layout(spark, lines(f"a.{layout}", text), layout)
    assert df.dtypes == columns and df.count() == 1


def test_plink(spark, lines):
    bim = delimited.read_named(spark, lines("a.bim", "1\trs1\t0.5\t100\tA\tG\n"), "bim")
    assert bim.columns == ["CHROM", "ID", "CM", "POS", "ALT", "REF"] and rows(bim) == [("1", "rs1", 0.5, 100, "A", "G")]
    fam = delimited.read_named(spark, lines("a.fam", "F1 I1 0 0 1 -9\nF2 I2 0 0 2 1\n"), "fam")
    assert fam.columns == ["FID", "IID", "PAT", "MAT", "SEX", "PHENO1"]
    assert sorted(rows(fam)) == [("F1", "I1", "0", "0", 1, "-9"), ("F2", "I2", "0", "0", 2, "1")]
    bare = delimited.read_headed_layout(spark, lines("b.pvar", "1\trs1\t100\tG\tA\n1\trs2\t200\tT\tC\n"), "pvar")
    assert bare.columns == ["CHROM", "ID", "POS", "ALT", "REF"] and bare.count() == 2
    assert delimited.read_headed_layout(spark, lines("b.psam", "F1\tI1\t0\t0\t1\t-9\n"), "psam").count() == 1


def test_named_layouts_take_quotes_as_they_are(spark, lines):
    hit = "\t".join(['"q', "s", "99.5", "10", "0", "0", "1", "10", "1", "10", "0.001", "50"])
    path = lines("a.m8", f"{hit}\n{hit[1:]}\nshort\tx\n")
    got = delimited.read_named(spark, path, "outfmt6", on_bad_row="skip")
    assert sorted(r["qseqid"] for r in got.collect()) == ['"q', "q"]
    with pytest.raises(Exception, match="expected 12 fields, got 2"):
        delimited.read_named(spark, path, "outfmt6").collect()
    pairs = delimited.read_named(spark, lines("a.bedpe", "chr1\t1\t2\tchr2\t3\t4\n"), "bedpe")
    assert rows(pairs.select("chrom1", "end2", "name")) == [("chr1", 4, None)]


def test_json_array_file(spark, lines):
    df = dataset.read_records(spark, lines("a.json", '[{"a": 1, "b": {"c": [1]}},\n {"a": 2, "d": "x"}]'), whole_files=True)
    assert df.columns == ["a", "b", "d"] and df.count() == 2


ELEMENTS = [
    {"a": 1, "t": 'brackets } ] { [ and "quotes" \\ and \n breaks'}, {"a": 2, "t": "\\\\"}, {"a": 3, "t": '\\"}', "o": {"l": [1, {"x": {}}], "e": {}}}, {"a": 4}, {}, {"a": 5, "t": "é } 東京"},
]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", ["64", "1000000"])
def test_an_array_of_many_splits(spark, tmp_path, indent, split):
    """Read by several tasks, with brackets, quotes and breaks in strings; as the reader of whole files does it."""
    path = tmp_path / "array"
    path.mkdir()
    many = [{**ELEMENTS[i % len(ELEMENTS)], "n": i} for i in range(150)]
    (path / "a.json").write_text(json.dumps(many, indent=indent) + "\n")
    (path / "b.json").write_text("\ufeff [\n]\n")
    (path / "c.json").write_text(json.dumps({"n": 1000, "t": "one object"}, indent=indent))
    (path / "d.json").write_text(" [" + json.dumps({"n": 2000}) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = dataset.read_records(spark, str(path), whole_files=True)
        files = dataset.element_texts(spark, str(path))
        assert files.groupBy("file").count().count() == 3
        if split == "64":
            assert spark.read.option("lineSep", "}").text(str(path / "a.json")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = spark.read.json(str(path), multiLine=True)
    if "_corrupt_record" in want.columns:
        want = want.drop("_corrupt_record")
    want = want.where("n IS NOT NULL OR a IS NOT NULL OR t IS NOT NULL")
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 152


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}] {"a": 2}', '{"a": {"b": 1}', '[{"a": 1}}]'])
def test_a_broken_array_is_an_error(spark, lines, text):
    with pytest.raises(ValueError, match="ends too early"):
        dataset.read_records(spark, lines("broken.json", text), whole_files=True).collect()


def test_elements_with_a_schema(spark, lines):
    df = dataset.read_records(spark, lines("a.json", '[{"a": 1},\n\n{"a": 2, "b": "x"} , {"b": "y"}]'), whole_files=True, schema="a int, b string")
    assert sorted(rows(df), key=str) == [(1, None), (2, "x"), (None, "y")]
    assert dataset.read_records(spark, lines("b.json", " [ ] "), whole_files=True, schema="a int").count() == 0


def test_one_array_over_all_parts(spark, tmp_path):
    def joined(df, name):
        path = tmp_path / name
        files.write_one_json_array(df, str(path))
        return "".join(p.read_text() for p in sorted(path.glob("part-*")))

    df = spark.range(0, 100, 1, 7).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    assert json.loads(joined(df, "all")) == [{"id": i, "t": f"x{i}"} for i in range(100)]
    # parts without rows at both ends and in between
    assert json.loads(joined(df.where("id BETWEEN 20 AND 28 OR id BETWEEN 60 AND 61"), "gaps")) == [{"id": i, "t": f"x{i}"} for i in [*range(20, 29), 60, 61]]
    assert json.loads(joined(df.where("id = 55"), "one")) == [{"id": 55, "t": "x55"}]
    assert json.loads(joined(df.where("id < 0"), "none")) == []
    shuffled = df.groupBy((F.col("id") % 10).alias("k")).count()
    assert sorted(r["k"] for r in json.loads(joined(shuffled, "grouped"))) == list(range(10))


def test_rows_that_move_between_passes_are_settled(spark, tmp_path, monkeypatch):
    calls = []
    marked = files._write_marked
    monkeypatch.setattr(files, "_write_marked", lambda rows, wanted, path, mode: marked(rows, wanted, path, mode) and bool(calls.append(mode) or len(calls) > 1))
    files.write_one_json_array(spark.range(20), str(tmp_path / "moved"))
    assert calls == ["error", "overwrite"]
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "moved").glob("part-*")))) == [{"id": i} for i in range(20)]


@pytest.mark.parametrize("policy,want", [("skip", [(1, "x")]), ("null", [(1, "x"), (2, None), (3, "y")])])
def test_headed_layouts_follow_a_policy(spark, lines, policy, want):
    path = lines("a.maf", "#v\nn\tName\n1\tx\n2\n3\ty\tz\n")
    assert sorted(rows(delimited.read_headed_layout(spark, path, "maf", on_bad_row=policy)), key=str) == want
    with pytest.raises(Exception, match="expected 2 fields, got"):
        delimited.read_headed_layout(spark, path, "maf").collect()


def test_tasks_grow_with_the_text(spark, lines, monkeypatch):
    """Lines that are shuffled carry no path and go to as many tasks as their bytes need."""
    from gridspan.plans import position

    monkeypatch.setattr(position, "TASK_BYTES", 200)
    fastq = "".join(f"@r{i} c\nACGT\n+\nIIII\n" for i in range(200))
    wig = "".join(f"fixedStep chrom=c start={i * 9 + 1} step=2\n{i}\n{i + 1}\n" for i in range(200))
    maf = "".join(f"a score={i}\ns hg {i} 1 + 9 A\n" for i in range(200))
    for read, name, text, want in ((genomic.read_fastq, "a.fq", fastq, 200), (genomic.read_wiggle, "a.wig", wig, 400), (genomic.read_alignment_blocks, "a.maf", maf, 200)):
        df = read(spark, lines(name, text))
        tasks = [int(n) for n in re.findall(r"REPARTITION_BY_NUM", plan(df)) and re.findall(r"hashpartitioning\(file_no#\d+, \w+#\d+L?, (\d+)\)", plan(df))]
        assert max(tasks) == -(-len(text) // 200)
        assert df.count() == want


def test_elements_of_an_array_go_to_tasks_by_their_bytes(spark, lines, monkeypatch):
    from gridspan.plans import position

    monkeypatch.setattr(position, "TASK_BYTES", 100)
    text = "[" + ", ".join(f'{{"a": {i}, "b": {{"c": "x }}"}}}}' for i in range(60)) + "]"
    df = dataset.read_records(spark, lines("many.json", text), whole_files=True, schema="a int")
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(file_no#\d+, \w+#\d+L?, (\d+)\)", plan(df))]
    assert max(tasks) == -(-len(text) // 100)
    assert sorted(r["a"] for r in df.collect()) == list(range(60))
