"""Queries on sources, sinks and streams: tables written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, compute, filter as rows, region, reshape, select, signal, variants
from ..sinks import files as sinks
from ..sources import dataset, delimited, genomic
from ..streaming import live
from .base import genotypes, line, query, scratch_path, shares, table, written_text

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_ORDER_COLUMNS = [c.strip() for c in _ORDERS.split(",")]


@query("S2_orc_scan", f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 300000")
def orc(spark, sf):
    path = scratch_path(spark, "orc")
    table(spark, sf, "orders").select(*_ORDER_COLUMNS).write.orc(path)
    return rows.keep_rows(dataset.read_orc(spark, path), ("o_totalprice", ">", 300000))


@query(
    "S3_partitioned_dataset",
    "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS BIGINT) AS year, strftime(o_orderdate, '%m') AS month FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) < 4",
)
def partitioned(spark, sf):
    path = scratch_path(spark, "lake")
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month")
    )
    # one writer per folder and no more files than folders
    df.repartition("year", "month").write.partitionBy("year", "month").parquet(path)
    return rows.keep_rows(dataset.read_dataset(spark, path), ("year", "==", 1997), ("month", "in", ["01", "02", "03"]))


@query(
    "S4_csv_and_K1_round_trip",
    "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS note, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer",
)
def csv(spark, sf):
    path = scratch_path(spark, "csv")
    df = table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("note"), "c_nationkey", "c_acctbal"
    )
    sinks.write_delimited(df, path, sep=",")
    return delimited.read_delimited(spark, path).table


@query(
    "K1_tsv_lines",
    "SELECT o_orderkey || chr(9) || o_orderstatus || chr(9) || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END || chr(9) || '[' || o_custkey || ', ∅]' AS line FROM orders",
)
def tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    cust = F.col("o_custkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(cust % 2 != 0, cust).alias("odd"), F.array(cust, F.lit(None)).alias("list")
    )
    sinks.write_delimited(df, path, header=False)
    return dataset.read_text(spark, path)


@query(
    "S5_no_header",
    "SELECT s_suppkey AS f0, s_name AS f1, CAST(s_nationkey AS BIGINT) AS f2, s_acctbal AS f3 FROM supplier",
)
def headless(spark, sf):
    lines = table(spark, sf, "supplier").select(line(*[F.col(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")]))
    return delimited.read_delimited(spark, written_text(lines, "plain"), sep="tab").table


@query(
    "S6_quoted_missing_value",
    "SELECT c_custkey AS f0, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE c_mktsegment END AS f1 FROM customer",
)
def missing_values(spark, sf):
    key = F.col("c_custkey")
    cell = F.when(key % 3 == 0, "NA").when(key % 3 == 1, '"NA"').otherwise(F.col("c_mktsegment"))
    lines = table(spark, sf, "customer").select(line(key, cell, sep=","))
    return delimited.read_delimited(spark, written_text(lines, "na"), header="off").table


@query(
    "S7_leading_zeros_stay_text",
    "SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS f0, CAST(c_nationkey AS BIGINT) AS f1 FROM customer",
)
def zeros(spark, sf):
    lines = table(spark, sf, "customer").select(line(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.col("c_nationkey"), sep=","))
    return delimited.read_delimited(spark, written_text(lines, "zeros"), header="off").table


@query(
    "S9_given_types",
    "SELECT CAST(c_custkey AS VARCHAR) AS f0, CAST(c_nationkey AS DOUBLE) AS f1, CAST(c_custkey % 5 AS VARCHAR) AS f2 FROM customer",
)
def given_types(spark, sf):
    lines = table(spark, sf, "customer").select(line(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey") % 5, sep=";"))
    path = written_text(lines, "typed")
    return delimited.read_delimited(spark, path, "semicolon", "off", {"f1": "float", "*": "string"}).table


@query(
    "S10_late_value_widens",
    "SELECT CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'X' ELSE CAST(c_custkey AS VARCHAR) END AS f0, "
    "CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 0.5 ELSE c_nationkey END::DOUBLE AS f1 FROM customer",
)
def widened(spark, sf):
    df = table(spark, sf, "customer")
    last = df.agg(F.max("c_custkey")).scalar()
    late = F.col("c_custkey") == F.col("_last")
    df = df.withColumn("_last", last)
    lines = df.select(
        line(F.when(late, "X").otherwise(F.col("c_custkey").cast("string")), F.when(late, "0.5").otherwise(F.col("c_nationkey").cast("string")), sep=",")
    )
    return delimited.read_delimited(spark, written_text(lines, "late"), header="off").table


def _uneven(spark, sf):
    key = F.col("o_orderkey")
    cells = F.concat_ws(",", key.cast("string"), F.concat(F.lit('"'), "o_orderstatus", F.lit(',x"')))
    text = F.when(key % 7 == 3, F.concat(cells, F.lit(",extra"))).when(key % 7 == 5, key.cast("string")).otherwise(cells)
    return written_text(table(spark, sf, "orders").select(text), "uneven")


@query(
    "S11_malformed_rows_skipped",
    "SELECT o_orderkey AS f0, o_orderstatus || ',x' AS f1 FROM orders WHERE o_orderkey % 7 NOT IN (3, 5)",
)
def skipped(spark, sf):
    return delimited.read_delimited(spark, _uneven(spark, sf), header="off", on_bad_row="skip").table


@query(
    "S11_malformed_rows_padded",
    "SELECT o_orderkey AS f0, CASE WHEN o_orderkey % 7 <> 5 THEN o_orderstatus || ',x' END AS f1 FROM orders",
)
def padded(spark, sf):
    return delimited.read_delimited(spark, _uneven(spark, sf), header="off", on_bad_row="null").table


@query(
    "S12_bad_rows",
    "SELECT CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey || ',\"' || o_orderstatus || ',x\",extra' ELSE CAST(o_orderkey AS VARCHAR) END AS line FROM orders WHERE o_orderkey % 7 IN (3, 5)",
)
def bad_rows(spark, sf):
    return delimited.read_delimited(spark, _uneven(spark, sf), header="off", on_bad_row="skip").bad_rows.select("line")


@query("S13_json_records", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders")
def ndjson(spark, sf):
    path = scratch_path(spark, "ndjson")
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("o_custkey"))
    df.write.json(path)
    return dataset.read_records(spark, path)


@query("K3_json_arrays", "SELECT n_nationkey, n_name FROM nation")
def json_arrays(spark, sf):
    path = scratch_path(spark, "arrays")
    sinks.write_json_array(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), path)
    return dataset.read_records(spark, path, whole_files=True, schema="n_nationkey int, n_name string")


@query(
    "S13_array_of_records",
    "SELECT o_orderkey, o_custkey, o_orderstatus || ' }],[{\" ' || chr(10) AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders",
)
def array_of_records(spark, sf):
    """An array in each file, with brackets, quotes and breaks in its strings."""
    odd = F.concat("o_orderstatus", F.lit(' }],[{" '), F.char(F.lit(10)))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    path = scratch_path(spark, "array")
    sinks.write_json_array(table(spark, sf, "orders").select("o_orderkey", "o_custkey", odd.alias("t"), price.alias("price")), path)
    return dataset.read_records(spark, path, whole_files=True, schema="o_orderkey long, o_custkey long, t string, price double")


@query(
    "K3_one_array_over_parts",
    "SELECT 1 AS opened, 1 AS closed, count(*) AS records, count(*) - 1 AS commas, true AS ordered FROM supplier",
)
def one_array(spark, sf):
    """The lines of all parts in order: one opening bracket at the first, one closing bracket at the last."""
    path = scratch_path(spark, "one_array")
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name").repartitionByRange(7, "s_suppkey")
    sinks.write_one_json_array(df, path)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), "value")
    first, last = F.col("value").startswith("["), F.col("value").endswith("]")
    return lines.agg(
        F.count(F.when(first, 1)).cast("int").alias("opened"), F.count(F.when(last, 1)).cast("int").alias("closed"), F.count("*").alias("records"),
        F.count(F.when(F.col("value").endswith(","), 1)).alias("commas"),
        ((F.min("part") == F.min(F.when(first, F.col("part")))) & (F.max("part") == F.max(F.when(last, F.col("part"))))).alias("ordered"),
    )


@query(
    "K2_json_lines",
    "SELECT '{\"key\":' || o_orderkey || ',\"gap\":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END || ',\"list\":[' || o_custkey || ',null],\"nan\":null}' AS line FROM orders",
)
def json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf, "orders").select(
        key.alias("key"), F.when(key % 2 != 0, cust).alias("gap"), F.array(cust, F.lit(None)).alias("list"), F.lit(float("nan")).alias("nan")
    )
    sinks.write_json_lines(df, path)
    return dataset.read_text(spark, path)


@query(
    "K4_markdown_rows",
    "SELECT '| ' || replace(format('{:,}', o_orderkey), ',', '_') || ' | ' || o_orderstatus || '\\|' || o_orderpriority || ' |' AS line FROM orders",
)
def markdown(spark, sf):
    path = scratch_path(spark, "md")
    df = table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("both"))
    sinks.write_markdown(df, path)
    return dataset.read_text(spark, path)


@query("K5_parquet_zstd", f"SELECT {_ORDERS} FROM orders")
def parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    sinks.write_parquet(table(spark, sf, "orders").select(*_ORDER_COLUMNS), path)
    return spark.read.parquet(path)


@query(
    "K7_K8_provenance_and_fingerprint",
    "SELECT true AS same, 'orders' AS source, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'P'",
)
def provenance(spark, sf):
    path = scratch_path(spark, "kept")
    kept = rows.keep_rows(table(spark, sf, "orders"), ("o_orderstatus", "==", "P"))
    sinks.write_parquet(kept, path, provenance={"source": "orders", "filter": "o_orderstatus == P"}, with_fingerprint=True)
    same, source = sinks.verify_fingerprint(spark, path), sinks.read_provenance(spark, path)["source"]
    return compare.fingerprint(spark.read.parquet(path)).select(F.lit(same).alias("same"), F.lit(source).alias("source"), "n_rows")


@query(
    "S14_K9_text_lines",
    "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents) t WHERE contains(line, 'the ') GROUP BY 1",
)
def text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    sinks.write_lines(table(spark, sf, "documents"), path, "text")
    df = dataset.read_text(spark, path)
    return rows.keep_rows(df, ("line", "contains", "the ")).groupBy("line").agg(F.count("*").alias("n"))


@query("S30_compressed_input", "SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def compressed(spark, sf):
    lines = table(spark, sf, "orders").select(line(F.col("o_orderkey"), F.col("o_orderstatus"), sep=","))
    df = delimited.read_delimited(spark, written_text(lines, "gz", "gzip"), header="off").table
    return df.agg(F.count("*").alias("n_rows"), F.sum("f0").alias("total"))


@query(
    "S15_bed",
    "SELECT l_returnflag AS \"Chr\", l_orderkey AS \"[Beg\", l_orderkey + l_linenumber AS \"End)\", 'part ' || l_partkey AS \"Name\", l_quantity AS \"Score\", "
    "CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS \"Str\", l_suppkey AS \"ThBeg\" FROM lineitem",
)
def bed(spark, sf):
    strand = F.when(F.col("l_linestatus") == "F", "-").otherwise("+")
    cells = line(
        F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
        F.col("l_quantity"), strand, F.col("l_suppkey"),
    )
    comment = F.when(F.col("l_orderkey") % 100 == 0, F.concat(F.lit("# note\ntrack name=x\n"), cells)).otherwise(cells)
    return genomic.read_bed(spark, written_text(table(spark, sf, "lineitem").select(comment), "bed"))


_VCF_HEADER = "##fileformat=VCFv4.3\n##contig=<ID=F,length=100>\n##contig=<ID=O>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\tS4"


def _vcf(spark, sf):
    df = genotypes(spark, sf)
    body = df.select(
        line(
            F.col("CHROM"), F.col("POS"), F.lit("."), F.lit("A"), F.lit("T"), F.when(F.col("POS") % 3 == 0, ".").otherwise("12.5"),
            F.lit("PASS"), F.concat(F.lit("AF="), (F.col("POS") % 8 / 8).cast("string")), F.col("FORMAT"), *[F.col(f"S{i}") for i in range(1, 5)],
        ).alias("value")
    )
    header = spark.createDataFrame([(_VCF_HEADER,)], "value string")
    return written_text(header.unionByName(body), "vcf")


@query(
    "S16_vcf",
    "SELECT o_orderstatus AS \"CHROM\", o_orderkey AS \"POS\", CASE WHEN o_orderkey % 3 <> 0 THEN 12.5::DOUBLE END AS \"QUAL\", 'AF=' || (o_orderkey % 8 / 8) AS \"INFO\", "
    "'GT:AD:DP' AS \"FORMAT\" FROM orders",
)
def vcf(spark, sf):
    return genomic.read_vcf(spark, _vcf(spark, sf)).table.select("CHROM", "POS", "QUAL", "INFO", "FORMAT")


@query(
    "S17_vcf_sites_only",
    "SELECT o_orderstatus AS \"CHROM\", o_orderkey AS \"POS\", '.' AS \"ID\", 'A' AS \"REF\", 'T' AS \"ALT\", CASE WHEN o_orderkey % 3 <> 0 THEN 12.5::DOUBLE END AS \"QUAL\", 'PASS' AS \"FILTER\", "
    "'AF=' || (o_orderkey % 8 / 8) AS \"INFO\" FROM orders",
)
def sites(spark, sf):
    return genomic.read_vcf(spark, _vcf(spark, sf), samples=False).table


@query(
    "S32_header_contigs",
    "SELECT s.name, length, records FROM (SELECT o_orderstatus AS name, count(*) AS records FROM orders GROUP BY 1) s LEFT JOIN (VALUES ('F', 100)) h(name, length) ON h.name = s.name",
)
def header_contigs(spark, sf):
    source = genomic.read_vcf(spark, _vcf(spark, sf), samples=False)
    return compare.contigs(genomic.header_contigs(source), source.table.select("CHROM"))


@query(
    "S18_gff",
    "SELECT l_returnflag AS seqname, l_orderkey + 1 AS start, l_orderkey + l_linenumber AS \"end\", CASE WHEN l_linenumber <> 2 THEN l_quantity END AS score, 'L' || l_linenumber AS \"ID\" FROM lineitem",
)
def gff(spark, sf):
    k = F.col("l_linenumber")
    cells = line(
        F.col("l_returnflag"), F.lit("src"), F.lit("exon"), F.col("l_orderkey") + 1, F.col("l_orderkey") + k,
        F.when(k == 2, ".").otherwise(F.col("l_quantity").cast("string")), F.lit("+"), F.lit("."), F.concat(F.lit("ID=L"), k.cast("string"), F.lit(";p="), F.col("l_partkey").cast("string")),
    )
    body = table(spark, sf, "lineitem").select(F.when(k == 3, F.concat(F.lit("# note\n"), cells)).otherwise(cells).alias("value"))
    tail = spark.createDataFrame([("##gff-version 3\n##FASTA\n>A\nACGT\nA\tsrc\tgene\t1\t2\t.\t+\t.\tID=no",)], "value string")
    df = genomic.read_gff(spark, written_text(body.unionByName(tail), "gff")).table
    return reshape.expand(df, "attributes", keys=["ID"]).select("seqname", "start", "end", "score", "ID")


@query(
    "S19_sam",
    "SELECT l_orderkey || '-' || l_linenumber AS \"QNAME\", l_returnflag AS \"RNAME\", l_orderkey AS _start, l_orderkey + l_linenumber + 3 AS _end, l_partkey AS \"NM\" FROM lineitem WHERE l_linestatus = 'O'",
)
def sam(spark, sf):
    k = F.col("l_linenumber")
    cells = line(
        F.concat_ws("-", "l_orderkey", "l_linenumber"), F.when(F.col("l_linestatus") == "F", 1024).otherwise(0), F.col("l_returnflag"), F.col("l_orderkey") + 1,
        F.lit(60), F.concat(F.lit("2S"), k.cast("string"), F.lit("M3N1I")), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"),
        F.concat(F.lit("NM:i:"), F.col("l_partkey").cast("string")), F.lit("RG:Z:a"),
    )
    body = table(spark, sf, "lineitem").select(cells.alias("value"))
    header = spark.createDataFrame([("@HD\tVN:1.6\n@SQ\tSN:A\tLN:5",)], "value string")
    df = genomic.read_sam(spark, written_text(header.unionByName(body), "sam")).table
    kept = rows.keep_rows(df, ("FLAG", "lacks", "DUP"))
    from ..functions.coords import with_span

    return reshape.tags(with_span(kept, "sam"), "optional", ["NM"]).select("QNAME", "RNAME", "_start", "_end", "NM")


@query(
    "S20_paf",
    "SELECT l_orderkey AS tstart, l_orderkey + 10 AS tend, l_returnflag AS tname, CAST(l_quantity AS BIGINT) AS mapq, CASE WHEN l_linenumber > 1 THEN l_tax END AS \"de\" FROM lineitem",
)
def paf(spark, sf):
    cells = line(
        F.lit("q"), F.lit(100), F.lit(0), F.lit(50), F.lit("+"), F.col("l_returnflag"), F.lit(1000), F.col("l_orderkey"), F.col("l_orderkey") + 10, F.lit(9), F.lit(10),
        F.col("l_quantity").cast("long"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("de:f:"), F.col("l_tax").cast("string"))),
    )
    df = genomic.read_paf(spark, written_text(table(spark, sf, "lineitem").select(cells), "paf"))
    return reshape.tags(df, "optional", ["de"]).select("tstart", "tend", "tname", "mapq", "de")


@query(
    "S21_mpileup",
    "SELECT o_orderstatus AS chrom, o_orderkey AS pos, 'G' AS ref, o_custkey % 5 AS depth_1, o_custkey % 5 + 1 AS \"G_1\", 1 AS \"T_2\" FROM orders",
)
def mpileup(spark, sf):
    n = (F.col("o_custkey") % 5).cast("int")
    dots = F.concat(F.call_function("repeat", F.lit("."), n), F.lit(","))
    quals = F.concat(F.call_function("repeat", F.lit("I"), n), F.lit("I"))
    cells = line(F.col("o_orderstatus"), F.col("o_orderkey"), F.lit("G"), n, dots, quals, F.lit(2), F.lit("t*"), F.lit("II"))
    from ..operators.reads import decode_pileup

    df = genomic.read_mpileup(spark, written_text(table(spark, sf, "orders").select(cells), "pileup"))
    return decode_pileup(df).select("chrom", "pos", "ref", "depth_1", "G_1", "T_2")


def _matrix(spark, sf):
    """Quantities of parts by supplier as a matrix file, its header in a part of its own."""
    df = table(spark, sf, "lineitem")
    n = df.count()
    rows_, cols = (r[0] + 1 for r in (df.agg(F.max("l_partkey")).first(), df.agg(F.max("l_suppkey")).first()))
    body = df.select(line(F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.col("l_quantity").cast("long"), sep=" ").alias("value"))
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate integer general\n% made\n{rows_} {cols} {n}",)], "value string")
    return head.unionByName(body), rows_, cols


@query("S22_matrix_market", "SELECT l_partkey AS row, l_suppkey AS col, l_quantity AS value FROM lineitem")
def matrix_market(spark, sf):
    text, _, _ = _matrix(spark, sf)
    # line numbers are per file and the size line must come first, so all files share its rules
    return genomic.read_matrix_market(spark, written_text(text, "mtx"))


@query(
    "S29_tenx_directory",
    "SELECT l_partkey AS row, l_suppkey AS col, l_quantity AS value, 'id' || l_partkey AS feature_id, 'cell' || l_suppkey AS barcode FROM lineitem",
)
def tenx(spark, sf):
    text, n_rows, n_cols = _matrix(spark, sf)
    features = spark.range(n_rows).select(line(F.concat(F.lit("id"), F.col("id").cast("string")), F.lit("g"), F.lit("Gene")))
    cells = spark.range(n_cols).select(F.concat(F.lit("cell"), F.col("id").cast("string")))
    out = genomic.read_tenx(spark, written_text(text, "mtx"), written_text(features.coalesce(1), "features"), written_text(cells.coalesce(1), "barcodes"))
    return out["matrix"].select("row", "col", "value", "feature_id", "barcode")


@query(
    "S23_bedpe",
    "SELECT l_returnflag AS chrom1, l_orderkey AS start1, l_orderkey + 1 AS end1, l_linestatus AS chrom2, l_partkey AS start2, l_partkey + 2 AS end2, 'n' || l_linenumber AS name FROM lineitem",
)
def bedpe(spark, sf):
    cells = line(
        F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_orderkey") + 1, F.col("l_linestatus"), F.col("l_partkey"), F.col("l_partkey") + 2,
        F.concat(F.lit("n"), F.col("l_linenumber").cast("string")), F.lit("5"), F.lit("+"), F.lit("-"),
    )
    path = written_text(table(spark, sf, "lineitem").select(cells), "bedpe")
    return delimited.read_named(spark, path, "bedpe").drop("score", "strand1", "strand2")


@query(
    "S24_outfmt6",
    "SELECT 'q' || l_orderkey AS qseqid, 's' || l_partkey AS sseqid, l_quantity AS pident, l_tax AS evalue FROM lineitem WHERE l_tax < 0.03",
)
def outfmt6(spark, sf):
    q, s = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("q", "l_orderkey"), ("s", "l_partkey")))
    numbers = [F.lit(n) for n in (100, 2, 0, 1, 100, 5, 104)]
    cells = line(q, s, F.col("l_quantity"), *numbers, F.col("l_tax"), F.lit(180.5))
    df = delimited.read_named(spark, written_text(table(spark, sf, "lineitem").select(cells), "m8"), "outfmt6")
    return rows.keep_rows(df, ("evalue", "<", 0.03)).select("qseqid", "sseqid", "pident", "evalue")


@query(
    "S25_wiggle",
    "SELECT o_orderstatus AS \"Chr\", o_orderkey * 10 + i * 3 AS \"[Beg\", o_orderkey * 10 + i * 3 + 2 AS \"End)\", (o_custkey + i)::DOUBLE AS value FROM (SELECT *, unnest(range(3)) AS i FROM orders WHERE o_orderkey % 2 = 0) t "
    "UNION ALL SELECT o_orderstatus, o_orderkey * 10 + i, o_orderkey * 10 + i + 1, (o_custkey * i)::DOUBLE FROM (SELECT *, unnest([0, 4]) AS i FROM orders WHERE o_orderkey % 2 = 1) t",
)
def wiggle(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    fixed = F.concat(
        F.lit("fixedStep chrom="), "o_orderstatus", F.lit(" start="), text(key * 10 + 1), F.lit(" step=3 span=2\n"),
        F.concat_ws("\n", *[text(cust + i) for i in range(3)]),
    )
    variable = F.concat(
        F.lit("variableStep chrom="), "o_orderstatus", F.lit("\n"), F.concat_ws("\n", *[F.concat_ws(" ", text(key * 10 + 1 + i), text(cust * i)) for i in (0, 4)])
    )
    lines = table(spark, sf, "orders").select(F.when(key % 2 == 0, fixed).otherwise(variable))
    return genomic.read_wiggle(spark, written_text(lines, "wig"))


@query(
    "S26_alignment_blocks",
    "SELECT score, src, start, n_rows, text FROM (SELECT o_custkey::DOUBLE AS score, o_orderkey AS start, unnest(['hg.1', 'mm.2']) AS src, unnest(['AC-T', 'ACGT']) AS text, 2 AS n_rows FROM orders) t",
)
def blocks(spark, sf):
    key = F.col("o_orderkey").cast("string")
    lines = table(spark, sf, "orders").select(
        F.concat(
            F.lit("a score="), F.col("o_custkey").cast("string"), F.lit("\ns hg.1 "), key, F.lit(" 3 + 900 AC-T\ns mm.2 "), key, F.lit(" 4 - 800 ACGT\ni x\n")
        )
    )
    df = genomic.read_alignment_blocks(spark, written_text(lines, "maf"))
    sizes = df.groupBy("file", "block").agg(F.count("*").cast("int").alias("n_rows"))
    return df.join(sizes, ["file", "block"]).select("score", "src", "start", "n_rows", "text")


_SEQ = "upper(regexp_replace(text, '[^acgtACGT]', '', 'g'))"


@query(
    "S27_fasta",
    f"SELECT 'd' || doc_id AS name, lang AS comment, {_SEQ} AS seq FROM documents",
)
def fasta(spark, sf):
    return genomic.read_fasta(spark, _fasta(spark, sf))


def _fasta(spark, sf):
    seq = F.upper(F.regexp_replace("text", "[^acgtACGT]", ""))
    folded = F.rtrim(F.regexp_replace(seq, "(.{60})", "$1\n"), F.lit("\n"))
    record = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit("\n"), folded)
    return written_text(table(spark, sf, "documents").select(record), "fasta")


@query(
    "S27_fasta_blocks",
    f"SELECT 'd' || doc_id AS name, i AS block, substr({_SEQ}, i * 1000 + 1, 1000) AS bases FROM (SELECT *, unnest(range((length({_SEQ}) + 999) // 1000)) AS i FROM documents) t",
)
def fasta_blocks(spark, sf):
    return genomic.read_fasta_blocks(spark, _fasta(spark, sf), 1000)


@query(
    "S28_fastq",
    "SELECT 'r' || l_orderkey AS name, 'p' || l_partkey AS comment, repeat('ACGT', l_linenumber) AS seq, repeat('II5#', l_linenumber) AS qual FROM lineitem",
)
def fastq(spark, sf):
    k = F.col("l_linenumber")
    record = F.concat(
        F.lit("@r"), F.col("l_orderkey").cast("string"), F.lit(" p"), F.col("l_partkey").cast("string"), F.lit("\n"), F.call_function("repeat", F.lit("ACGT"), k),
        F.lit("\n+\n"), F.call_function("repeat", F.lit("II5#"), k),
    )
    df = genomic.read_fastq(spark, written_text(table(spark, sf, "lineitem").select(record), "fastq"))
    return df.select("name", "comment", "seq", "qual")


@query(
    "T1_stateless_stream",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS kilo FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'N' AND l_orderkey < 9000 AND l_orderkey + 1 > 4000",
)
def stateless(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    stream = live.read_growing(spark, f"{sf}/lineitem*.parquet", schema)
    steps = [
        lambda df: rows.keep_rows(df, ("l_quantity", ">", 30)),
        lambda df: compute.compute(df, kilo=lambda n: n("l_extendedprice") / 1000, stop=lambda n: n("l_orderkey") + 1),
        lambda df: region.overlap_filter(df, [("N", 4000, 9000)], ("l_returnflag", "l_orderkey", "stop")),
        lambda df: select.select_columns(df, "l_orderkey,l_linenumber,kilo"),
    ]
    out = scratch_path(spark, "stream")
    live.write_stream(live.chain(stream, *steps), out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "T2_live_value_counts",
    "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS count FROM events GROUP BY 2 UNION ALL SELECT 'parity', CAST(user_id % 2 AS VARCHAR), count(*) FROM events GROUP BY 2",
)
def live_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = live.read_growing(spark, f"{sf}/events*.parquet", schema).withColumn("parity", F.col("user_id") % 2)
    out = scratch_path(spark, "totals")
    keys = ["column", "value"]
    live.write_totals(live.live_value_counts(stream, ["event_type", "parity"]), out, scratch_path(spark, "progress"), keys).awaitTermination()
    return live.read_totals(spark, out, keys)


@query(
    "T2_live_shares_over_batches",
    "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM events), 12) AS fraction FROM events GROUP BY 2 "
    "UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*), round(count(*) / (SELECT count(*) FROM events), 12) FROM events GROUP BY 2",
)
def live_shares(spark, sf):
    """Arrivals of several files, one batch each; changes are put together every third batch."""
    source, out, keys = scratch_path(spark, "arrivals"), scratch_path(spark, "totals"), ["column", "value"]
    events = table(spark, sf, "events").select("event_type", "user_id", (F.col("event_id") % 5).alias("part"))
    events.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(source)
    stream = live.read_growing(spark, source, "event_type string, user_id long", maxFilesPerTrigger=1, recursiveFileLookup=True)
    counts = live.live_value_counts(stream, ["event_type", "user_id"], total=True)
    live.write_totals(counts, out, scratch_path(spark, "progress"), keys, compact=3).awaitTermination()
    return shares(live.shares_of(live.read_totals(spark, out, keys)), "fraction", digits=12)


@query(
    "T2_live_describe",
    "SELECT 'value' AS \"column\", count(value) AS count, 0 AS nulls, min(value) AS min, max(value) AS max, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std FROM events",
)
def live_describe(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = live.read_growing(spark, f"{sf}/events*.parquet", schema)
    out = scratch_path(spark, "stats")
    live.write_totals(live.live_describe(stream, ["value"]), out, scratch_path(spark, "progress"), ["column"]).awaitTermination()
    return live.read_totals(spark, out, ["column"]).withColumns({"mean": F.round("mean", 7), "std": F.round("std", 7)})


@query("T3_live_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def live_distinct(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = live.read_growing(spark, f"{sf}/events*.parquet", schema)
    out = scratch_path(spark, "seen")
    first = live.live_distinct(stream, ["user_id", "event_type"]).select("user_id", "event_type")
    live.write_stream(first, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "U2_cells_together",
    "SELECT l_returnflag AS cell, count(*) AS pixels, sum(l_quantity) AS sum FROM lineitem GROUP BY 1",
)
def cells_together(spark, sf):
    from ..operators.distinct_rows import concatenate
    from ..operators.summary import cell_totals

    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("count"))
    cells = {c: df.where(F.col("l_returnflag") == c).select("count") for c in ("A", "N", "R")}
    return cell_totals(concatenate(cells, "cell"))


@query(
    "A10_chromosome_windows",
    "SELECT o_orderstatus AS chrom, 0 AS start, max(o_orderkey) + 1 AS \"end\", count(*) / (max(o_orderkey) + 1) AS coverage, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1",
)
def chromosome_signal(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"), F.col("o_totalprice").alias("value")
    )
    lengths = df.groupBy(F.col("chrom").alias("name")).agg(F.max("end").alias("length"))
    out = signal.binned_signal(df, signal.chromosome_windows(lengths), 1)
    return out.select("chrom", "start", "end", "coverage", F.round("mean", 4).alias("mean"))


@query(
    "P12_filter_on_statistics",
    "SELECT count(*) AS n_rows FROM (SELECT o_orderkey, count(CASE WHEN NOT ((o_orderkey + i) % 10 = 0 OR (o_custkey + i * 3) % 7 IN (3, 6)) THEN 1 END) AS called FROM orders, range(1, 5) g(i) GROUP BY 1) t WHERE called = 4",
)
def statistics_filter(spark, sf):
    df = variants.gt_stats(genotypes(spark, sf))
    return rows.keep_rows(df, ("call_rate", "==", 1), ("n_missing", "==", 0)).agg(F.count("*").alias("n_rows"))


@query(
    "S8_row_names_header",
    "SELECT CAST(s_name AS VARCHAR) AS \"index\", CAST(s_nationkey AS BIGINT) AS nation, s_acctbal AS balance FROM supplier",
)
def row_names(spark, sf):
    path = scratch_path(spark, "rnames")
    cells = line(F.col("s_name"), F.col("s_nationkey"), F.col("s_acctbal"), sep=",")
    # each part gets the header line, which is one field short
    table(spark, sf, "supplier").select(cells.alias("nation,balance")).write.csv(path, sep="\t", header=True)
    return delimited.read_delimited(spark, path).table


@query(
    "S23_pairs",
    "SELECT 'r' || l_orderkey AS \"readID\", l_returnflag AS chr1, l_partkey AS pos1, l_linestatus AS chr2, l_suppkey AS pos2 FROM lineitem",
)
def pairs(spark, sf):
    cells = line(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linestatus"), F.col("l_suppkey"))
    head = spark.createDataFrame([("## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2",)], "value string")
    path = written_text(head.unionByName(table(spark, sf, "lineitem").select(cells.alias("value"))), "pairs")
    return delimited.read_headed_layout(spark, path, "pairs")


def _headed(df, first, head: str, cells):
    """Lines with a header before the first one."""
    return df.select(F.when(first, F.concat(F.lit(head), cells)).otherwise(cells))


@query(
    "S23_gct",
    "SELECT n_name AS \"Name\", 'region ' || n_regionkey AS \"Description\", n_nationkey * 1.5::DOUBLE AS \"S1\", CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey::BIGINT END AS \"S2\" FROM nation",
)
def gct(spark, sf):
    key = F.col("n_nationkey")
    last = F.when(key % 5 > 0, F.col("n_regionkey").cast("string")).otherwise("NA")
    cells = line(F.col("n_name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), key * 1.5, last)
    path = written_text(_headed(table(spark, sf, "nation"), key == 0, "#1.2\n25\t2\nName\tDescription\tS1\tS2\n", cells), "gct")
    return delimited.read_headed_layout(spark, path, "gct")


@query(
    "S23_mutation_maf",
    "SELECT 'G' || o_custkey AS \"Hugo_Symbol\", o_orderstatus AS \"Chromosome\", o_orderkey AS \"Start_Position\", o_totalprice AS \"Score\" FROM orders WHERE o_orderkey % 11 <> 5",
)
def mutation_maf(spark, sf):
    """Lines of another width than the header's are left out."""
    key = F.col("o_orderkey")
    cells = line(F.concat(F.lit("G"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"), key, F.col("o_totalprice"))
    cells = F.when(key % 11 == 5, F.concat(cells, F.lit("\textra"))).otherwise(cells)
    path = written_text(_headed(table(spark, sf, "orders"), key == 0, "#version 2.4\nHugo_Symbol\tChromosome\tStart_Position\tScore\n", cells), "maf")
    return delimited.read_headed_layout(spark, path, "maf", on_bad_row="skip")


@query(
    "S24_psam",
    "SELECT c_nationkey::BIGINT AS \"FID\", 'I' || c_custkey AS \"IID\", c_custkey % 2 + 1 AS \"SEX\", CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS \"PHENO1\" FROM customer",
)
def psam(spark, sf):
    key = F.col("c_custkey")
    last = F.when(key % 3 > 0, F.col("c_acctbal").cast("string")).otherwise("NA")
    cells = line(F.col("c_nationkey"), F.concat(F.lit("I"), key.cast("string")), key % 2 + 1, last)
    path = written_text(_headed(table(spark, sf, "customer"), key == 0, "##note\n#FID\tIID\tSEX\tPHENO1\n", cells), "psam")
    return delimited.read_headed_layout(spark, path, "psam")


_PEAK_SQL = (
    "SELECT l_returnflag AS \"Chr\", l_orderkey AS \"[Beg\", l_orderkey + l_linenumber AS \"End)\", 'p' || l_partkey AS \"Name\", l_quantity AS \"Score\", '.' AS \"Str\", "
)


def _peak_cells():
    return [F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_quantity"), F.lit(".")]


@query("S15_narrow_peaks", _PEAK_SQL + "l_tax AS \"signalValue\", l_discount AS \"pValue\", CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS \"qValue\", l_suppkey AS peak FROM lineitem")
def narrow_peaks(spark, sf):
    q = F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice").cast("string")).otherwise(".")
    cells = line(*_peak_cells(), F.col("l_tax"), F.col("l_discount"), q, F.col("l_suppkey"))
    return genomic.read_bed(spark, written_text(table(spark, sf, "lineitem").select(cells), "narrowPeak"), "narrowPeak")


@query("S15_broad_peaks", _PEAK_SQL + "l_tax AS \"signalValue\", l_discount AS \"pValue\", l_extendedprice AS \"qValue\" FROM lineitem")
def broad_peaks(spark, sf):
    cells = line(*_peak_cells(), F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice"))
    return genomic.read_bed(spark, written_text(table(spark, sf, "lineitem").select(cells), "broadPeak"), "broadPeak")


@query(
    "S15_gapped_peaks",
    _PEAK_SQL + "l_orderkey AS \"ThBeg\", l_orderkey + 1 AS \"ThEnd\", '0,0,0' AS \"RGB\", 2 AS \"NBlk\", '1,1' AS \"BlkSz\", '0,' || l_linenumber AS \"BlkSt\", "
    "l_tax AS \"signalValue\", l_discount AS \"pValue\", l_extendedprice AS \"qValue\" FROM lineitem",
)
def gapped_peaks(spark, sf):
    blocks = [F.col("l_orderkey"), F.col("l_orderkey") + 1, F.lit("0,0,0"), F.lit(2), F.lit("1,1"), F.concat(F.lit("0,"), F.col("l_linenumber").cast("string"))]
    cells = line(*_peak_cells(), *blocks, F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice"))
    return genomic.read_bed(spark, written_text(table(spark, sf, "lineitem").select(cells), "gappedPeak"), "gappedPeak")


@query("S15_bed_graph", "SELECT l_returnflag AS \"Chr\", l_orderkey AS \"[Beg\", l_orderkey + l_linenumber AS \"End)\", l_discount AS value FROM lineitem")
def bed_graph(spark, sf):
    cells = line(F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_discount"))
    return genomic.read_bed(spark, written_text(table(spark, sf, "lineitem").select(cells), "bedGraph"), "bedGraph")


@query(
    "S24_bim",
    "SELECT l_returnflag AS \"CHROM\", 'rs' || l_partkey AS \"ID\", l_discount AS \"CM\", l_orderkey AS \"POS\", l_linestatus AS \"ALT\", 'G' AS \"REF\" FROM lineitem",
)
def bim(spark, sf):
    name = F.concat(F.lit("rs"), F.col("l_partkey").cast("string"))
    cells = line(F.col("l_returnflag"), name, F.col("l_discount"), F.col("l_orderkey"), F.col("l_linestatus"), F.lit("G"))
    return delimited.read_named(spark, written_text(table(spark, sf, "lineitem").select(cells), "bim"), "bim")


@query(
    "S24_fam",
    "SELECT 'F' || c_nationkey AS \"FID\", 'I' || c_custkey AS \"IID\", '0' AS \"PAT\", '0' AS \"MAT\", CAST(c_custkey % 2 + 1 AS INTEGER) AS \"SEX\", "
    "CAST(c_nationkey AS VARCHAR) AS \"PHENO1\" FROM customer",
)
def fam(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    family, person = F.concat(F.lit("F"), nation.cast("string")), F.concat(F.lit("I"), key.cast("string"))
    cells = line(family, person, F.lit(0), F.lit(0), key % 2 + 1, nation, sep=" ")
    return delimited.read_named(spark, written_text(table(spark, sf, "customer").select(cells), "fam"), "fam")


@query(
    "S24_pvar_without_header",
    "SELECT l_returnflag AS \"CHROM\", 'rs' || l_partkey AS \"ID\", l_orderkey AS \"POS\", l_linestatus AS \"ALT\", 'G' AS \"REF\" FROM lineitem",
)
def pvar(spark, sf):
    name = F.concat(F.lit("rs"), F.col("l_partkey").cast("string"))
    cells = line(F.col("l_returnflag"), name, F.col("l_orderkey"), F.col("l_linestatus"), F.lit("G"))
    return delimited.read_headed_layout(spark, written_text(table(spark, sf, "lineitem").select(cells), "pvar"), "pvar")


@query(
    "U4_names_in_one_set_only",
    "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
)
def one_set_only(spark, sf):
    known = table(spark, sf, "customer").where("c_nationkey < 20").select("c_custkey")
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return rows.members_of(keys, "key", known, keep=False)
