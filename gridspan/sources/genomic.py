"""Line-oriented genomic formats as typed tables.

All of them are text scans that Spark splits; header lines are kept apart as a frame of lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, small_side
from ..plans.position import lines_by_file_number, ordered_lines, text_lines
from ..plans.scan import prefix_scan
from .lines import fields_frame, plain_fields, without_return

# Columns of the formats.
BED_COLUMNS = [
    ("Chr", "string"), ("[Beg", "long"), ("End)", "long"), ("Name", "string"), ("Score", "double"),
    ("Str", "string"), ("ThBeg", "long"), ("ThEnd", "long"), ("RGB", "string"), ("NBlk", "long"),
    ("BlkSz", "string"), ("BlkSt", "string"),
]
PEAK_COLUMNS = [("signalValue", "double"), ("pValue", "double"), ("qValue", "double")]
BED_VARIANTS = {
    "narrowPeak": BED_COLUMNS[:6] + PEAK_COLUMNS + [("peak", "long")],
    "broadPeak": BED_COLUMNS[:6] + PEAK_COLUMNS,
    "gappedPeak": BED_COLUMNS + PEAK_COLUMNS,
    "bedGraph": BED_COLUMNS[:3] + [("value", "double")],
    "tagAlign": BED_COLUMNS[:3] + [("sequence", "string"), ("Score", "double"), ("Str", "string")],
}
VCF_COLUMNS = [
    ("CHROM", "string"), ("POS", "long"), ("ID", "string"), ("REF", "string"), ("ALT", "string"),
    ("QUAL", "double"), ("FILTER", "string"), ("INFO", "string"),
]
GFF_COLUMNS = [
    ("seqname", "string"), ("source", "string"), ("feature", "string"), ("start", "long"), ("end", "long"),
    ("score", "double"), ("strand", "string"), ("frame", "string"), ("attributes", "string"),
]
SAM_COLUMNS = [
    ("QNAME", "string"), ("FLAG", "long"), ("RNAME", "string"), ("POS", "long"), ("MAPQ", "long"),
    ("CIGAR", "string"), ("RNEXT", "string"), ("PNEXT", "long"), ("TLEN", "long"), ("SEQ", "string"),
    ("QUAL", "string"),
]
PAF_COLUMNS = [
    ("qname", "string"), ("qlen", "long"), ("qstart", "long"), ("qend", "long"), ("strand", "string"),
    ("tname", "string"), ("tlen", "long"), ("tstart", "long"), ("tend", "long"), ("nmatch", "long"),
    ("alnlen", "long"), ("mapq", "long"),
]


def _body(spark: SparkSession, path: str, drop: Column) -> DataFrame:
    lines = spark.read.text(path).select(without_return(F.col("value")).alias("line"))
    return lines.where((F.col("line") != "") & ~drop)


def read_bed(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """BED3 to BED12 and its peak and signal variants.

    The columns after the third are named as far as their values keep to the type of that
    column over the whole file; from the first that does not, they are ``+1``, ``+2`` … as text.
    """
    lines = _body(spark, path, F.col("line").rlike(r"^(#|track(\s|$)|browser(\s|$))"))
    if variant:
        return fields_frame(lines, BED_VARIANTS[variant])
    split = lines.select(plain_fields(F.col("line")).alias("f"))
    tests = [F.max(F.size("f")).alias("width")]
    for i, (_, kind) in enumerate(BED_COLUMNS[3:], 3):
        raw = F.get("f", F.lit(i))
        raw = F.when(~raw.isin("", "."), raw)
        number = raw.try_cast("long" if kind == "long" else "double").isNotNull()
        # a text column counts as text unless every value is a number
        tests.append((F.bool_and(number) if kind != "string" else F.bool_or(~number)).alias(f"t{i}"))
    row = split.agg(*tests).first()
    width = row["width"] or 3
    named = 3
    while named < min(width, 12) and row[f"t{named}"] is not False:
        named += 1
    columns = BED_COLUMNS[:named] + [(f"+{i - named + 1}", "string") for i in range(named, width)]
    return fields_frame(lines, columns)


@dataclass
class WithHeader:
    """A table and its header lines (file, at, line), ``at`` ordering those of a file."""

    table: DataFrame
    header: DataFrame

    def header_lines(self, start: str = "##") -> list[str]:
        """Distinct header lines with a given start, in file order; a header, not data."""
        kept = self.header.where(F.col("line").startswith(start)).groupBy("line").agg(
            F.min(F.struct("file", "at")).alias("first")
        )
        return [r["line"] for r in kept.orderBy("first").collect()]


def _split_header(spark: SparkSession, path: str, mark: str) -> tuple[DataFrame, DataFrame]:
    lines = ordered_lines(spark, path).withColumn("line", without_return(F.col("line")))
    return lines.where(F.col("line").startswith(mark)), _body(spark, path, F.col("line").startswith(mark))


def read_vcf(spark: SparkSession, path: str, samples: bool = True) -> WithHeader:
    """Variant text. With ``samples=False`` lines are cut after INFO before they are split, so
    the cost of a sites-only read does not depend on the number of samples."""
    header, body = _split_header(spark, path, "#")
    if not samples:
        # the limit keeps everything after INFO in one piece that is never split
        parts = F.split("line", "\t", 9)
        cut = body.select(F.array_join(F.slice(parts, 1, 8), "\t").alias("line"))
        return WithHeader(fields_frame(cut, VCF_COLUMNS), header)
    names = header.where(F.col("line").startswith("#CHROM")).select("line").distinct().limit(2).collect()
    if len(names) != 1:
        raise ValueError("the files name no columns, or not the same ones")
    extra = names[0]["line"].split("\t")[8:]
    return WithHeader(fields_frame(body, VCF_COLUMNS + [(n, "string") for n in extra]), header)


def read_gff(spark: SparkSession, path: str) -> WithHeader:
    """GFF3 / GTF features; ``#`` lines anywhere are kept apart and ``##FASTA`` ends a file."""
    lines = ordered_lines(spark, path).withColumn("line", without_return(F.col("line")))
    cut = lines.where("line = '##FASTA'").groupBy("file").agg(F.min("at").alias("_cut"))
    kept = lines.join(small_side(cut), "file", "left").where("_cut IS NULL OR at < _cut").drop("_cut")
    comment = F.col("line").startswith("#")
    body = kept.where(~comment & (F.col("line") != "")).select("line")
    return WithHeader(fields_frame(body, GFF_COLUMNS), kept.where(comment))


def read_sam(spark: SparkSession, path: str) -> WithHeader:
    """Alignment text: the 11 columns, and ``optional``: the fields after them as an array."""
    header, body = _split_header(spark, path, "@")
    # a read name may start with @; a header line has a two-letter record type after it
    mark = F.col("line").rlike(r"^@(HD|SQ|RG|PG|CO)(\t|$)")
    body = _body(spark, path, mark)
    return WithHeader(fields_frame(body, SAM_COLUMNS, nulls=("",), rest="optional"), header.where(mark))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Mapping text: the 12 columns, and ``optional``: the fields after them as an array."""
    return fields_frame(_body(spark, path, F.lit(False)), PAF_COLUMNS, nulls=("",), rest="optional")


def read_mpileup(spark: SparkSession, path: str) -> DataFrame:
    """Pileup text; with several samples the columns carry the suffixes _1, _2 …"""
    lines = _body(spark, path, F.lit(False))
    widest = lines.select(F.size(plain_fields(F.col("line"))).alias("n")).agg(F.max("n")).first()[0] or 6
    samples = max((widest - 3) // 3, 1)
    columns = [("chrom", "string"), ("pos", "long"), ("ref", "string")]
    for i in range(1, samples + 1):
        suffix = f"_{i}" if samples > 1 else ""
        columns += [(f"depth{suffix}", "long"), (f"bases{suffix}", "string"), (f"quals{suffix}", "string")]
    return fields_frame(lines, columns, nulls=("",))


def header_contigs(source: WithHeader) -> DataFrame:
    """name and length of the sequences a header declares (``##contig`` or ``@SQ``)."""
    line = F.col("line")
    vcf = line.startswith("##contig=<")
    name = F.when(vcf, F.regexp_extract(line, r"[<,]ID=([^,>]+)", 1)).otherwise(
        F.regexp_extract(line, r"\tSN:([^\t]+)", 1)
    )
    size = F.when(vcf, F.regexp_extract(line, r"[<,]length=(\d+)", 1)).otherwise(
        F.regexp_extract(line, r"\tLN:(\d+)", 1)
    )
    kept = source.header.where(vcf | line.startswith("@SQ"))
    return kept.select(name.alias("name"), size.try_cast("long").alias("length")).where("name <> ''").distinct()


def _matrix_head(lines: DataFrame) -> tuple[list[str], str, int, tuple[int, int, int]]:
    """Words of the banner, its file, the place of the size line there, and the sizes.

    A matrix split over several files has its banner and size line in one of them.
    """
    top = lines.where(F.col("line").startswith("%%MatrixMarket")).limit(1).collect()
    if not top:
        raise ValueError("no %%MatrixMarket line")
    file = top[0]["file"]
    first = (
        lines.where((F.col("file") == file) & ~F.col("line").startswith("%") & (F.trim("line") != ""))
        .orderBy("line_no")
        .limit(1)
        .collect()
    )
    if not first:
        raise ValueError("no size line")
    sizes = tuple(int(x) for x in first[0]["line"].split())
    return top[0]["line"].lower().split(), file, first[0]["line_no"], sizes


def read_matrix_market(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Coordinate entries as 0-based (row, col, value); pattern matrices have no value.

    ``check`` counts the entries and their range against the size line in one pass.
    """
    lines = text_lines(spark, path)
    banner, file, size_at, (n_rows, n_cols, n_entries) = _matrix_head(lines)
    _, kind, layout, field, symmetry = banner
    if (kind, layout, symmetry) != ("matrix", "coordinate", "general"):
        raise ValueError(f"cannot read a {kind} {layout} {symmetry} matrix")
    head = (F.col("file") == file) & (F.col("line_no") <= size_at)
    body = lines.where(~F.col("line").startswith("%") & (F.trim("line") != "") & ~head)
    parts = F.split(F.trim("line"), r"\s+")
    value = [] if field == "pattern" else [F.get(parts, F.lit(2)).try_cast("double").alias("value")]
    entries = body.select(
        (F.get(parts, F.lit(0)).try_cast("long") - 1).alias("row"),
        (F.get(parts, F.lit(1)).try_cast("long") - 1).alias("col"),
        *value,
    )
    if check:
        inside = F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1)
        found, good = entries.agg(F.count("*"), F.count(F.when(inside, 1))).first()
        if found != n_entries:
            raise ValueError(f"the size line says {n_entries} entries, the file has {found}")
        if good != found:
            raise ValueError(f"{found - good} entries lie outside {n_rows} x {n_cols}")
    return entries


def matrix_market_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and entries of the size line."""
    return _matrix_head(text_lines(spark, path))[3]


def _labels(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split("line", "\t")
    columns = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return text_lines(spark, path).where("line <> ''").select(F.col("line_no").alias("index"), *columns)


def read_tenx(spark: SparkSession, matrix: str, features: str, barcodes: str) -> dict[str, DataFrame]:
    """A 10x directory as tables: matrix (labelled entries), features, barcodes.

    Which side is which comes from the shape; a shape that fits neither way is an error.
    """
    from ..operators.labels import label_entries

    named = _labels(spark, features, ["feature_id", "feature_name", "feature_type"])
    cells = _labels(spark, barcodes, ["barcode"])
    shape = matrix_market_shape(spark, matrix)[:2]
    sizes = (named.count(), cells.count())
    if shape not in (sizes, sizes[::-1]):
        raise ValueError(f"a matrix of {shape[0]} x {shape[1]} does not fit {sizes[0]} features and {sizes[1]} barcodes")
    row, col = ("row", "col") if shape == sizes else ("col", "row")
    entries = read_matrix_market(spark, matrix)
    return {"matrix": label_entries(entries, named, cells, row, col), "features": named, "barcodes": cells}


_SETTING = r"(?:^|\s){}=(\S+)"


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    """Wiggle text as bedGraph rows: Chr, [Beg, End), value, 0-based half-open.

    A declaration line applies to the lines after it: it is carried forward, and the lines since it are
    counted, by one blockwise scan over line numbers, so one large file is not one task.
    """
    lines, _, tasks = lines_by_file_number(spark, path)
    lines = lines.withColumn("line", F.trim(without_return(F.col("line"))))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(#|track(\s|$)|browser(\s|$))"))
    declared = F.col("line").rlike("^(fixedStep|variableStep)")
    data = ~declared
    scanned = prefix_scan(
        lines,
        ["file_no"],
        "line_no",
        {
            "_decl": ("last", F.when(declared, F.col("line"))),
            "_nth": ("since", (declared, data.cast("long"))),
        },
        tasks=tasks,
    ).where(data)
    decl = F.col("_decl")
    get = lambda name, default: F.coalesce(
        F.regexp_extract(decl, _SETTING.format(name), 1).try_cast("long"), F.lit(default)
    )
    fixed = decl.startswith("fixedStep")
    parts = F.split("line", r"\s+")
    nth = F.col("_nth") - 1
    begin = F.when(fixed, get("start", 1) - 1 + get("step", 1) * nth).otherwise(
        F.get(parts, F.lit(0)).try_cast("long") - 1
    )
    value = F.when(fixed, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))).try_cast("double")
    return scanned.select(
        F.regexp_extract(decl, _SETTING.format("chrom"), 1).alias("Chr"),
        begin.alias("[Beg"),
        (begin + get("span", 1)).alias("End)"),
        value.alias("value"),
    )


def read_alignment_blocks(spark: SparkSession, path: str) -> DataFrame:
    """UCSC MAF: a row per ``s`` line with block, score, src, start, size, strand, srcSize, text.

    The block number counts the ``a`` lines so far in the file.
    """
    lines, files, tasks = lines_by_file_number(spark, path)
    lines = lines.withColumn("line", F.trim(without_return(F.col("line"))))
    opens = F.col("line").rlike(r"^a(\s|$)")
    kept = lines.where(opens | F.col("line").rlike(r"^s\s"))
    score = F.regexp_extract("line", r"score=(\S+)", 1).try_cast("double")
    scanned = prefix_scan(
        kept,
        ["file_no"],
        "line_no",
        {
            "block": ("sum", opens.cast("long")),
            "_a": ("last", F.when(opens, F.struct(score.alias("score")))),
        },
        tasks=tasks,
    ).where(~opens)
    p = F.split("line", r"\s+")
    get = lambda i: F.get(p, F.lit(i))
    return lookup_join(scanned, files, ["file_no"]).select(
        "file",
        "line_no",
        F.col("block"),
        F.col("_a.score").alias("score"),
        get(1).alias("src"),
        get(2).try_cast("long").alias("start"),
        get(3).try_cast("long").alias("size"),
        get(4).alias("strand"),
        get(5).try_cast("long").alias("srcSize"),
        get(6).alias("text"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq: one row per record, split by Spark at record starts.

    For sequences as long as chromosomes use :func:`read_fasta_blocks`.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select(
        F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("r")
    )
    head = F.substring_index("r", "\n", 1)
    body = F.when(F.instr("r", "\n") > 0, F.substring(F.col("r"), F.length(head) + 2, F.length("r"))).otherwise("")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    comment = F.regexp_extract(head, r"^\S*\s+(.*)$", 1)
    return text.where(F.trim("r") != "").select(
        name.alias("name"),
        F.when(comment != "", comment).alias("comment"),
        F.regexp_replace(body, r"\s", "").alias("seq"),
    )


def read_fasta_blocks(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """(name, block, bases): sequences in pieces of ``width`` bases; no row holds a sequence.

    The name is carried to the lines after it and the offset of a line is the sum of lengths since the
    name, both in one blockwise scan over line numbers; a line that crosses a piece border is cut there.
    """
    lines = text_lines(spark, path).withColumn("line", F.trim(without_return(F.col("line"))))
    head = F.col("line").startswith(">")
    name = F.when(head, F.regexp_extract("line", r"^>(\S*)", 1))
    size = F.when(head, F.lit(0)).otherwise(F.length("line")).cast("long")
    scanned = prefix_scan(lines, ["file"], "line_no", {"name": ("last", name), "_through": ("since", (head, size))})
    scanned = scanned.where(~head & (F.col("line") != ""))
    offset = F.col("_through") - F.length("line")
    cut = scanned.select("name", "line", offset.alias("at")).withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.length("line") - 1) / width))),
    )
    low = F.greatest(F.col("block") * width - F.col("at"), F.lit(0))
    high = F.least((F.col("block") + 1) * width - F.col("at"), F.length("line").cast("long"))
    piece = F.substring(F.col("line"), (low + 1).cast("int"), (high - low).cast("int"))
    parts = cut.select("name", "block", F.struct("at", piece.alias("bases")).alias("part"))
    # a group holds width bases at most
    joined = parts.groupBy("name", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return joined.select("name", "block", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual of four-line records; unequal lengths are an error."""
    lines, files, tasks = lines_by_file_number(spark, path)
    lines = lines.withColumn("line", without_return(F.col("line")))
    slot = F.pmod("line_no", F.lit(4))
    part = lambda i: F.max(F.when(F.col("slot") == i, F.col("line")))
    records = (
        lines.select("file_no", F.floor(F.col("line_no") / 4).alias("record"), slot.cast("byte").alias("slot"), "line")
        .repartition(tasks, "file_no", "record")
        .groupBy("file_no", "record")
        .agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
        .where("head <> ''")
    )
    # a filter, which stays in the plan whatever columns are read
    sound = (
        F.col("head").startswith("@")
        & F.coalesce(F.col("plus").startswith("+"), F.lit(False))
        & (F.length("seq") == F.coalesce(F.length("qual"), F.lit(-1)))
    )
    problem = F.raise_error(F.concat(F.lit("malformed record: "), F.col("head")))
    comment = F.regexp_extract("head", r"^\S*\s+(.*)$", 1)
    checked = records.where(F.when(sound, F.lit(True)).otherwise(problem.cast("boolean")))
    return lookup_join(checked, files, ["file_no"]).select(
        "file",
        "record",
        F.regexp_extract("head", r"^@(\S*)", 1).alias("name"),
        F.when(comment != "", comment).alias("comment"),
        "seq",
        "qual",
    )
