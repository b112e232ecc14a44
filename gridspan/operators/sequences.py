"""Sequence and alignment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.scan import prefix_scan
from ..plans.spread import spread
from ..session import settle
from .select import require

_GAPS = "-.~"


def _letters(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def n50(lengths: DataFrame, column: str) -> DataFrame:
    """The largest L such that records of length at least L hold half of the total.

    Rows are grouped to one per distinct length first; the running sum over those is cut into
    blocks.
    """
    grouped = lengths.groupBy(F.col(column).cast("long").alias("len")).agg(F.count("*").alias("n"))
    return _n50_of(grouped)


def _n50_of(grouped: DataFrame) -> DataFrame:
    """The same from (len, n) rows, one per length."""
    grouped = grouped.where("len > 0").select("len", "n", F.lit(0).alias("all"))
    total = grouped.agg(F.sum(F.col("len") * F.col("n"))).scalar()
    scanned = prefix_scan(grouped, ["all"], "len", {"_below": ("sum_before", F.col("len") * F.col("n"))})
    return scanned.where(2 * F.col("_below") <= total).agg(F.max("len").alias("n50"))


def seq_stats(df: DataFrame, seq: str = "seq", qual: str | None = None) -> DataFrame:
    """One row: format, type, num_seqs, sum/min/avg/max length, n50, gc, q20 and q30 percent.

    Letters are counted per row and summed per length in the only pass over the data; the rest
    is taken from that histogram of lengths. With more than a tenth of the letters outside
    A C G T U N the type is Protein, with U and no T RNA, else DNA. GC is over A C G T U, null
    for protein.
    """
    require(df, seq, *([qual] if qual else []))
    narrow = df.select(F.upper(f"`{seq}`").alias("s"), *([F.col(f"`{qual}`").alias("q")] if qual else []))
    parts = [F.count("*").alias("records")]
    for letter in "ACGTUN":
        without = F.length(F.replace(F.col("s"), F.lit(letter), F.lit("")))
        parts.append(F.sum((F.col("len") - without).cast("long")).alias(letter))
    if qual:
        # characters above 19 and 29 are Phred 20 and 30 on the +33 scale
        for name, low in (("all", 33), ("q20", 53), ("q30", 63)):
            kept = F.regexp_replace("q", f"[^\\x{low:02x}-\\x{{ff}}]", "")
            parts.append(F.sum(F.length(kept).cast("long")).alias(f"_{name}"))
    sized = spread(narrow.where("s IS NOT NULL")).withColumn("len", F.length("s").cast("long"))
    # one row per length, read by both reports below
    by_length = settle(sized.groupBy("len").agg(*parts))
    sums = [F.sum(c).alias(c) for c in by_length.columns if c not in ("len", "records")]
    whole = by_length.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("num_seqs"),
        F.sum(F.col("len") * F.col("records")).alias("total"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        *sums,
    )
    acgtu = F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.col("U")
    residues = F.col("total")
    protein = (residues - acgtu - F.col("N")) * 10 > residues
    kind = F.when(protein, "Protein").when((F.col("U") > 0) & (F.col("T") == 0), "RNA").otherwise("DNA")
    share = lambda part, all_: F.when(F.col(all_) > 0, 100.0 * F.col(part) / F.col(all_))
    none = F.lit(None).cast("double")
    return whole.select(
        F.lit("FASTQ" if qual else "FASTA").alias("format"),
        kind.alias("type"),
        "num_seqs",
        F.coalesce("total", F.lit(0)).alias("sum_len"),
        "min_len",
        (F.col("total") / F.col("num_seqs")).alias("avg_len"),
        "max_len",
        _n50_of(by_length.select("len", F.col("records").alias("n"))).scalar().alias("n50"),
        F.when(~protein & (acgtu > 0), 100.0 * (F.col("G") + F.col("C")) / acgtu).alias("gc_pct"),
        (share("_q20", "_all") if qual else none).alias("q20_pct"),
        (share("_q30", "_all") if qual else none).alias("q30_pct"),
    )


def alignment_stats(df: DataFrame, block: str, position: str, text: str = "text") -> DataFrame:
    """Append length, gaps and identity percent to the first sequence of the block.

    Identity is over the columns where neither has a gap, to one decimal, null when there is
    none. The first text of a block is found by a partial aggregation and joined back, so a
    block with most of the rows is never one task.
    """
    require(df, block, position, text)
    t = F.col(f"`{text}`")
    firsts = df.where(F.col(block).isNotNull()).groupBy(block).agg(F.min_by(t, F.col(position)).alias("_ref"))
    joined = lookup_join(df, firsts, [block])
    gaps = _letters(t, _GAPS)
    same = F.zip_with(
        F.split(F.upper(t), ""),
        F.split(F.upper("_ref"), ""),
        lambda a, b: F.when(
            (a != "") & (b != "") & ~a.isin(*_GAPS) & ~b.isin(*_GAPS), (a == b).cast("int")
        ),
    )
    both = F.filter(same, lambda x: x.isNotNull())
    agree = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x)
    identity = F.when(F.size(both) > 0, F.floor(1000.0 * agree / F.size(both) + 0.5) / 10)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.length(t) - gaps).cast("long").alias("length"),
        gaps.alias("gaps"),
        identity.alias("identity"),
    )


def alphabet(df: DataFrame, text: str = "text") -> DataFrame:
    """nucleotide or protein, by the share of letters outside A C G T U N, gaps left out."""
    t = F.translate(F.col(f"`{text}`"), _GAPS, "")
    counted = df.agg(
        F.sum(F.length(t).cast("long")).alias("all"), F.sum(_letters(t, "ACGTUNacgtun")).alias("nuc")
    )
    kind = F.when(F.col("all") == 0, "").when((F.col("all") - F.col("nuc")) * 10 > F.col("all"), "protein")
    return counted.select(F.when(F.col("all").isNotNull(), kind.otherwise("nucleotide")).alias("alphabet"))
