"""Pileup columns: decoding packed cells, and piling up aligned reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, member_join
from ..plans.spread import spread
from ..session import settle
from .filter import SAM_FLAGS
from .select import require

COUNTS = ("A", "C", "G", "T", "N", "del_placeholder", "ins", "del", "fwd", "rev", "mean_qual")


def _count(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    kept = F.translate(text, letters, "")
    return (F.length(text) - F.length(kept)).cast("long")


def _decoded(bases: Column, quals: Column, ref: Column) -> dict[str, Column]:
    """Counts of one packed cell.

    Read starts with their mapping quality and read ends are dropped, then the cell is split
    before each indel, whose length says how many of the letters that follow belong to it. What
    is left is one symbol per quality character.
    """
    symbols = F.regexp_replace(F.coalesce(bases, F.lit("")), r"(?s)\^.|\$", "")
    pieces = F.split(symbols, r"(?=[+-])")
    size = lambda p: F.coalesce(F.regexp_extract(p, r"^[+-](\d+)", 1).try_cast("int"), F.lit(0))
    sign = lambda p: F.length(F.regexp_extract(p, r"^[+-]\d*", 0))
    rest = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike("^[+-]"), F.substring(p, sign(p) + size(p) + 1, F.length(p))
        ).otherwise(p),
    )
    return {
        "symbols": F.array_join(rest, ""),
        "ins": F.size(F.filter(pieces, lambda p: p.startswith("+"))).cast("long"),
        "del": F.size(F.filter(pieces, lambda p: p.startswith("-"))).cast("long"),
        "quals": F.coalesce(quals, F.lit("")),
        "ref": F.upper(ref),
    }


def _cell_counts(prefix: str) -> list[Column]:
    c = lambda name: F.col(f"{prefix}{name}")
    symbols, ref = c("symbols"), c("ref")
    matches = _count(symbols, ".,")
    letters = _count(symbols, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    counts, named = [], F.lit(0).cast("long")
    for base in "ACGT":
        n = _count(symbols, base + base.lower()) + F.when(ref == base, matches).otherwise(0)
        named = named + n
        counts.append(n)
    other = letters + matches - named
    lower = _count(symbols, "abcdefghijklmnopqrstuvwxyz")
    rev = lower + _count(symbols, ",")
    # only bases count towards the mean; placeholders and skips still use up their character
    scores = F.zip_with(
        F.split(symbols, ""),
        F.split(c("quals"), ""),
        lambda s, q: F.when(s.rlike("[.,A-Za-z]") & (q != ""), F.ascii(q) - 33),
    )
    scored = F.filter(scores, lambda x: x.isNotNull())
    total = F.aggregate(scored, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = F.when(F.size(scored) > 0, total / F.size(scored))
    return [
        *counts, other, _count(symbols, "*"), c("ins"), c("del"), letters + matches - rev, rev, mean,
    ]


def decode_pileup(df: DataFrame) -> DataFrame:
    """Append base, strand and indel counts and the mean quality of each packed sample.

    Samples are ``bases`` / ``quals`` or ``bases_1`` / ``quals_1`` …; the counts carry the same
    suffix. The mean quality is null where no base has one.
    """
    suffixes = [c[len("bases") :] for c in df.columns if re.fullmatch(r"bases(_\d+)?", c)]
    if not suffixes:
        raise ValueError("no bases column")
    require(df, "ref", *[f"quals{s}" for s in suffixes])
    staged = df
    for s in suffixes:
        parts = _decoded(F.col(f"bases{s}"), F.col(f"quals{s}"), F.col("ref"))
        staged = staged.withColumns({f"_d{s}_{k}": v for k, v in parts.items()})
    out = []
    for s in suffixes:
        out += [v.alias(f"{n}{s}") for n, v in zip(COUNTS, _cell_counts(f"_d{s}_"), strict=True)]
    return staged.select(*[F.col(f"`{c}`") for c in df.columns], *out)


# Positions of a bin, as a power of two, and pieces of reads in one task.
_BIN_BITS, _TASK_PIECES = 10, 250_000
_ABLE = "_which IS NOT NULL AND _name IS NOT NULL"

_UNUSABLE = SAM_FLAGS["UNMAP"] | SAM_FLAGS["SECONDARY"] | SAM_FLAGS["QCFAIL"] | SAM_FLAGS["DUP"]


def read_bases(
    reads: DataFrame,
    min_mapq: int = 0,
    min_baseq: int = 13,
    exclude: int = _UNUSABLE,
    require_flags: int = 0,
    count_orphans: bool = False,
    mates_once: bool = True,
) -> DataFrame:
    """One row per read and reference position it covers.

    Columns: chrom, pos (1-based), symbol (a letter, ``*`` where deleted, ``>`` where skipped),
    score (null without qualities), shown (whether the score reaches ``min_baseq``), reverse,
    inserted (the letters that follow here) and deleted (how many bases are missing after it),
    mapq, head and tail (first and last position of the read), read. A deleted or skipped
    position has the score of the next base of the read. The CIGAR is walked by array
    expressions; each read is cut by itself.

    With ``mates_once`` two mates that overlap give one base where both have one: of equal bases the mate
    that begins first (the first of the pair, if both begin at once) gets the sum of both scores, at most
    200, of different ones the better gets four fifths of its score, and the other's score is 0. A mate is
    aligned with the other's steps, so no position meets its reads for this. Mates are the two reads of a
    name on one chromosome that are flagged as a proper pair, each there once, with bases and scores.
    """
    steps, paired_up = _read_steps(reads, min_mapq, exclude, require_flags, count_orphans, mates_once)
    return _bases(steps, min_baseq, paired_up)


def _read_steps(
    reads: DataFrame,
    min_mapq: int = 0,
    exclude: int = _UNUSABLE,
    require_flags: int = 0,
    count_orphans: bool = False,
    mates_once: bool = True,
) -> tuple[DataFrame, bool]:
    """One row per step of a read that has positions, with just its letters and scores; and whether any read has a mate."""
    require(reads, "QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "SEQ", "QUAL")
    flag = F.col("FLAG").cast("long")
    kept = reads.where(
        (flag.bitwiseAND(F.lit(exclude)) == 0)
        & (flag.bitwiseAND(F.lit(require_flags)) == require_flags)
        & (F.col("MAPQ").cast("int") >= min_mapq)
        & (F.col("RNAME") != "*")
        & (F.col("CIGAR") != "*")
    )
    if not count_orphans:
        paired, proper = SAM_FLAGS["PAIRED"], SAM_FLAGS["PROPER_PAIR"]
        kept = kept.where(flag.bitwiseAND(F.lit(paired | proper)) != paired)
    op = r"(\d+)([MIDNSHP=X])"
    base_kinds = ("M", "=", "X")
    narrow = kept.select(
        F.col("RNAME").alias("chrom"),
        F.col("POS").cast("long").alias("_at"),
        F.upper("SEQ").alias("_seq"),
        F.when(F.col("QUAL") != "*", F.col("QUAL")).alias("_qual"),
        F.col("MAPQ").cast("int").alias("mapq"),
        flag.alias("_flag"),
        F.col("QNAME").alias("_name"),
        F.col("CIGAR").alias("_cigar"),
        _which_mate(kept).alias("_which"),
    )
    paired_up = mates_once and not narrow.where(_ABLE).isEmpty()
    # reads are met by their mates before they are cut, so that they travel with no more than their lines hold
    narrow = _with_mates(narrow) if paired_up else spread(narrow).withColumn("_mate", F.lit(None).cast("struct<at: long>"))
    sizes = lambda text: F.regexp_extract_all(text, F.lit(op), F.lit(1)).cast("array<int>")
    kinds = lambda text: F.regexp_extract_all(text, F.lit(op), F.lit(2))
    span = lambda k, n: F.aggregate(_consumed(F.col(k), F.col(n), "MDN=X"), F.lit(0), lambda a, n: a + n)
    narrow = narrow.withColumns({"_n": sizes("_cigar"), "_k": kinds("_cigar")})
    if paired_up:
        narrow = narrow.withColumns({"_mn": sizes("_mate.cigar"), "_mk": kinds("_mate.cigar")})
        offsets = _offsets(F.col("_mk"), F.col("_mn"))
        mate = F.struct("_mate.at", "_mate.seq", "_mate.qual", F.arrays_zip(F.col("_mk").alias("k"), F.col("_mn").alias("n"), *offsets).alias("steps"))
        meet = F.greatest("_at", "_mate.at") < F.least(F.col("_at") + span("_k", "_n"), F.col("_mate.at") + span("_mk", "_mn"))
        narrow = narrow.withColumn("_mate", F.when(meet, mate))
    arrays = F.arrays_zip("_k", "_n", *_offsets(F.col("_k"), F.col("_n")), *_following(F.col("_k"), F.col("_n")))
    placed = narrow.select(
        "chrom", "_at", "_seq", "_qual", "mapq", "_flag", "_name", "_mate", "_which", span("_k", "_n").alias("_span"), F.inline(arrays)
    )
    base = F.col("_k").isin(*base_kinds)
    follows = F.col("q") + F.col("_n")
    piece = lambda c, start, n: F.substring(F.col(c), start + 1, n)
    fill = lambda mark, n: F.call_function("repeat", mark, n)
    letters = lambda start, n: F.when(F.col("_seq") == "*", fill(F.lit("N"), n)).otherwise(
        F.rpad(piece("_seq", start, n), n, F.lit("N"))
    )
    mark = F.when(F.col("_k") == "D", "*").otherwise(">")
    none = F.lit(None).cast("binary")
    # bytes have their places, so that a letter is taken without a look at those before it
    steps = placed.where(F.col("_k").isin("M", "D", "N", "=", "X") & (F.col("_n") > 0)).select(
        "chrom",
        (F.col("_at") + F.col("r")).alias("_first"),
        (F.col("_flag").bitwiseAND(F.lit(SAM_FLAGS["REVERSE"])) != 0).alias("reverse"),
        "mapq",
        F.struct(F.col("_at").alias("start"), F.col("_name").alias("name"), F.col("_flag").alias("flag")).alias("read"),
        (F.col("r") == 0).alias("_opens"),
        (F.col("r") + F.col("_n") == F.col("_span")).alias("_closes"),
        F.when(base, letters(F.col("q"), F.col("_n"))).otherwise(fill(mark, F.col("_n"))).cast("binary").alias("_s"),
        F.when(base, F.coalesce(piece("_qual", F.col("q"), F.col("_n")), F.lit("")))
        .otherwise(fill(F.coalesce(piece("_qual", F.col("q"), F.lit(1)), F.lit("")), F.col("_n")))
        .cast("binary")
        .alias("_c"),
        F.col("_qual").isNotNull().alias("_scored"),
        (F.col("_n") - 1).alias("_last"),
        F.when(base & (F.col("after") == "I"), letters(follows, F.col("length"))).alias("_ins"),
        F.when(base & (F.col("after") == "D"), F.col("length")).otherwise(0).alias("_del"),
        *[
            (F.when(base & F.col("_mate").isNotNull(), _beside(text)).cast("binary") if paired_up else none).alias(name)
            for name, text in (("_ms", "seq"), ("_mc", "qual"))
        ],
        (_leads() if paired_up else F.lit(False)).alias("_leads"),
    )
    return steps, paired_up


def _pieces(steps: DataFrame) -> DataFrame:
    """Steps cut where a bin of positions ends, with the ``_bin`` of each piece.

    Pieces that are dealt by chromosome and bin meet all others of their positions in one task, whatever the
    order of the reads in the source.
    """
    width = 1 << _BIN_BITS
    last = F.col("_first") + F.col("_last")
    binned = steps.select("*", F.explode(F.sequence(F.shiftright("_first", _BIN_BITS), F.shiftright(last, _BIN_BITS))).alias("_bin"))
    low = F.greatest(F.col("_bin") * width - F.col("_first"), F.lit(0)).cast("int")
    n = F.least((F.col("_bin") + 1) * width - F.col("_first"), F.col("_last") + F.lit(1)).cast("int") - low
    ends = low + n > F.col("_last")
    cut = {c: F.substring(F.col(c), low + 1, n) for c in ("_s", "_c", "_ms", "_mc")}
    cut |= {"_opens": F.col("_opens") & (low == 0), "_closes": F.col("_closes") & ends, "_ins": F.when(ends, F.col("_ins"))}
    cut |= {"_del": F.when(ends, F.col("_del")).otherwise(0), "_first": F.col("_first") + low, "_last": n - 1}
    return binned.select("_bin", *[cut[c].alias(c) if c in cut else F.col(c) for c in steps.columns])


def _bases(steps: DataFrame, min_baseq: int, paired_up: bool, *keep: str) -> DataFrame:
    """One row per position of each step."""
    each = steps.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_i"))
    final = F.col("_i") == F.col("_last")
    at = lambda c: F.substring(F.col(c), F.col("_i") + 1, F.lit(1)).cast("string")
    # a base past the end of the qualities counts as 0
    score = F.greatest(F.ascii(F.coalesce(at("_c"), F.lit(""))) - 33, F.lit(0))
    if paired_up:
        other = F.greatest(F.ascii(at("_mc")) - 33, F.lit(0))
        equal = F.when(F.col("_leads"), F.least(score + other, F.lit(200))).otherwise(0)
        better = (score > other) | ((score == other) & F.col("_leads"))
        unlike = F.when(better, F.floor(score * F.lit(4) / F.lit(5)).cast("int")).otherwise(0)
        met = F.col("_ms").isNotNull() & (at("_ms") != " ")
        score = F.when(met, F.when(at("_ms") == at("_s"), equal).otherwise(unlike)).otherwise(score)
    return each.select(
        *keep,
        "chrom",
        (F.col("_first") + F.col("_i")).alias("pos"),
        at("_s").alias("symbol"),
        F.when(F.col("_scored"), score).alias("score"),
        (~F.col("_scored") | (score >= min_baseq)).alias("shown"),
        "reverse",
        F.when(final, F.col("_ins")).alias("inserted"),
        F.when(final, F.col("_del")).otherwise(0).alias("deleted"),
        "mapq",
        (F.col("_opens") & (F.col("_i") == 0)).alias("head"),
        (F.col("_closes") & final).alias("tail"),
        "read",
    )


def _which_mate(reads: DataFrame) -> Column:
    """1 or 2 for a read of a proper pair whose mate is on its chromosome; null for others."""
    flag = F.col("FLAG").cast("long")
    bits = lambda *names: sum(SAM_FLAGS[n] for n in names)
    pair = flag.bitwiseAND(F.lit(bits("PAIRED", "PROPER_PAIR", "MUNMAP", "SECONDARY", "SUPPLEMENTARY"))) == bits("PAIRED", "PROPER_PAIR")
    if "RNEXT" in reads.columns:
        pair = pair & F.col("RNEXT").isin("=") | pair & (F.col("RNEXT") == F.col("RNAME"))
    which = flag.bitwiseAND(F.lit(bits("READ1", "READ2")))
    known = (F.col("SEQ") != "*") & (F.col("QUAL") != "*")
    return F.when(pair & known, F.when(which == bits("READ1"), 1).when(which == bits("READ2"), 2))


def _with_mates(narrow: DataFrame) -> DataFrame:
    """Adds ``_mate``: the other read of a pair, as its line has it.

    The first and the second reads are joined by name, each read shuffled once. Names with several reads of a
    side are in no pair; they are told before by counts of hashed names, those of unlucky hashes by name, so a
    frequent name meets nothing.
    """
    key = ["chrom", "_name"]
    able = narrow.where(_ABLE)
    hashed = able.select(*key, "_which", F.xxhash64(*key).alias("_hash"))
    often = settle(hashed.groupBy("_hash", "_which").count().where("count > 1").select("_hash").distinct())
    fields = [c for c in narrow.columns if c not in key]
    once, pieces = able, [narrow.where(f"NOT ({_ABLE})")]
    if not often.isEmpty():
        named = member_join(hashed, often, ["_hash"], True).groupBy(*key, "_which").count()
        often = settle(named.where("count > 1").select(*key).distinct())
        once = member_join(able, often, key, False)
        pieces.append(member_join(able, often, key, True).select(*narrow.columns))
    side = lambda which, name: once.where(F.col("_which") == which).select(*key, F.struct(*fields).alias(name))
    both = side(1, "_a").join(side(2, "_b"), key, "full_outer")
    mate = lambda r: F.when(
        F.col(r).isNotNull(), F.struct(F.col(f"{r}._at").alias("at"), F.col(f"{r}._seq").alias("seq"), F.col(f"{r}._qual").alias("qual"), F.col(f"{r}._cigar").alias("cigar"))
    ).alias("_mate")
    pair = F.array(F.struct(F.col("_a").alias("_r"), mate("_b")), F.struct(F.col("_b").alias("_r"), mate("_a")))
    met = both.select(*key, F.inline(F.filter(pair, lambda x: x["_r"].isNotNull()))).select(*key, "_r.*", "_mate").select(*narrow.columns, "_mate")
    kind = met.schema["_mate"].dataType
    for piece in pieces:
        met = met.unionByName(piece.withColumn("_mate", F.lit(None).cast(kind)))
    return met


def _leads() -> Column:
    """Whether the read, not its mate, shows the bases that both have."""
    return F.coalesce((F.col("_at") < F.col("_mate.at")) | ((F.col("_at") == F.col("_mate.at")) & (F.col("_which") == 1)), F.lit(False))


def _beside(text: str) -> Column:
    """What the mate has at the positions of a step, a letter or a score each, with blanks where it has none."""
    first, size, mate = F.col("_at") + F.col("r"), F.col("_n"), F.col("_mate")
    blanks = lambda n: F.call_function("repeat", F.lit(" "), n.cast("int"))

    def part(s: Column) -> Column:
        begin = mate["at"] + s["r"]
        low, high = F.greatest(begin, first), F.least(begin + s["n"], first + size)
        n = F.greatest(high - low, F.lit(0))
        letters = F.rpad(F.substring(mate[text], (s["q"] + low - begin + 1).cast("int"), n.cast("int")), n.cast("int"), F.lit(" "))
        return F.when(s["k"].isin("M", "=", "X") & (n > 0), letters).when(s["k"].isin("D", "N"), blanks(n)).otherwise("")

    before = blanks(F.greatest(F.least(mate["at"], first + size) - first, F.lit(0)))
    return F.rpad(F.concat(before, F.array_join(F.transform(mate["steps"], part), "")), size, F.lit(" "))


def _consumed(kinds: Column, sizes: Column, letters: str) -> Column:
    """The length of each step that uses up bases of one side, 0 for the others."""
    return F.zip_with(kinds, sizes, lambda k, n: F.when(F.instr(F.lit(letters), k) > 0, n).otherwise(0))


def _offsets(kinds: Column, sizes: Column) -> tuple[Column, Column]:
    """Where each step starts in the reference (r) and in the read (q): sums of the steps before."""

    def before(consuming: str) -> Column:
        used = _consumed(kinds, sizes, consuming)
        none = F.array(F.lit(0))
        sums = F.aggregate(used, none, lambda a, n: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + n)))
        return F.slice(sums, 1, F.size(kinds))

    return before("MDN=X").alias("r"), before("MIS=X").alias("q")


def _following(kinds: Column, sizes: Column) -> tuple[Column, Column]:
    """Kind and length of the step after each step, null after the last."""
    return (
        F.slice(kinds, 2, F.greatest(F.size(kinds), F.lit(1))).alias("after"),
        F.slice(sizes, 2, F.greatest(F.size(sizes), F.lit(1))).alias("length"),
    )


def pileup(reads: DataFrame, **filters) -> DataFrame:
    """Depth, base, strand and indel counts and mean quality per covered position.

    Counted in the map-side aggregation, so a deep position never collects its reads. Mates that overlap
    count once, unless ``mates_once`` is false. A position all of whose bases fall below the quality bound stays, with
    depth 0. Pieces of reads are dealt by their place before they become bases, so that the aggregation finds the bases
    of a position together; a place with many is dealt out to several tasks. ``filters`` are those of :func:`read_bases`.
    """
    min_baseq = filters.pop("min_baseq", 13)
    steps, paired_up = _read_steps(reads, **filters)
    near = _pieces(steps).hint("rebalance", F.col("chrom"), F.col("_bin"))
    cells = _bases(near, min_baseq, paired_up)
    s, shown = F.col("symbol"), F.col("shown")
    base = s.rlike("^[A-Z=]$")
    count = lambda test: F.count(F.when(test & shown, 1))
    return cells.groupBy("chrom", "pos").agg(
        F.count(F.when(shown, 1)).alias("depth"),
        *[count(s == b).alias(b) for b in "ACGT"],
        count(base & ~s.isin(*"ACGT")).alias("N"),
        count(s == "*").alias("del_placeholder"),
        count(F.col("inserted").isNotNull()).alias("ins"),
        count(F.col("deleted") > 0).alias("del"),
        count(base & ~F.col("reverse")).alias("fwd"),
        count(base & F.col("reverse")).alias("rev"),
        F.avg(F.when(base & shown, F.coalesce("score", F.lit(0)))).alias("mean_qual"),
    )


def pileup_text(reads: DataFrame, share: int = 4000, **filters) -> DataFrame:
    """chrom, pos, ref (N), part, depth, bases and quals, as pileup text without a reference.

    Reads are in order of start, name and flag. A position deeper than ``share`` is written in
    several parts, so that no task has to hold all of its reads; parts are numbered from 0 and
    hold the reads whose names hash to them.
    """
    min_baseq = filters.pop("min_baseq", 13)
    # who is whose mate does not matter to how many pieces a bin has
    bins = _pieces(_read_steps(reads, **{**filters, "mates_once": False})[0]).groupBy("chrom", "_bin").count()
    bins = settle(bins)
    total = bins.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    steps, paired_up = _read_steps(reads, **filters)
    pieces = _pieces(steps)
    crowded = settle(bins.where(F.col("count") > share).select("chrom", "_bin"))
    if crowded.isEmpty():
        return _written(pieces, None, total, share, min_baseq, paired_up)
    place = ["chrom", "_bin"]
    calm = member_join(pieces, crowded, place, False)
    dense = member_join(pieces, crowded, place, True)
    cells = _bases(dense, min_baseq, paired_up, "_bin").where("shown")
    deep = (
        cells.groupBy("chrom", "pos")
        .count()
        .where(F.col("count") > share)
        .select("chrom", "pos", F.ceil(F.col("count") / share).cast("int").alias("_parts"))
    )
    # the size check and the join both read it
    deep = settle(deep)
    return _written(calm, None, total, share, min_baseq, paired_up).unionByName(_written(dense, deep, total, share, min_baseq, paired_up))


def _written(pieces: DataFrame, deep: DataFrame | None, total: int, share: int, min_baseq: int, paired_up: bool) -> DataFrame:
    """The text of the positions of some pieces; none is deeper than ``share`` but those in ``deep``."""
    if deep is None:
        # whole bins go to a task, as many tasks as the pieces need; their positions are grouped where they are
        pieces = pieces.repartition(max(-(-total // _TASK_PIECES), pieces.sparkSession.sparkContext.defaultParallelism), "chrom", "_bin")
        # reads are put in order once a bin, which holds ``share`` pieces at most; their bases carry a number
        order = Window.partitionBy("chrom", "_bin").orderBy("read.start", "read.name", "read.flag")
        pieces, place = pieces.withColumn("_place", F.rank().over(order)), "_place"
    else:
        pieces, place = pieces.withColumn("_place", F.lit(0)), "read"
    cells = _bases(pieces, min_baseq, paired_up, "_bin", "_place").where("shown")
    strand = lambda text: F.when(F.col("reverse"), F.lower(text)).otherwise(text)
    symbol = F.when((F.col("symbol") == ">") & F.col("reverse"), "<").otherwise(strand(F.col("symbol")))
    gap = F.call_function("repeat", F.lit("N"), F.col("deleted"))
    text = F.concat(
        F.when(F.col("head"), F.concat(F.lit("^"), F.char(F.least("mapq", F.lit(93)) + 33))).otherwise(""),
        symbol,
        F.when(
            F.col("inserted").isNotNull(),
            F.concat(F.lit("+"), F.length("inserted").cast("string"), strand(F.col("inserted"))),
        )
        .when(F.col("deleted") > 0, F.concat(F.lit("-"), F.col("deleted").cast("string"), strand(gap)))
        .otherwise(""),
        F.when(F.col("tail"), "$").otherwise(""),
    )
    entry = F.struct(place, text.alias("text"), F.char(F.least(F.coalesce("score", F.lit(0)), F.lit(93)) + 33).alias("qual"))
    parts = cells.select("chrom", "_bin", "pos", entry.alias("entry"))
    if deep is None:
        parts = parts.withColumn("part", F.lit(0))
    else:
        spread_out = F.pmod(F.xxhash64("entry.read"), F.coalesce("_parts", F.lit(1))).cast("int")
        parts = lookup_join(parts, deep, ["chrom", "pos"]).withColumn("part", spread_out)
    grouped = parts.groupBy("chrom", "_bin", "pos", "part").agg(F.array_sort(F.collect_list("entry")).alias("e"))
    return grouped.select(
        "chrom",
        "pos",
        F.lit("N").alias("ref"),
        "part",
        F.size("e").alias("depth"),
        F.array_join(F.transform("e", lambda x: x["text"]), "").alias("bases"),
        F.array_join(F.transform("e", lambda x: x["qual"]), "").alias("quals"),
    )
