"""Phrases of two and three words by vertical partitioning of truncated suffixes.

Every word of a piece of text begins a suffix, cut off after three words. Suffixes are dealt into groups by
their leading words: one word where that word's suffixes fit the budget, two where they don't, and three where
even the pair's suffixes don't. Prefixes are gathered until a group holds about one budget. Each group builds
its subtree by itself: the sorted suffixes give the nodes of depth one to three, and the totals of the leaves
below a node are the occurrences of its phrase.
"""

from __future__ import annotations

import itertools
from array import array
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..session import settle
from .common import mix64, query, shipped, table

LEAST, SHARE, KEPT = 10, 50, 2000
# Occurrences below one prefix, and of one group's prefixes; heavier prefixes are lengthened. Where that makes fewer
# groups than these, the budget is a share of the corpus.
BUDGET, GROUPS = 1 << 20, 256
# Heavy prefixes are shipped to the tasks: of each length no more than these, or the budget is doubled.
HEAVY = 1 << 17
# Words whose suffixes a task counts together before it passes them on, and distinct words that it counts together.
BATCH, TABLE = 1 << 21, 1 << 18
_WORD_BITS = 21
_PAYLOAD = 4 << 20

# [.,;:!?\x0A-\x0D] end a piece, tabs part words, A-Z are lower-cased.
_PIECES = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Suffixes:
    """The suffixes of many texts as three columns of word numbers; number 0 stands for the end of a piece."""

    def __init__(self):
        self.ids, self.sizes = array("q"), array("q")
        self._next = itertools.count(1).__next__
        self.numbers: dict[str, defaultdict] = {}

    def add(self, lang: str, text: bytes) -> None:
        known = self.numbers.get(lang)
        if known is None:
            known = self.numbers[lang] = defaultdict(self._next)
        for piece in text.translate(_PIECES).split(b"\n"):
            words = piece.split()
            if words:
                self.sizes.append(len(words))
                self.ids.extend(map(known.__getitem__, words))

    def full(self) -> bool:
        return len(self.ids) >= BATCH

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(self.ids, np.int64) if len(self.ids) else np.zeros(0, np.int64)
        last = np.cumsum(np.frombuffer(self.sizes, np.int64)) - 1 if len(self.sizes) else np.zeros(0, np.int64)
        b, c = np.zeros_like(a), np.zeros_like(a)
        b[:-1], c[:-2] = a[1:], a[2:]
        b[last] = 0
        c[last] = 0
        c[last[last > 0] - 1] = 0
        return a, b, c

    def named(self) -> tuple[list[str], np.ndarray, list[bytes], np.ndarray]:
        """Languages, and by number the language's place, the word and its hash."""
        n = sum(map(len, self.numbers.values()))
        langs, at, words, hashes = list(self.numbers), np.zeros(n + 1, np.int32), [b""] * (n + 1), np.zeros(n + 1, np.uint64)
        for place, lang in enumerate(langs):
            head = lang.encode() + b"\0"
            for word, i in self.numbers[lang].items():
                at[i], words[i], hashes[i] = place, word, xxhash.xxh3_64_intdigest(head + word)
        return langs, at, words, hashes


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The hash of a longer prefix."""
    with np.errstate(over="ignore"):
        return mix64(one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(1))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _read(batch):
    """(language, text) of a batch; null languages are ``und``, null texts empty."""
    import pyarrow as pa

    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        yield "und" if lang is None else lang, text or b""


def _count_words(batches):
    """(lang, word, hash, n): words of a task, in tables of bounded size."""
    import pyarrow as pa

    def flush(counts):
        rows = [(lang, w, xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + w), n) for lang, words in counts.items() for w, n in words.items()]
        lang, word, hashed, n = zip(*rows)
        signed = np.array(hashed, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word, pa.binary()), pa.array(signed), pa.array(n, pa.int64())], ["lang", "word", "hash", "n"])

    counts = defaultdict(Counter)
    for batch in batches:
        for lang, text in _read(batch):
            words = text.translate(_PIECES).split()
            if words:
                counts[lang].update(words)
            if sum(map(len, counts.values())) >= TABLE:
                yield flush(counts)
                counts = defaultdict(Counter)
    if counts:
        yield flush(counts)


def _count_pairs(heavy: dict[str, dict[bytes, int]]):
    """(lang, first, second, hash, n): pairs that begin with a heavy word."""

    def run(batches):
        import pyarrow as pa

        def flush(held):
            a, b, _ = held.columns()
            langs, at, words, hashes = held.named()
            wanted = _marked(held, heavy)
            keep = wanted[a] & (b > 0)
            keys, n = _runs((a[keep] << 32) | b[keep])
            a, b = keys >> 32, keys & 0xFFFFFFFF
            columns = [pa.array([langs[i] for i in at[a]], pa.string()), *(pa.array([words[i] for i in x], pa.binary()) for x in (a, b))]
            columns += [pa.array(_joined(hashes[a], hashes[b]).view(np.int64)), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "first", "second", "hash", "n"])

        held = Suffixes()
        for batch in batches:
            for lang, text in _read(batch):
                held.add(lang, text)
                if held.full():
                    yield flush(held)
                    held = Suffixes()
        if len(held.ids):
            yield flush(held)

    return run


def _marked(held: Suffixes, heavy: dict[str, dict[bytes, int]]) -> np.ndarray:
    out = np.zeros(1 + sum(map(len, held.numbers.values())), bool)
    for lang, words in heavy.items():
        known = held.numbers.get(lang, {})
        out[[known[w] for w in words if w in known]] = True
    return out


def _deal(heavy: dict, pairs: dict, cuts: np.ndarray, bits: int):
    """(group, langs, lang_of, words, first, second, third, n): the suffixes of a batch by group, each once with its number.

    Words are numbered anew within a row: ``words`` are joined by line feeds, 0 is the end of a piece.
    """

    def run(batches):
        import pyarrow as pa

        names = ["grp", "langs", "lang_of", "words", "first", "second", "third", "n"]
        kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 6]

        def flush(held):
            a, b, c = held.columns()
            langs, at, words, hashes = held.named()
            if len(words) <= 1 << _WORD_BITS:
                keys, n = _runs((a << 2 * _WORD_BITS) | (b << _WORD_BITS) | c)
                low = (1 << _WORD_BITS) - 1
                a, b, c = keys >> 2 * _WORD_BITS, (keys >> _WORD_BITS) & low, keys & low
            else:
                a, b, c, n = _distinct(a, b, c, np.ones(len(a), np.int64))
            code = hashes[a]
            long = _marked(held, heavy)[a]
            code[long] = _joined(code[long], hashes[b[long]])
            known = {(held.numbers[lang][x], held.numbers[lang][y]) for lang, x, y in pairs if lang in held.numbers and x in held.numbers[lang] and y in held.numbers[lang]}
            if known:
                listed = np.array([x << 32 | y for x, y in known])
                longer = long & np.isin(a << 32 | b, listed)
                code[longer] = _joined(code[longer], hashes[c[longer]])
            group = cuts[(code >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.argsort(group, kind="stable")
            a, b, c, n, group = (x[order] for x in (a, b, c, n, group))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(0, np.int64)
            rows, size = [], 0
            for first, last in zip(edges[:-1], edges[1:]):
                here, flat = np.unique(np.concatenate([[0], a[first:last], b[first:last], c[first:last]]), return_inverse=True)
                flat = flat[1:].astype(np.int32).reshape(3, -1)
                text = b"\n".join([words[i] for i in here[1:]])
                rows.append((int(group[first]), langs, at[here[1:]].tobytes(), text, *(x.tobytes() for x in flat), n[first:last].astype(np.int32).tobytes()))
                size += len(text) + 16 * (last - first)
                if size > _PAYLOAD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        held = Suffixes()
        for batch in batches:
            for lang, text in _read(batch):
                held.add(lang, text)
                if held.full():
                    yield from flush(held)
                    held = Suffixes()
        if len(held.ids):
            yield from flush(held)

    return run


def _distinct(a, b, c, n):
    """Distinct suffixes in order, with the sum of their numbers: the leaves of the subtree."""
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    if not len(a):
        return a, b, c, n
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    return a[first], b[first], c[first], np.add.reduceat(n, first)


def _subtree(heavy: dict, pairs: dict, least: int):
    """(lang, first, second, third, a, l1, l2): the nodes of depth two and three with ``least`` or more occurrences.

    ``l1`` and ``l2`` are the totals of the nodes above, of depth one and two. Where the group's prefixes are longer
    than that, the totals are those that the prefixes were lengthened by.
    """

    def run(group):
        import pyarrow as pa

        numbers: dict[str, dict[bytes, int]] = {}
        names: list[tuple] = [("", b"")]
        parts = []
        for row in group.select(["langs", "lang_of", "words", "first", "second", "third", "n"]).to_pylist():
            local = [0]
            for lang_at, word in zip(np.frombuffer(row["lang_of"], np.int32).tolist(), row["words"].split(b"\n")):
                lang = row["langs"][lang_at]
                known = numbers.setdefault(lang, {})
                i = known.get(word)
                if i is None:
                    i = known[word] = len(names)
                    names.append((lang, word))
                local.append(i)
            local = np.array(local, np.int32)
            parts.append([local[np.frombuffer(row[k], np.int32)] for k in ("first", "second", "third")] + [np.frombuffer(row["n"], np.int32).astype(np.int64)])
        a, b, c, n = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        new = [np.concatenate([[True], a[1:] != a[:-1]])]
        new.append(new[0] | np.concatenate([[True], b[1:] != b[:-1]]))
        starts = [np.flatnonzero(x) for x in new]
        totals = [np.add.reduceat(n, s) for s in starts]
        above = [np.cumsum(x) - 1 for x in new]

        def named(i):
            return names[i][1]

        def word_total(leaf):
            lang, word = names[a[leaf]]
            known = heavy.get(lang, {}).get(word)
            return int(totals[0][above[0][leaf]]) if known is None else known

        def pair_total(leaf):
            lang, word = names[a[leaf]]
            known = pairs.get((lang, word, names[b[leaf]][1]))
            return int(totals[1][above[1][leaf]]) if known is None else known

        rows = []
        for node in np.flatnonzero(totals[1] >= least):
            leaf = starts[1][node]
            if b[leaf] and (names[a[leaf]][0], named(a[leaf]), named(b[leaf])) not in pairs:
                rows.append((names[a[leaf]][0], named(a[leaf]), named(b[leaf]), None, int(totals[1][node]), word_total(leaf), None))
        for leaf in np.flatnonzero((n >= least) & (c > 0)):
            rows.append((names[a[leaf]][0], named(a[leaf]), named(b[leaf]), named(c[leaf]), int(n[leaf]), word_total(leaf), pair_total(leaf)))
        kinds = [pa.string(), *[pa.binary()] * 3, *[pa.int64()] * 3]
        columns = list(zip(*rows)) or [[]] * 7
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["lang", "first", "second", "third", "a", "l1", "l2"])

    return run


def _heavy(counted: DataFrame, budget: int) -> tuple[int, list]:
    """The prefixes with more than ``budget`` occurrences; the budget is doubled until there are no more than ``HEAVY``."""
    while True:
        found = counted.where(F.col("n") > budget).limit(HEAVY + 1).collect()
        if len(found) <= HEAVY:
            return budget, found
        budget *= 2


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact while a is under 10**15."""
    wide = lambda x: x.cast("decimal(15,0)")
    count, parts = wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right)
    return F.call_function("div", count, parts)


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, kept: int = KEPT, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``kept`` best phrases of two or three words.

    ``docs`` has (text, lang). Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    pieces into words ``[^\\x20\\x09]+``. Candidates are contiguous words of one piece with ``a >= least``
    occurrences. Cut after its first k words a candidate scores floor(1000000 a a / (l r)), ``l`` and ``r``
    being the occurrences of both parts; its lowest score counts, of equal ones that of the smallest k. A
    candidate inside a longer one with at least ``share`` percent of its occurrences is dropped. ``n`` is the
    number of words of the language. Ties are broken by ``a`` descending, then the phrase in byte order.

    Three passes over the texts: words, pairs that begin with a heavy word (if there is one), suffixes. All are
    counted per task before they are shuffled. A group's memory follows from ``budget``, in occurrences, however
    often one word or pair occurs; small corpora have ``GROUPS`` groups.

    A null text is empty, a null language ``und``; rows that repeat count as often as they are there; very long
    texts are counted in batches like others; an empty table gives no rows; extra columns are not read.
    """
    texts = shipped(docs).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(_count_words, "lang string, word binary, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    words = settle(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(1, min(budget, total // GROUPS))
    limit, found = _heavy(words, budget)
    heavy: dict = {}
    for row in found:
        heavy.setdefault(row["lang"], {})[bytes(row["word"])] = row["n"]
    weights = words.where(F.col("n") <= limit)
    pairs, spare = {}, 0
    if heavy:
        counted = texts.mapInArrow(_count_pairs(heavy), "lang string, first binary, second binary, hash long, n long")
        counted = settle(counted.groupBy("lang", "first", "second", "hash").agg(F.sum("n").alias("n")))
        pair_limit, found = _heavy(counted, limit)
        pairs = {(row["lang"], bytes(row["first"]), bytes(row["second"])): row["n"] for row in found}
        weights = weights.select("hash", "n").unionAll(counted.where(F.col("n") <= pair_limit).select("hash", "n"))
        spare = sum(pairs.values())

    bits = min(20, max(8, (64 * max(1, total // budget)).bit_length()))
    weight = np.full(1 << bits, spare / (1 << bits))
    for row in weights.groupBy(F.shiftrightunsigned("hash", 64 - bits).alias("at")).agg(F.sum("n").alias("n")).collect():  # at most 2**bits rows
        weight[row["at"]] += row["n"]
    cuts = ((np.cumsum(weight) - weight) // budget).astype(np.int32)

    dealt = texts.mapInArrow(
        _deal(heavy, pairs, cuts, bits), "grp int, langs array<string>, lang_of binary, words binary, first binary, second binary, third binary, n binary"
    )
    nodes = dealt.groupBy("grp").applyInArrow(_subtree(heavy, pairs, least), "lang string, first binary, second binary, third binary, a long, l1 long, l2 long")
    nodes = settle(nodes)
    two = nodes.where("third IS NULL").select("lang", "first", "second", "a", "l1")
    split = [(lang, x, y, n, heavy[lang][x]) for (lang, x, y), n in pairs.items() if n >= least]
    two = two.unionAll(docs.sparkSession.createDataFrame(split, "lang string, first binary, second binary, a long, l1 long"))
    three = nodes.where("third IS NOT NULL")

    longest = three.select("lang", "first", "second", "a").unionAll(three.select("lang", "second", "third", "a"))
    longest = longest.groupBy("lang", "first", "second").agg(F.max("a").alias("longer"))
    last_word = words.where(F.col("n") >= least).select("lang", "word", F.col("n").alias("last"))
    last_pair = two.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("r1"))

    two = lookup_join(two, settle(longest), ["lang", "first", "second"])
    two = two.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    last_word = settle(last_word)
    two = lookup_join(two, last_word.withColumnRenamed("word", "second"), ["lang", "second"], "inner")
    two = two.select("lang", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("first", "second"))).alias("phrase"), "a", F.col("l1").alias("l"), F.col("last").alias("r"))
    two = two.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))

    three = lookup_join(three, settle(last_pair), ["lang", "second", "third"], "inner")
    three = lookup_join(three, last_word.withColumnRenamed("word", "third"), ["lang", "third"], "inner")
    one, other = _score(F.col("a"), F.col("l1"), F.col("r1")), _score(F.col("a"), F.col("l2"), F.col("last"))
    three = three.withColumn("s1", one).withColumn("s2", other)
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("first", "second", "third"))).alias("phrase"), "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("last")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= kept)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= kept)
    sums = settle(words.groupBy("lang").agg(F.sum("n").alias("n")))
    ranked = lookup_join(ranked, sums, ["lang"])
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query(
    "op13_phrase_subtrees",
    "WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
    "s AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p), "
    "one AS (SELECT lang, x AS a, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM s) GROUP BY ALL), "
    "two AS (SELECT lang, x[1] AS a, x[2] AS b, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS x FROM s) GROUP BY ALL), "
    "three AS (SELECT lang, x[1] AS a, x[2] AS b, x[3] AS c, count(*) AS f FROM "
    "(SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM s) GROUP BY ALL HAVING count(*) >= 10), "
    "longest AS (SELECT lang, a, b, max(f) AS m FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL), "
    "cut AS (SELECT t.lang, t.a || ' ' || t.b AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a "
    "JOIN one y ON y.lang = t.lang AND y.a = t.b LEFT JOIN longest g ON g.lang = t.lang AND g.a = t.a AND g.b = t.b WHERE t.f >= 10 AND (m IS NULL OR 100 * m < 50 * t.f) "
    "UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 1, t.f, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a "
    "JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c "
    "UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 2, t.f, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b "
    "JOIN one y ON y.lang = t.lang AND y.a = t.c), "
    "scored AS (SELECT lang, phrase, k, a, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut), "
    "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best), "
    "sums AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang) "
    "SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000",
)
def op13(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents"))
