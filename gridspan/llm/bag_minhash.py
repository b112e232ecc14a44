"""Near-duplicates by weighted minhash signatures (BagMinHash) and verified multiset overlap.

A document is the bag of its five-word shingles with their counts. For every shingle and every signature
component a Poisson process of rate 1 runs over time and weight; a component's value is the earliest point
of any shingle at a weight below the shingle's count. Two documents agree in a component with exactly
their weighted Jaccard similarity, the sum of smaller counts over the sum of larger ones.

Weights are cut into octaves [0,1), [1,2), [2,4), ...: each octave of a shingle is one process for all
components together, whose points are dealt to components and halved down to unit weights by hash bits.
Points come in ascending order and stop at the largest value the signature still has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import BROADCAST_ROWS, fits_broadcast
from ..session import settle
from .common import Words, mix64, portions, query, shipped, table
from .components import components, tasks

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 7
# Bytes of texts that are shingled and signed together.
_GROUP_BYTES = 1 << 20
# Rounds of comparisons with hubs before all that is left is compared by shared elements.
STARS = 2
# Bytes of bags that may be broadcast.
_BAG_BYTES = 32 << 20
_U = np.uint64
# Signs and capitals don't count: words are compared in lower case without ASCII punctuation.
_FOLD = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((bits >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def bags(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of every distinct shingle, sorted by text and shingle.

    A text of fewer words than a shingle is one shingle of all of them; a text without words has none.
    """
    words = Words([(t or "").lower().encode().translate(_FOLD) for t in texts])
    at, value = words.runs(size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    extra = np.zeros(len(short), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            on = words.count[short] > j
            extra[on] = extra[on] * _U(0xD6E8FEB86659FD93) + words.code[words.first[short[on]] + j]
    doc, value = np.concatenate([doc, short]), np.concatenate([value, mix64(extra)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash values, (n_docs, m); inf for a text without shingles."""
    out = np.full(n_docs * m, np.inf)
    # one process per shingle and octave of its weight
    jobs = []
    low, wide = 0, 1
    alive = np.arange(len(doc))
    while len(alive):
        jobs.append((alive, np.full(len(alive), low), np.full(len(alive), wide)))
        low, wide = low + wide, low + wide
        alive = alive[count[alive] > low]
    if not jobs:
        return out.reshape(n_docs, m)
    which, low, wide = (np.concatenate(x) for x in zip(*jobs))
    owner, weight = doc[which], count[which]
    with np.errstate(over="ignore"):
        seed = mix64(shingle[which] ^ mix64(low.astype(np.uint64) + _U(0x5851F42D4C957F2D)))
    rate = m * wide.astype(np.float64)
    time = np.zeros(len(which))
    limit = np.where(np.bincount(doc, minlength=n_docs) > 0, np.inf, -1.0)
    k = 0
    while True:
        k += 1
        with np.errstate(over="ignore"):
            bits = mix64(seed + _U(k) * _U(0x9E3779B97F4A7C15))
            more = mix64(bits ^ _U(0xA0761D6478BD642F))
        time = time - np.log(_unit(bits)) / rate
        on = time <= limit[owner]
        if not on.all():
            seed, rate, time, owner, weight, low, wide, more = (x[on] for x in (seed, rate, time, owner, weight, low, wide, more))
        if not len(seed):
            return out.reshape(n_docs, m)
        component = ((more >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        unit = low + ((more & _U(0xFFFFFFFF)) % wide.astype(np.uint64)).astype(np.int64)
        below = unit < weight
        np.minimum.at(out, owner[below] * m + component[below], time[below])
        if k % 4 == 0:
            live = np.unique(owner)
            limit[live] = out.reshape(n_docs, m)[live].max(1)


def _digests(doc, shingle, count, n_docs) -> list[bytes | None]:
    """128 bits for each bag; none for a bag without shingles."""
    halves = []
    with np.errstate(over="ignore"):
        for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            total = np.zeros(n_docs, np.uint64)
            np.add.at(total, doc, mix64(shingle * _U(salt | 1) + mix64(count.astype(np.uint64) + _U(salt))))
            halves.append(mix64(total))
    both = np.stack(halves, axis=1).tobytes()
    some = np.bincount(doc, minlength=n_docs) > 0
    return [both[16 * i : 16 * i + 16] if some[i] else None for i in range(n_docs)]


def _signed_documents(texts: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """(doc_id, digest, weight, keys, mark) of every row: the bag's digest, its size and one key per band."""
    m = bands * rows

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 1, _GROUP_BYTES):
                n = part.num_rows
                doc, value, count = bags(part.column(1).to_pylist(), shingle)
                digest = _digests(doc, value, count, n)
                # copies of one bag in a group of texts are signed once
                first: dict = {}
                owner = np.array([first.setdefault(d, i) if d is not None else i for i, d in enumerate(digest)])
                lead = owner == np.arange(n)
                on = lead[doc]
                values = signatures(doc[on], value[on], count[on], n, m)[owner].view(np.uint64).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = mix64(key * _U(0xD6E8FEB86659FD93) + values[:, :, r])
                some = np.array([d is not None for d in digest])
                sizes = np.where(some, bands, 0)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[some].ravel().view(np.int64)))
                weight = np.bincount(doc, count, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(weight), keys, part.column(2)], ["doc_id", "digest", "weight", "keys", "mark"])

    return texts.mapInArrow(run, "doc_id long, digest binary, weight long, keys array<long>, mark long")


def _bag_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """(digest, bag): the j-th occurrence of a shingle is an element of its own, so that plain set overlap
    of two bags is their multiset overlap."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 0, _GROUP_BYTES):
                n = part.num_rows
                doc, value, count = bags(part.column(0).to_pylist(), shingle)
                digest = _digests(doc, value, count, n)
                total = int(count.sum())
                nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                with np.errstate(over="ignore"):
                    element = mix64(np.repeat(value, count) + nth.astype(np.uint64) * _U(0xE7037ED1A0B428DB))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, count, n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(element.view(np.int64)))], ["digest", "bag"])

    return texts.mapInArrow(run, "digest binary, bag array<long>")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table) else table


def _few(bags: DataFrame) -> bool:
    """Whether the bags are proven to fit a broadcast: by their elements of 8 bytes, not by their text."""
    size = (F.size("bag") * 8 + 64).cast("long").alias("b")
    seen, used = bags.select(size).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return seen <= BROADCAST_ROWS and used <= _BAG_BYTES


def _held_bags(live: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, bag) of the nodes that share a band with another; only their texts are shingled again.

    Bags are the largest rows here. They stay in the task that makes them unless an id occurs several times,
    so that one node's bag may be made more than once.
    """
    wanted = settle(nodes.join(live.select("node").distinct(), "node").select("node", "digest", "sample"))
    ids = _small(wanted.select("sample"))
    picked = texts.join(ids, texts["doc_id"].eqNullSafe(ids["sample"]), "left_semi")
    repeated = picked.groupBy("doc_id").count().where("count > 1")
    held = _bag_rows(picked.select("text"), shingle).join(_small(wanted.select("digest", "node")), "digest").select("node", "bag")
    return settle(held if repeated.isEmpty() else held.groupBy("node").agg(F.first("bag").alias("bag")))


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose multiset overlap is at least ``similarity``.

    Pairs proven small go to the bags, which then are read where they lie; so do the bags of all ``a``, of
    which there is one for a whole cluster in most rounds. What is not small is shuffled, and Spark splits
    its large keys.
    """
    hubs = held.join(_small(pairs.select("a").distinct()), F.col("node") == F.col("a"), "left_semi")
    if _few(hubs):
        hubs = F.broadcast(hubs)
    left = hubs.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = held.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    met = right.join(_small(pairs.select("a", "b")), "b").join(left, "a")
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    return settle(met.where(_reaches(both, F.size("bag_a"), F.size("bag_b"), similarity)).select("a", "b"))


def _reaches(common, x, y, similarity: float):
    """Whether bags of ``x`` and ``y`` elements with ``common`` ones in both are similar enough."""
    return common >= F.lit(similarity) * (x + y - common)


def _clusters(live: DataFrame, rooted: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(node, weight, can, cluster): nodes that may still have links to another class.

    A link between classes needs shared elements, and only elements that several classes have can be
    shared: with ``can`` such elements, a node's overlap with any other is at most ``can``. That bound is
    exact; it takes out documents that were edited too much to be near to any other before pairs are made.
    Nodes that buckets connect are one cluster, so a pair is made once and not in each bucket it shares.
    """
    width = tasks(live.count())
    mixed = settle(_mixed(_classed(live.select("key", "node", "weight"), rooted).coalesce(width), "key").coalesce(width))
    members = mixed.select("node", "root").distinct()
    elements = held.join(members, "node").select("node", "root", F.explode("bag").alias("element"))
    between = elements.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("element")
    can = elements.join(between, "element", "left_semi").groupBy("node").agg(F.count("*").alias("can")).coalesce(width)
    open_ = settle(mixed.join(can, "node").where(F.col("can") >= F.lit(similarity) * F.col("weight")).coalesce(width))
    hubs = open_.groupBy("key").agg(F.min("node").alias("hub"))
    clusters = components(open_.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    placed = open_.select("node", "weight", "can").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node")
    return settle(placed.coalesce(width))


def _classed(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    return rows.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _star_pairs(open_: DataFrame, spent: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each cluster, one hub not yet ``spent`` against the other classes.

    The hub is the node with the fewest elements that no other class has: the least edited one.
    """
    fresh = open_.join(spent, "node", "left_anti")
    rank = F.struct(F.col("can") - F.col("weight"), -F.col("node"), F.col("node").alias("node"), "weight", "can", "root")
    hubs = fresh.groupBy("cluster").agg(F.max(rank).alias("hub"))
    near = open_.join(hubs, "cluster").where(F.col("root") != F.col("hub.root"))
    near = near.where(_reaches(F.least("can", "hub.can"), F.col("weight"), F.col("hub.weight"), similarity))
    return near.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def _rare_pairs(open_: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of different classes that may be near, by their rarest shared elements.

    Two bags as similar as that have an element in common among the first ``weight - ceil(similarity * weight) + 1``
    of both, in any fixed order of the elements. In the order from rare to frequent, those that no other class has
    come first and meet nothing. A frequent element's rows outside its largest class are joined with its rows of all
    other classes, so members of one class are never paired, and what is left of both behind the element must allow
    the similarity.
    """
    nodes = open_.select("node", "root", "weight").distinct()
    elements = held.join(nodes, "node").select("node", "root", "weight", F.explode("bag").alias("element"))
    shared = elements.groupBy("element").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    found = elements.join(shared.where("low <> high").select("element", "n"), "element")
    own = Window.partitionBy("node")
    prefix = F.col("weight") - F.ceil(F.lit(similarity) * F.col("weight") - F.lit(1e-9)) + 1
    found = found.withColumn("place", F.row_number().over(own.orderBy("n", "element"))).withColumn("can", F.count("*").over(own))
    found = settle(found.where(F.col("place") <= prefix - (F.col("weight") - F.col("can"))).select("element", "node", "root", "weight", (F.col("can") - F.col("place") + 1).alias("left")))
    sizes = found.groupBy("element", "root").count()
    largest = sizes.groupBy("element").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("classes"))
    ranked = found.join(largest.where("classes > 1").select("element", F.col("top.root").alias("top")), "element")
    minor = ranked.where("root <> top").select("element", F.col("node").alias("x"), F.col("weight").alias("wx"), F.col("root").alias("rx"), F.col("left").alias("lx"))
    other = ranked.select("element", "top", F.col("node").alias("y"), F.col("weight").alias("wy"), F.col("root").alias("ry"), F.col("left").alias("ly"))
    # from the first common element on, no more than what is left of either can be common
    possible = _reaches(F.least("lx", "ly"), F.col("wx"), F.col("wy"), similarity)
    # a pair of two minor classes is made from its smaller node only
    once = (F.col("ry") == F.col("top")) | (F.col("x") < F.col("y"))
    pairs = minor.join(other, "element").where((F.col("rx") != F.col("ry")) & possible & once)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _linked_classes(live: DataFrame, held: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """(node, root): components of all links among candidates, found without pairs inside a class."""
    links = _verified(first, held, similarity)
    rooted = settle(components(links))
    clusters = _clusters(live, rooted, held, similarity)
    width = tasks(clusters.count())
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    spent = clusters.select("node").limit(0)
    for _ in range(STARS):
        open_ = settle(_mixed(_classed(clusters, rooted).coalesce(width), "cluster").coalesce(width))
        star = settle(_star_pairs(open_, spent, similarity).coalesce(width))
        new = _verified(star, held, similarity)
        if new.isEmpty():
            break
        spent = settle(spent.unionAll(star.select("a").distinct()).coalesce(width))
        tested = tested.unionAll(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        links = settle(links.unionAll(new).coalesce(width))
        rooted = settle(components(links).coalesce(width))
    open_ = settle(_mixed(_classed(clusters, rooted).coalesce(width), "cluster").coalesce(width))
    rest = settle(_rare_pairs(open_, held, similarity).join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionAll(_verified(rest, held, similarity))
        rooted = settle(components(links))
    return rooted


def _mixed(classed: DataFrame, by: str) -> DataFrame:
    """The rows of groups that hold several classes."""
    several = classed.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return classed.join(several.select(by), by)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every row: classes of documents linked by near-duplicates.

    Two documents are linked if their weighted Jaccard similarity over bags of ``shingle`` words is at
    least ``similarity``; classes are the connected components, ``class_id`` the smallest id in one.

    * Rows with one bag are one node, found by a digest, so copies are never compared.
    * Nodes that share a band of the signature are candidates (40 bands of 7: a pair at 0.8 is met with
      probability 0.9999, one at 0.5 with 0.27). In each bucket all are first compared with its smallest
      node, so a bucket of n costs n - 1 comparisons.
    * Where buckets then still hold several classes, the least edited node of each cluster of buckets is
      compared with the other classes, in ``STARS`` rounds as long as they find links. Classes that are left
      are compared where two of their bags have one of their rarest elements in common, which bags as similar
      as that always do (see :func:`_rare_pairs`). Pairs within a class would add nothing, so no candidate
      link between classes is lost, and no bucket or cluster is expanded into all pairs.

    A text without words (null, empty, only signs) is a class by itself; null ids lose to all others for
    ``class_id``; repeated rows fall into one class, of which one row is ``kept``; a short text is one
    shingle; a very long one is signed alone and is one row of a join; of equal ids in a class the row read
    first is kept; an empty table gives no rows; extra columns are not read.
    """
    return _members(docs, similarity, bands, rows, shingle).drop("mark")


def _mark():
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _members(docs: DataFrame, similarity: float, bands: int, rows: int, shingle: int) -> DataFrame:
    """What :func:`near_classes` returns, with the text's ``mark``."""
    texts = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark().alias("mark"))
    signed = settle(_signed_documents(texts, bands, rows, shingle).withColumn("row", F.monotonically_increasing_id()))
    some = signed.where("digest IS NOT NULL")
    chosen = F.min(F.struct("row", "doc_id", "weight")).alias("one")
    nodes = some.groupBy("digest").agg(chosen).select(F.col("one.row").alias("node"), "digest", F.col("one.doc_id").alias("sample"), F.col("one.weight").alias("weight"))
    nodes = settle(nodes)

    keyed = some.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = keyed.select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    hubs = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    live = banded.join(hubs.select("key", "hub"), "key")
    live = settle(live.join(nodes.select("node", "weight"), "node"))
    held = _held_bags(live, texts, nodes, shingle)

    hub_weight = nodes.select(F.col("node").alias("hub"), F.col("weight").alias("hub_weight"))
    first = live.where("node <> hub").select("hub", "node", "weight").distinct().join(hub_weight, "hub")
    first = first.where(_reaches(F.least("weight", "hub_weight"), F.col("weight"), F.col("hub_weight"), similarity))
    first = settle(first.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    rooted = _linked_classes(live, held, first, similarity)

    member = signed.join(nodes.select("digest", "node"), "digest", "left").join(rooted, "node", "left")
    member = settle(member.select("doc_id", "row", "mark", F.coalesce("root", "node", "row").alias("root")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = member.groupBy("root").agg(best, F.count("*").alias("class_size"))
    return member.join(classes, "root").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), "mark"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all their columns.

    Rows are found again by id and a hash of the text, so of rows that repeat an id, null ids among them, those
    stay whose text is kept. Rows equal in both (copies of one row) are one row of one class; any one stays.
    """
    members = _members(docs, SIMILARITY, BANDS, ROWS, SHINGLE)
    alike = members.groupBy("doc_id", "mark").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("stays")
    kept = alike.select(F.col("doc_id").alias("id"), F.col("mark").alias("kept_mark"), (F.col("n") > 1).alias("several"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own"), _mark().alias("mark"))
    found = rows.join(kept, rows["own"].eqNullSafe(kept["id"]) & (F.col("mark") == F.col("kept_mark")))
    if alike.where("n > 1").isEmpty():
        return found.select("row.*")
    once = found.where("several").dropDuplicates(["own", "mark"])
    return found.where("NOT several").select("row.*").unionAll(once.select("row.*"))


@query("op2_bag_minhash_near_dedup")
def op2(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
