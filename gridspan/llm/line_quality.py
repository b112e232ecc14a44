"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is good or bad. Its features describe the line and the lines beside it; labels
of neighbouring lines depend on each other. Marginals of the forward-backward recursion, weighted by
line length, give the document's score.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, portions, query, shipped, starts_of, table, texts_of

TRAIN_DOCS = 4_000
TRAIN_LINES = 400
THRESHOLD = 0.3
_GROUP_BYTES = 1 << 20

_UPPER, _LOWER, _DIGIT, _SPACE, _SHOUT, _NOISE, _FRAME, _POINT, _HIGH, _REST = range(10)


def _byte_kinds() -> np.ndarray:
    out = np.full(256, _REST, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    for signs, kind in ((b" \t\x0b\x0c\r", _SPACE), (b"!", _SHOUT), (b"#$%&*@^~`", _NOISE), (b"|<>{}[]=_\\/+", _FRAME), (b".,;:?'\"-()", _POINT)):
        out[list(signs)] = kind
    return out


_KINDS = _byte_kinds()
_OWN, _BESIDE = 13, 8
FEATURES = _OWN + 2 * _BESIDE


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the non-blank lines of many texts, their lengths in bytes, and lines per text."""
    words = Words(texts)
    raw = np.frombuffer(words.data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    first = np.concatenate([[0], ends[:-1] + 1])
    size = ends - first
    line_of_word = np.searchsorted(ends, words.start)
    n_words = np.bincount(line_of_word, minlength=len(ends))
    used = n_words > 0
    line = np.repeat(np.arange(len(ends)), size + 1)
    counts = np.bincount(line * 10 + _KINDS[raw], minlength=10 * len(ends)).reshape(-1, 10)[used].astype(np.float64)

    again = np.zeros(len(words.code), bool)
    again[1:] = (words.code[1:] == words.code[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeats = np.bincount(line_of_word, again, len(ends))[used]
    letters_of_words = np.bincount(line_of_word, words.end - words.start, len(ends))[used]
    n = n_words[used].astype(np.float64)
    length = size[used].astype(np.float64)
    owner = np.searchsorted(words.text_start, first[used], side="right") - 1
    # a line's hash: its words' codes with their places
    place = (np.arange(len(words.code)) - np.repeat(starts_of(n_words), n_words)).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = words.code * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        whole = np.add.reduceat(mixed, starts_of(n_words[used])) if len(n) else np.zeros(0, np.uint64)
    order = np.lexsort((whole, owner))
    copy = np.zeros(len(n), bool)
    same = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    copy[order[1:][same]] = True

    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1)
    own = np.stack(
        [
            counts[:, _UPPER] / letters * np.minimum(letters / 10, 1),
            np.sqrt(counts[:, _SHOUT] / length),
            np.sqrt(counts[:, _NOISE] / length),
            np.sqrt(counts[:, _FRAME] / length),
            np.sqrt(counts[:, _DIGIT] / length),
            np.sqrt(repeats / n),
            copy.astype(np.float64),
            counts[:, _POINT] / length * 5,
            (counts[:, _SPACE] / length - 0.15) * 5,
            np.log1p(n) / 5,
            np.minimum(letters_of_words / n, 30) / 10,
            np.sqrt(counts[:, _REST] / length),
            np.ones(len(n)),
        ],
        axis=1,
    )
    beside = np.zeros((len(n), 2 * _BESIDE))
    near = owner[1:] == owner[:-1]
    beside[1:, :_BESIDE][near] = own[:-1, :_BESIDE][near]
    beside[:-1, _BESIDE:][near] = own[1:, :_BESIDE][near]
    return np.concatenate([own, beside], axis=1), length, np.bincount(owner, minlength=len(texts))


def _log1pexp(x):
    return np.logaddexp(0, x)


@dataclass
class Model:
    """``weights`` of a good line's features, ``switch[i, j]`` from label i to j, and the scale of scores."""

    weights: np.ndarray
    switch: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def odds(self, features: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission, forward and backward log odds of "good" of every line.

        The recursions step through the places of a line, all texts that are long enough at once.
        """
        emit = features @ self.weights
        first = starts_of(count)
        order = np.argsort(-count, kind="stable")
        sizes = count[order]
        at = first[order]
        t = self.switch
        ahead, back = emit.copy(), np.zeros(len(emit))
        longest = int(sizes[0]) if len(sizes) else 0
        alive = [int(np.searchsorted(-sizes, -k, side="left")) for k in range(longest + 1)]
        for k in range(1, longest):
            here = at[: alive[k]] + k
            a = ahead[here - 1]
            ahead[here] += np.logaddexp(t[0, 1], t[1, 1] + a) - np.logaddexp(t[0, 0], t[1, 0] + a)
        for k in range(longest - 1, 0, -1):
            here = at[: alive[k]] + k
            x = emit[here] + back[here]
            back[here - 1] = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
        return emit, ahead, back

    def raw_scores(self, features, length, count) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean of the marginals by text (nan without lines), and the marginals."""
        _, ahead, back = self.odds(features, count)
        good = 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))
        owner = np.repeat(np.arange(len(count)), count)
        weight = np.bincount(owner, length, len(count))
        with np.errstate(invalid="ignore"):
            return np.bincount(owner, good * length, len(count)) / weight, good

    def scores(self, features, length, count) -> tuple[np.ndarray, np.ndarray]:
        raw, good = self.raw_scores(features, length, count)
        score = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))
        return np.where(np.isnan(raw), self.prior, score), good


def train(features: np.ndarray, length: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 250) -> Model:
    """Fit by gradient ascent on the likelihood of all lines having their document's label.

    The objective is concave; a small ridge keeps it bounded. The scores' scale is a logistic fit of
    the labels on the weighted marginals.
    """
    prior = float((label.sum() + 1) / (len(label) + 2))
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), prior=prior)
    if not len(features):
        return model
    y = np.repeat(label, count).astype(np.float64)
    step = np.ones(len(features), bool)  # lines with a line before them
    step[starts_of(count)[count > 0]] = False
    here = np.flatnonzero(step)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[here - 1].astype(int), y[here].astype(int)), 1.0)
    mean = [np.zeros(features.shape[1]), np.zeros((2, 2))]
    spread = [np.zeros(features.shape[1]), np.zeros((2, 2))]
    n = max(1, len(features))
    for i in range(1, rounds + 1):
        emit, ahead, back = model.odds(features, count)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))
        x = emit[here] + back[here]
        a = ahead[here - 1]
        logits = np.stack([model.switch[0, 0] + 0 * x, model.switch[0, 1] + x, model.switch[1, 0] + a, model.switch[1, 1] + a + x])
        logits -= logits.max(0)
        joint = np.exp(logits)
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        gradient = [features.T @ (y - p) / n - 1e-4 * model.weights, (pairs - expected) / n - 1e-3 * model.switch]
        for k, value in enumerate((model.weights, model.switch)):
            mean[k] = 0.9 * mean[k] + 0.1 * gradient[k]
            spread[k] = 0.99 * spread[k] + 0.01 * gradient[k] ** 2
            value += 0.1 * (mean[k] / (1 - 0.9**i)) / (np.sqrt(spread[k] / (1 - 0.99**i)) + 1e-8)
    raw, _ = model.raw_scores(features, length, count)
    told = ~np.isnan(raw)
    model.slope, model.shift = _logistic(raw[told], label[told].astype(np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit in one variable, by Newton's method."""
    at = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -50, 50)))
        slope = design.T @ (y - p) - 0.1 * at
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(at[0]), float(at[1])


def held_out():
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model:
    """A model from at most ``most`` labelled documents, never from held-out ones.

    The sample is the labelled rows with the smallest hash of their id, the same on every run; labelled
    texts of over ``most_lines`` lines are left out of the sample. Features are taken where the texts are;
    only they come to the driver, at most ``most * most_lines`` lines. Without labels the model scores
    every line alike.
    """
    named = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    named = named.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = shipped(docs).select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    texts = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    # of rows that repeat an id one is learnt from, so no more than ``most`` come to the driver
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def describe(batches):
        import pyarrow as pa

        for batch in itertools.chain.from_iterable(portions(whole, 1, _GROUP_BYTES) for whole in batches):
            features, length, count = line_features(texts_of(batch.column(1)))
            rows = [(int(q), f.astype("<f4").tobytes(), w.astype("<f4").tobytes()) for q, f, w in zip(batch.column(2).to_pylist(), np.split(features, np.cumsum(count)[:-1]), np.split(length, np.cumsum(count)[:-1])) if len(f) <= most_lines]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(count <= most_lines)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary())))], ["doc_id", "quality", "features", "length"])

    found = texts.mapInArrow(describe, "doc_id long, quality int, features binary, length binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    features = np.frombuffer(b"".join(r["features"] for r in found), "<f4").reshape(-1, FEATURES).astype(np.float64)
    sizes = np.array([len(r["length"]) // 4 for r in found], np.int64)
    length = np.frombuffer(b"".join(r["length"] for r in found), "<f4").astype(np.float64)
    return train(features, length, sizes, np.array([r["quality"] for r in found], np.int64))


def score(docs: DataFrame, model: Model, lines: bool = False) -> DataFrame:
    """(doc_id, score[, line_scores]) of every row: how likely the text is good, from 0 to 1.

    Only the text is looked at. ``line_scores`` are the marginals of the non-blank lines in order. A null
    or empty text, or one of blank lines, gets the share of good rows in the sample; a null id stays null;
    repeated rows stay repeated; a long text is one chain; an empty table gives no rows; extra columns are
    not read. One pass, no shuffle; the model is a few dozen numbers.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 1, _GROUP_BYTES):
                features, length, count = line_features(texts_of(part.column(1)))
                value, good = model.scores(features, length, count)
                columns = [part.column(0), pa.array(value)]
                if lines:
                    bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(good.astype(np.float32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score"] + ["line_scores"] * lines)

    schema = "doc_id long, score double" + ", line_scores array<float>" * lines
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, place, _GROUP_BYTES):
                value, _ = model.scores(*line_features(texts_of(part.column(place))))
                yield part.filter(pa.array(value >= threshold))

    return shipped(docs).mapInArrow(run, docs.schema)


@query("op10_line_crf_quality")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
