"""Pivot index, phrase subtrees and treap search against brute force, on small tables."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from gridspan.llm import ktreap_search, phrase_trees, pivot_index

# --- embedding near-duplicates

VECTORS = "vec_id long, embedding array<float>, label int, key string, rep long, size int, near int, part int, n_links long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "k", 1, 2, 3, 4, 5) for i, e, label in rows], VECTORS).repartition(3)


def usable(e, label, i):
    return i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)


def brute_links(rows, threshold):
    points = {i: (np.array(e, np.float32).astype(float), label) for i, e, label in rows if usable(e, label, i)}
    near = {i: set() for i, _, _ in rows}
    for i, (x, p) in points.items():
        for j, (y, q) in points.items():
            if i < j and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    root = {i: i for i in near}
    for start in sorted(i for i in near if i is not None):
        stack = [start]
        while stack:
            at = stack.pop()
            for other in near[at]:
                if root[other] > root[start]:
                    root[other] = root[start]
                    stack.append(other)
    return near, root


def check(spark, rows, **options):
    got = pivot_index.near_vectors(vectors(spark, rows), **options).collect()
    near, root = brute_links(rows, options.get("threshold", 0.98))
    assert collections.Counter(r["vec_id"] for r in got) == collections.Counter({i: 1 for i in near})
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(near[r["vec_id"]]), root[r["vec_id"]], root[r["vec_id"]] == r["vec_id"]), r


def cloud(seed, centers, copies, size=16, spread=0.03):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(centers, size))
    return np.repeat(heart, copies, axis=0) + rng.normal(size=(centers * copies, size)) * spread


@pytest.mark.parametrize("options", [{}, {"block": 8, "bucket": 64}, {"drawn": 5}, {"prefix": 3, "shared": 1}, {"threshold": 0.999}])
def test_links_equal_brute_force(spark, options):
    points = np.concatenate([cloud(1, 20, 6), cloud(2, 1, 60, spread=0.05), cloud(3, 100, 1)])
    rows = [(i, [float(x) for x in e], int(i % 2)) for i, e in enumerate(points.astype(np.float32))]
    check(spark, rows, **options)


def test_links_of_a_chain(spark):
    angles = np.arange(0, 3, 0.15)
    check(spark, [(100 - i, [float(np.cos(a)), float(np.sin(a)), 0.0], 7) for i, a in enumerate(angles)], block=4)


def test_links_of_odd_vectors(spark):
    same = [0.1, 0.2, 0.3]
    rows = [(i, same, 1) for i in range(40)] + [(50, [0.2, 0.4, 0.6], 1), (51, same, None), (52, same, 2), (53, None, 1), (54, [], 1), (55, [0.0, 0.0, 0.0], 1)]
    rows += [(56, [0.1, None, 0.3], 1), (57, [float("nan"), 0.2, 0.3], 1), (58, [float("inf"), 0.2, 0.3], 1), (59, [0.1, 0.2], 1), (60, [0.1, 0.2], 1), (61, [3e38, 3e38, 3e38], 1), (62, [1e-38, 1e-38, 1e-38], 1)]
    rows += [(None, same, 1), (-5, same, 2)]
    check(spark, rows)


def test_links_of_repeated_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (None, [1.0], 1), (None, None, None)]
    got = {r["vec_id"]: tuple(r)[1:] for r in pivot_index.near_vectors(vectors(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)}
    assert pivot_index.near_vectors(vectors(spark, [])).collect() == []


def test_recall_without_structure(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    tilted = base + rng.normal(size=base.shape) * 0.14
    rows = [(i, [float(x) for x in e], 1) for i, e in enumerate(np.concatenate([base, tilted]).astype(np.float32))]
    near, _ = brute_links(rows, 0.98)
    got = pivot_index.near_vectors(vectors(spark, rows)).collect()
    found, true = sum(r["n_links"] for r in got), sum(map(len, near.values()))
    assert true > 300 and 0.99 * true <= found <= true


# --- phrases

DOCS = "doc_id long, text string, lang string, word string, n long, grp int, hash long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, 2, 3) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)


def brute_phrases(rows, least, share, kept):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, found in counts.items():
        rows = []
        for p, a in found.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and f >= least and p in (q[:2], q[1:]) and 100 * f >= share * a for q, f in found.items()):
                continue
            cuts = [(1000000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:kept], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [a + b for a in "bcdfg" for b in ("an", "er", "it")] + ["Über", "東京", "x\x1cy", "it's", "A-Z"]
    weights = 1 / np.arange(1, len(words) + 1) ** 1.2
    rows = []
    for i in range(120):
        text = rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum())
        marks = rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "! ", " \x0b"], len(text), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.025, 0.025, 0.025, 0.025])
        rows.append(("".join(a + b for a, b in zip(text, marks)), [None, "und", "en", "de\n"][i % 4]))
    return rows + [("new york city hall " * 40, "en"), ("hot pair " * 300, "en"), (None, "en"), ("", "fr"), (" \t\n.,", None)]


@pytest.mark.parametrize("options", [{}, {"budget": 1}, {"budget": 25, "least": 2}, {"kept": 7, "share": 90}, {"least": 10**6}])
def test_phrases_equal_brute_force(spark, options):
    rows = corpus(1)
    got = sorted(map(tuple, phrase_trees.phrases(docs(spark, rows), **options).collect()))
    assert got == brute_phrases(rows, options.get("least", 10), options.get("share", 50), options.get("kept", 2000))


def test_phrases_of_small_batches_and_many_prefixes(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(phrase_trees, "HEAVY", 3)
    got = sorted(map(tuple, phrase_trees.phrases(docs(spark, rows), budget=2, least=3).collect()))
    assert got == brute_phrases(rows, 3, 50, 2000)


def test_suffixes_of_batches(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(phrase_trees, "BATCH", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4, pa.string()), pa.array(["a b c", "a b. c", None, "a b c d e f g a b c"])], ["lang", "text"])
    cuts = np.zeros(256, np.int32)
    dealt = pa.Table.from_batches(list(phrase_trees._deal({}, {}, cuts, 8)([batch])))
    assert dealt.num_rows == 2
    nodes = phrase_trees._subtree({}, {}, 2)(dealt).to_pylist()
    assert {(r["first"], r["second"], r["third"], r["a"], r["l1"], r["l2"]) for r in nodes} == {
        (b"a", b"b", None, 4, 4, None), (b"a", b"b", b"c", 3, 4, 4), (b"b", b"c", None, 3, 4, None)
    }


def test_phrases_of_an_empty_table(spark):
    assert phrase_trees.phrases(docs(spark, [])).collect() == []


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 5 * 10**13 + 7, 9 * 10**13, 5 * 10**13 + 9
    row = spark.range(1).select(phrase_trees._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1000000 * a * a // (left * right)


# --- ranked search

FOUND = "doc_id long, text string, term string, search long, df long, item_id long, rank long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(documents, items, most):
    held = [(i, collections.Counter(terms(t))) for i, t in documents]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(sum(t.values()) for _, t in held)
    df = collections.Counter(t for _, d in held for t in d)
    out = []
    for item, text in items:
        scored = []
        for i, found in held:
            m = 10 + 90 * sum(found.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * found[t] // (1000 * found[t] + 8 * m)) for t in set(terms(text)) if t in found)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:most], 1)]
    return out


def searched(spark, documents, items, parts=3, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in documents], FOUND).repartition(parts)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, search long")
    return sorted(map(tuple, ktreap_search.search(docs, asked, **options).collect()), key=str)


def library(seed, n):
    rng = np.random.default_rng(seed)
    words = [a + b for a in "bcdfghjklm" for b in ("an", "er", "it", "os")] + ["Über", "東京", "naïve", "x1", "42"]
    weights = 1 / np.arange(1, len(words) + 1)
    draw = lambda size: rng.choice(words, size, p=weights / weights.sum())
    docs = [(i, " ".join(draw(int(rng.integers(1, 80))))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)] + [(n + 40, docs[3][1].upper() + "!"), (n + 50, None), (n + 51, ""), (n + 52, " .,-"), (None, docs[3][1]), (None, docs[3][1])]
    docs += [(n + 60, " ".join(draw(20000))), (5, docs[5][1])]
    items = [(i, " ".join(draw(int(rng.integers(1, 12))))) for i in range(20)] + [(30, docs[3][1]), (30, "an,ban"), (31, None), (32, "nowhere"), (33, "ÜBER über Über"), (34, "ban ban BAN"), (None, "cos der")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"cells": 40}, {"cells": 1}, {"most": 3, "cells": 200}, {"chunk": 1, "cells": 500}, {"most": 1000}])
def test_search_equals_brute_force(spark, options):
    documents, items = library(1, 150)
    assert searched(spark, documents, items, **options) == sorted(brute_search(documents, items, options.get("most", 10)), key=str)


def test_search_in_one_partition_and_steps_of_one(spark, monkeypatch):
    documents, items = library(2, 100)
    expected = sorted(brute_search(documents, items, 10), key=str)
    assert searched(spark, documents, items, parts=1, cells=100) == expected
    numbers, columns = np.array([0, 0, 1, 6, 6, 6]), np.array([0, 5, 5, 1, 2, 7])
    top, children, drops = ktreap_search.planted(numbers, columns, np.array([5, 9, 1, 4, 4, 8]), 3)
    treap = ktreap_search.Treap(3, top, children, drops)
    monkeypatch.setattr(ktreap_search, "BEAM", 1)
    best = treap.search(np.array([0, 6]), np.array([2, 3]), list("abcdefgh"), 3, [])
    assert [(-s, d) for s, _, d in best] == [(24, "h"), (18, "f"), (12, "b")]


def test_search_of_empty_tables(spark):
    documents, items = library(3, 5)
    assert searched(spark, [], items) == [] and searched(spark, documents, []) == []
    assert searched(spark, [(1, None), (2, ".")], items) == []
