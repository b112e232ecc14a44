"""Corpus operators against brute force, exact round trips and held-out labels, on small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from gridspan.llm import bag_minhash, byte_bpe, exact_dedup, hilbert_search, licenses, line_quality, packing, separator_scan, substring_dedup, token_store
from gridspan.llm.components import components
from gridspan.llm.tokens import default_path, encoder
from gridspan.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row string, chunk int, key long, digest string, node long"
WORDS = [a + b for a in "bcdfghkl" for b in ("an", "er", "it", "o")]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text: str, places: list[int]) -> str:
    words = text.split()
    for p in places:
        words[p] = f"changed{p}"
    return " ".join(words)


BASE, PASSAGE = prose(1, 120), prose(2, 30)
TEXTS = [
    (0, BASE),
    (1, BASE.replace(" ", "\n ", 3)),
    (2, edited(BASE, [60])),
    (3, prose(3, 40) + " " + PASSAGE + " " + prose(4, 40)),
    (4, PASSAGE + "\n" + prose(5, 50)),
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "two words"),
    (8, "two words"),
    (9, "Über Straße — naïve café 東京 😀 don't 's 'll  x\x1cy"),
    (None, PASSAGE),
    (None, None),
    (10, "a " * 3000),
    (11, prose(6, 6000)),
    (12, "MIT License\r\n\r\nCopyright (c) 2020 Someone\r\n" + licenses.KNOWN[8][1].split("\n\n", 1)[1].replace("license", "licence")),
    (13, prose(7, 20) + "\nReleased under the MIT License.\n" + prose(8, 20)),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "r", 1, 2, "d", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# --- exact dedup


@pytest.mark.parametrize("digest,bucket", [(exact_dedup.sha256, 1 << 20), (lambda b: bytes(32), 1 << 20), (lambda b: bytes([len(b) % 2]) * 32, 100)])
def test_copy_groups_compare_contents(docs, digest, bucket):
    got = exact_dedup.copy_groups(docs, digest=digest, bucket_bytes=bucket, table_bytes=2000).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[squeezed(t)].append((-len(t or ""), i is None, i))
    want = collections.Counter()
    for members in groups.values():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, i in members:
            want[(i, keep, len(members))] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_drop_copies_keeps_columns(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({squeezed(t) for _, t in TEXTS})
    assert exact_dedup.drop_copies(none).count() == 0


def test_buckets_split_until_they_fit(spark):
    rows = frame(spark, [(i, f"text number {i} " * 20) for i in range(300)])
    got = exact_dedup.copy_groups(rows, bucket_bytes=1500, table_bytes=4000)
    assert got.where("kept AND group_size = 1").count() == 300


# --- substring dedup


def brute_spans(rows, n):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    late = 1 << 63
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, late), late if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (late if i is None else i):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("chunk", [200, 1 << 22])
def test_substrings_equal_brute_force(docs, chunk):
    got = substring_dedup.remove_repeats(docs, chunk_bytes=chunk).collect()
    found = collections.Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["kept_text"] or ""))) for r in got)
    assert found == brute_spans(TEXTS, 13)
    for r in got:
        assert sum(r["span_words"]) == r["n_removed"]
        if not r["n_removed"]:
            assert r["kept_text"] == r["row"]["text"]


def test_substrings_of_a_hot_passage(spark):
    rows = [(i, prose(100 + i, 5) + " " + PASSAGE + " " + prose(300 + i, 5)) for i in range(60)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_spans(rows, 13)


def test_without_repeats_and_empty_table(docs, none):
    assert substring_dedup.without_repeats(docs).columns == docs.columns
    assert substring_dedup.remove_repeats(none).count() == 0


# --- near dedup


def brute_classes(rows, similarity=0.8):
    bag = []
    for _, t in rows:
        words = (t or "").lower().encode().translate(bag_minhash._FOLD).decode("utf-8").split()
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
        bag.append(collections.Counter(grams))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = sum((bag[i] & bag[j]).values())
            if bag[i] and bag[j] and common >= similarity * (sum(bag[i].values()) + sum(bag[j].values()) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(rows))]


def test_near_classes_equal_brute_force(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    chain = prose(9, 100)
    rows += [(100 + i, edited(chain, list(range(10, 10 + 9 * i, 9)))) for i in range(8)]
    rows += [(200 + i, edited(prose(10, 80), [int(x) for x in np.random.default_rng(i).choice(80, i % 5, replace=False)])) for i in range(30)]
    got = bag_minhash.near_classes(frame(spark, rows)).collect()
    root = brute_classes(rows)
    want = collections.Counter((rows[i][0], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]), root.count(root[i])) for i in range(len(rows)))
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))


def test_near_classes_of_nulls_and_nothing(docs, none):
    assert bag_minhash.near_classes(docs).count() == len(TEXTS)
    assert bag_minhash.near_classes(none).count() == 0
    assert bag_minhash.one_of_each(docs).columns == docs.columns


def test_signatures_estimate_weighted_jaccard():
    letters = " ".join("abcdefghijklmnopqrstuvwxyz")
    texts = [letters, letters.replace("k", "kk"), "x y " * 60, "x y " * 40]
    values = bag_minhash.signatures(*bag_minhash.bags(texts), len(texts), 4000)
    assert abs((values[0] == values[1]).mean() - 17 / 27) < 0.04
    assert abs((values[2] == values[3]).mean() - 76 / 116) < 0.04


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 0) for i in range(41)} | {(1000 + i, 1000) for i in range(30)}


# --- packing and token files


def expected_ids(text, end):
    return encoder(default_path()).library.encode(text or "", add_special_tokens=False).ids + [end]


ADDED = [
    "a <|endoftext|> b", "<|startoftext|>Über x<|endoftext|>", "A <|ENDOFTEXT|> b", "<|ENDOFTEXT|>東 b", "<|endoftext|>東 <|ENDOFTEXT|>é",
    "<|end of text|> <|endoftext |>", "a\x1c<|endoftext|>", "<|endoftext|><|endoftext|>", "Σ <|startoftext|>", " <|endoftext|>\n\tThe end",
]


def test_added_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    want = [library.encode(t, add_special_tokens=False).ids for t in ADDED]
    assert want[0] == [320, 49407, 321]
    assert [encoder(default_path()).encode(t).tolist() for t in ADDED] == want
    out = scratch_path(spark, "store")
    token_store.write_store(frame(spark, list(enumerate(ADDED))), out)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_documents(spark, out, ids=True).collect()}
    assert got == {i: [*ids, 1] for i, ids in enumerate(want)}


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_a_partition_of_all_ids(docs, capacity):
    rows = packing.pack(docs, capacity=capacity, classes=8).collect()
    sequences, documents = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] * 4 == len(r["ids"])
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0
        assert pieces[0]["padded_length"] == at
    assert sum(r["length"] for r in rows) == sum(len(expected_ids(t, 2)) for _, t in TEXTS)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append((r["start"], r["ids"]))
        documents[r["doc_id"]] += 1
    once = {i for i, n in collections.Counter(i for i, _ in TEXTS).items() if n == 1 and i is not None}
    for i, t in TEXTS:
        if i in once:
            assert b"".join(x for _, x in sorted(whole[i])) == np.array(expected_ids(t, 2), "<u4").tobytes()


def test_packing_pads_nothing_and_cuts_little():
    rng = np.random.default_rng(0)
    packer, out = packing.Harmonic(), []
    for i in range(3000):
        out += list(packer.add(i, np.zeros(int(rng.integers(1, 6000)), np.uint16)))
    out += list(packer.finish())
    sizes = [sum(len(p[2]) for p in s) for s in out]
    assert sum(s != 4096 for s in sizes) <= 12 and all(s & (s - 1) == 0 for s in sizes)
    assert sum(map(len, out)) < 3000 + 2 * len(out)


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_store.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_store.unpack_bits(packed, bits, 0, 1001) == ids).all()
    assert (token_store.unpack_bits(packed, bits, 333, 100) == ids[333:433]).all()


def test_token_store_round_trip(spark, docs):
    out = scratch_path(spark, "store")
    token_store.write_store(docs, out, block_ids=500)
    got = sorted(token_store.read_documents(spark, out, ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None, None]
    want = collections.Counter((i, np.array(expected_ids(t, 1), "<u4").tobytes()) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    block = spark.read.parquet(out).orderBy("shard", "block").first()
    part = token_store.read_range(spark, out, block["shard"], block["first"] + 3, 5)
    assert (part == token_store.unpack_bits(block["payload"], block["bits"], 3, 5)).all()


def test_token_store_of_nothing(spark, none):
    out = scratch_path(spark, "store")
    token_store.write_store(none, out)
    assert token_store.read_documents(spark, out).count() == 0


def test_separator_scan_equals_lengths(spark, docs):
    out, order = scratch_path(spark, "flat"), scratch_path(spark, "order")
    separator_scan.write_flat(docs, out, order, block_bytes=256)
    counted = separator_scan.count_tokens(separator_scan.flat_blocks(spark, out)).join(spark.read.parquet(order), ["file", "doc_no"])
    want = collections.Counter((i, len(expected_ids(t, 1)) - 1) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == want


def test_separator_scan_of_raw_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9] + [3] * 50 + [9, 4, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = separator_scan.count_tokens(separator_scan.raw_blocks(spark, str(tmp_path), block_bytes=8), end=9).collect()
    assert sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in got) == [(0, 0, 2), (1, 3, 0), (2, 4, 1), (3, 6, 50), (4, 57, 2)]


# --- byte BPE


def test_byte_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.byte_bpe(default_path(byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = byte_bpe.encode(docs, offsets=True).collect()
    want = collections.Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab1 !'sdtmrevl\n\t é漢"), 25)) for _ in range(2000)] + ["", " ", "ab" * 3000, "'" * 9]
    ids, count, _, _ = bpe.encode_many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [library.encode_ordinary(t) for t in texts]
    assert bpe.decode_many(ids, count) == [t.encode() for t in texts]


# --- licences


def test_license_scan_finds_texts_and_lines(docs, none):
    got = licenses.license_scan(docs).collect()
    assert {(r["doc_id"], r["line_no"], r["licence"]) for r in got if r["licence"]} == {(12, 0, "MIT"), (13, 2, "MIT")}
    assert sum(r["line_no"] == 0 for r in got) == len(TEXTS)
    assert licenses.license_scan(none).count() == 0


def test_license_scan_stays_native(docs):
    assert "Python" not in (plan := licenses.license_scan(docs)._jdf.queryExecution().toString()) and "Arrow" not in plan


WHOLE = {
    "Apache-2.0": "you may not use this file except in compliance", "BSD-2-Clause": "Redistributions in binary form", "BSD-3-Clause": "3. Neither the name",
    "GPL-2.0-only": "Version 2, June 1991", "GPL-3.0-only": "Version 3, 29 June 2007", "LGPL-2.1-only": "Version 2.1, February 1999",
    "LGPL-3.0-only": "GNU LESSER GENERAL PUBLIC LICENSE", "MPL-2.0": "Mozilla Public License", "Unlicense": "free and unencumbered", "ISC": "Permission to use",
}


def test_license_scan_finds_whole_licences_and_notices(spark):
    texts = []
    for name, part in WHOLE.items():
        one = max((t for n, t in licenses.default_known() if n == name and part in t), key=len)
        texts.append((name, "Copyright (c) 2020 Someone\r\n\r\n" + one.replace("\n", "\r\n")))
    notices = [
        ("GPL-2.0-only", "This work is licensed under the GNU General Public Licence, version 2."),
        ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
        ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause"),
        (None, "Licensed under nothing."),
    ]
    texts += [(n, f"some prose\n{t}\n") for n, t in notices]
    got = licenses.license_scan(frame(spark, [(i, t) for i, (_, t) in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["licence"] for r in got if r["licence"]} == {i: n for i, (n, _) in enumerate(texts) if n}
    whole = {r["doc_id"] for r in got if r["licence"] and r["line_no"] == 0}
    assert whole == set(range(len(WHOLE)))
    digests = {}
    for name, text in licenses.default_known():
        digests.setdefault(text, set()).add(name)
    assert all(len(n) == 1 for n in digests.values())


@pytest.mark.parametrize("large", [False, True])
def test_license_scan_takes_a_table(spark, docs, monkeypatch, large):
    from gridspan.plans import joins

    if large:
        monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    known = spark.createDataFrame([("X-1", PASSAGE.upper() + "."), ("X-2", "Two,\n words"), ("X-3", " . "), ("X-4", None), (None, "two words")], "licence string, text string")
    got = licenses.license_scan(docs, known).collect()
    assert {(r["doc_id"], r["line_no"], r["licence"]) for r in got if r["licence"]} == {
        (4, 1, "X-1"), (None, 0, "X-1"), (None, 1, "X-1"), (8, 0, "X-2"), (8, 1, "X-2")
    }
    assert sum(r["line_no"] == 0 for r in got) == len(TEXTS)


# --- neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 16)).astype("f4")
    points[100:140] = points[100]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(None, rows[0][1]), (5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] + [1.0] * 15), (7, rows[7][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hilbert_search.search(vectors, vectors.where("vec_id % 20 = 0"), block=128).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = points.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        score = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert len(found[q]) == 20
        hits += len(set(order) & {v for v, _ in found[q]})
        assert all(abs(s - score[v]) < 1e-9 for v, s in found[q])
        if 100 <= q < 140:
            assert [v for v, _ in found[q]] == order
    assert hits / 1500 >= 0.9
    assert set(found) == set(range(0, 1500, 20))


def test_neighbours_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = hilbert_search.search(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert hilbert_search.search(vectors.limit(0), vectors).count() == 0


# --- quality


def brute_marginals(model, emit):
    """Marginals of all label sequences of one document, counted out."""
    n = len(emit)
    total = np.zeros(n)
    z = 0.0
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        p = np.exp(sum(e for e, v in zip(emit, y) if v) + sum(model.switch[a, b] for a, b in zip(y, y[1:])))
        z += p
        total += p * np.array(y)
    return total / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    model = line_quality.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
    count = np.array([4, 0, 1, 6])
    features = rng.normal(size=(11, 3))
    _, good = model.raw_scores(features, np.ones(11), count)
    emit = features @ model.weights
    want = np.concatenate([brute_marginals(model, e) for e in np.split(emit, np.cumsum(count)[:-1]) if len(e)])
    assert np.allclose(good, want)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = line_quality.fit(docs, labels)
    scored = line_quality.score(docs, model).join(labels, "doc_id").where(line_quality.held_out()).collect()
    good = np.array([r["score"] for r in scored if r["quality"] == 1])
    bad = np.array([r["score"] for r in scored if r["quality"] == 0])
    assert (good[:, None] > bad).mean() > 0.97
    assert line_quality.keep_good(docs, model).columns == docs.columns


def test_quality_of_nulls_and_nothing(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = line_quality.fit(docs, labels)
    got = line_quality.score(docs, model, lines=True).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert line_quality.score(none, line_quality.fit(none, labels.limit(0))).count() == 0


# --- pipeline


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs, kept = raw, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.dtypes == raw.dtypes
        kept.append([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    good, exact, near, cut = kept
    assert {squeezed(t) for _, t in exact} == {squeezed(t) for _, t in good} and len({squeezed(t) for _, t in exact}) == len(exact)
    root = brute_classes(exact)
    assert {i for i, _ in near} == {min(exact[j][0] for j in range(len(exact)) if root[j] == r) for r in set(root)}
    want = {i: w for i, n, g, w in brute_spans(near, 13) if not n or g < n}
    assert {i: " ".join(WORD.findall(t or "")) for i, t in cut} == want
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert sum(r["length"] for r in pieces) == sum(len(expected_ids(t, 2)) for _, t in cut)


def test_digest_queries_follow_the_contract(spark, sf):
    from gridspan.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    want = {(i, n, g, hashlib.sha256(w.encode()).hexdigest()) for i, n, g, w in brute_spans(list(texts.items()), 13)}
    got = QUERIES["op1_substring_dedup"](spark, sf).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


# --- what once went wrong


def test_letters_that_compose_in_lower_case_are_the_library_s():
    tool = encoder(default_path())
    rng = np.random.default_rng(3)
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30C, 0x323, 0x327, 0x328, 0x331)]
    letters = list("aAbdDhHiIjJkKnNoOsStTuUwWyYzZ") + ["ß", "İ", "ı", "Σ", "ς", "Å", "ǰ", "가", "é"]
    texts = ["J̌ordan", "H̱at", "T̈e W̊a"]
    for _ in range(3000):
        parts = []
        for _ in range(int(rng.integers(1, 12))):
            parts.append(str(rng.choice(letters)))
            if rng.random() < 0.4:
                parts.append(str(rng.choice(marks)))
            if rng.random() < 0.2:
                parts.append(" ")
        texts.append("".join(parts))
    for text in texts:
        assert tool.encode(text).tolist() == tool.library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_caches_forget_by_bytes():
    small = type(encoder(default_path()))(default_path(), cache_bytes=20_000)
    words = [f"word{i % 700} {prose(i, 3)}" for i in range(3000)]
    for text in words:
        assert small.encode(text).tolist() == encoder(default_path()).encode(text).tolist()
    assert len(small._words) + len(small._words.older) < 400
    small.forget()
    assert not small._words and not small._words.older


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def test_long_words_of_one_polynomial_hash_differ(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    for size in (256, 511, 512, 513, 1024):
        a, b = one[:size], two[:size]
        rows = [(1, f"{PASSAGE} {a}"), (2, " ".join(PASSAGE.split()[-12:]) + f" {b}"), (3, " ".join(PASSAGE.split()[-12:]) + f" {a}")]
        got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
        assert collections.Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["kept_text"] or ""))) for r in got) == brute_spans(rows, 13)


def test_word_codes_follow_contents_only():
    from gridspan.llm.common import Words

    texts = [b"a bb ccccccc dddddddd eeeeeeeee " + b"f" * 16 + b" " + b"g" * 17, b"x a  bb\tccccccc\ndddddddd eeeeeeeee " + b"f" * 16 + b" " + b"g" * 17, b"", b"\n a"]
    words = Words(texts)
    found = {}
    for start, end, code in zip(words.start, words.end, words.code):
        assert found.setdefault(bytes(words.data[start:end]), code) == code
    assert len(set(found.values())) == len(found) == 8


def templates(n, edits, seed=9):
    rng = np.random.default_rng(seed)
    base = prose(seed, 60).split()
    out = []
    for i in range(n):
        words = list(base)
        for p in rng.choice(len(words), edits, replace=False):
            words[p] = f"edit{i}x{p}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("edits", [1, 2])
def test_templates_are_not_compared_with_each_other(spark, monkeypatch, edits):
    compared = []
    verified = bag_minhash._verified

    def counted(pairs, held, similarity):
        compared.append(pairs.count())
        return verified(pairs, held, similarity)

    monkeypatch.setattr(bag_minhash, "_verified", counted)
    rows = list(enumerate(templates(300, edits)))
    got = bag_minhash.near_classes(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(brute_classes(rows)))
    assert sum(compared) < 10 * len(rows), compared


def test_classes_of_shared_passages_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    passages = [prose(500 + i, 30) for i in range(6)]
    rows = [(i, " ".join(passages[j] for j in rng.permutation(6)[: int(rng.integers(2, 6))]) + f" own{i} words{i}") for i in range(80)]
    got = bag_minhash.near_classes(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(brute_classes(rows)))


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    near = edited(BASE, [60])
    rows = [(None, BASE), (None, near), (None, prose(70, 50)), (None, prose(70, 50)), (4, prose(71, 50)), (4, edited(prose(71, 50), [49])), (4, prose(72, 50)), (5, prose(72, 50)), (6, None), (6, "")]
    kept = bag_minhash.one_of_each(frame(spark, rows)).collect()
    found = collections.Counter((r["doc_id"], r["text"]) for r in kept)
    assert sum(found[(None, t)] for t in (BASE, near)) == 1
    assert found[(None, prose(70, 50))] == 1
    assert found[(4, prose(71, 50))] + found[(4, edited(prose(71, 50), [49]))] == 1
    assert found[(4, prose(72, 50))] == 1 and (5, prose(72, 50)) not in found
    assert max(found.values()) == 1


def test_copies_from_many_tasks_are_put_together_first(spark, monkeypatch):
    """One text in every partition: its copies do not fit a bucket together."""
    merged = []
    merge = exact_dedup._merged_copies
    monkeypatch.setattr(exact_dedup, "_merged_copies", lambda parts, sizes, limit: merged.append(sizes.where(exact_dedup.F.col("n_bytes") * exact_dedup.F.col("tasks") > limit).count()) or merge(parts, sizes, limit))
    rows = [(i, BASE if i % 3 else f"own text {i}") for i in range(90)] + [(5, BASE), (None, BASE), (None, "own text 0")]
    df = spark.createDataFrame([(i, t, "r", 1, 2, "d", 3) for i, t in rows], SCHEMA).repartition(30)
    got = exact_dedup.copy_groups(df, bucket_bytes=2000, table_bytes=500).collect()
    assert merged == [1]
    sizes = collections.Counter((r["keep_id"], r["group_size"]) for r in got if r["kept"])
    assert sizes[(1, 62)] == 1 and sizes[(0, 2)] == 1 and len(sizes) == 31 and len(got) == 93
    assert exact_dedup.drop_copies(df).count() == 31


# --- empty tables and clashing columns


def test_empty_tables_give_no_rows(spark, none):
    assert packing.pack(none).count() == 0
    assert byte_bpe.encode(none).count() == 0
    out, order = scratch_path(spark, "flat"), scratch_path(spark, "order")
    separator_scan.write_flat(none, out, order)
    assert separator_scan.count_tokens(separator_scan.flat_blocks(spark, out)).count() == 0
    assert spark.read.parquet(order).count() == 0


def test_neighbours_with_clashing_columns(spark):
    rows = [(i, [float(i), 1.0, 0.5], "q", 7, 1, 0.5, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int, rep long, score double, curve int")
    got = hilbert_search.search(df, df.where("vec_id = 3"), k=4)
    assert [(r["rank"], r["vec_id"]) for r in got.orderBy("rank").collect()] == [(1, 29), (2, 28), (3, 27), (4, 26)]
