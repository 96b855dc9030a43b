"""SimHash, sketches and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sedimenta.llm import sketches, substrings
from sedimenta.llm.components import components
from sedimenta.llm.fm_index import Index
from sedimenta.llm.simhash import _from_middles, _from_postings, fingerprint, fingerprint_pairs, links, near_duplicates, one_of_each_group
from sedimenta.llm.similar import similar_documents


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """id -> smallest id reachable, over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("long_list", [4096, 2])
def test_links_of_crowded_fingerprints(spark, long_list):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0: 0, 1: (1 << 64) - 1}
    for c in centres:
        for _ in range(25):
            p = c
            for _ in range(rng.randint(0, 7)):
                p ^= 1 << rng.randrange(64)
            prints[len(prints)] = p
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    distinct = {p: min(i for i, q in prints.items() if q == p) for p in prints.values()}
    df = spark.createDataFrame([(signed(p),) for p in distinct], "fingerprint bigint")
    found = components(links(df, long_list)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = groups({i: p for p, i in distinct.items()})
    label = {i: root.get(signed(p), signed(p)) for p, i in distinct.items()}
    for a in label:
        for b in label:
            assert (label[a] == label[b]) == (want[a] == want[b])


@pytest.mark.parametrize("size", [70_000, 65_537, 1_000_000])
def test_rest_of_a_long_list_is_crowded(size):
    """More members than a run holds, then a tail shorter than ``long_list``, then other lists."""
    head, tail = np.arange(70_000) << 16, (np.arange(5) << 16) + (70_000 << 16)
    key = np.r_[np.full(70_005, 7), [8, 8, 9]]
    prints = np.r_[head, tail, [3, 2, 1]]
    cuts = [(k, k + size) for k in range(0, 70_000, size)] + [(70_000, 70_003), (70_003, 70_008)]
    batches = [pa.record_batch([pa.array(c[a:min(b, 70_000) if a < 70_000 else b]) for c in (np.zeros_like(key), key, prints)], names=["c", "k", "f"]) for a, b in cuts]
    found = [(int(a), None if b is None else int(b)) for xs, ys in _from_postings(4096)(batches) for a, b in zip(xs, ys)]
    assert {a for a, b in found if b is None} == set(head.tolist()) | set(tail.tolist())
    assert [(a, b) for a, b in found if b is not None] == [(2, 3)]
    middles = [pa.record_batch([b.column(1), b.column(2)], names=["m", "a"]) for b in batches]
    linked = {(int(a), int(b)) for xs, ys in _from_middles(middles) for a, b in zip(xs, ys)}
    assert linked == {(int(a), 0) for a in [*head[1:], *tail]} | {(2, 3)}


def test_simhash_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t"), (2, "One word"), (3, "one WORD"), (3, "one WORD"), (None, "alone and new"), (8, "É x"), (7, "é x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, fingerprint string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[5, "0" * 16] == by[9, "0" * 16] == 4
    assert [r.component_id for r in got if r.doc_id in (2, 3)] == [2, 2, 2]
    assert fingerprint("É x") != fingerprint("é x")
    assert near_duplicates(docs.limit(0)).collect() == []
    kept = one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 7, 8]


def jaccard_groups(texts):
    """id -> smallest id reachable over pairs of five-word Jaccard 0.8 or more, over all pairs with a common shingle."""
    sets, root, having = {}, {i: i for i in texts}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        words = texts[i].encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}
        for j in {j for s in sets[i] for j in having.get(s, ())}:
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    return {i: find(i) for i in texts}


def test_stage_keeps_one_of_each_group_by_similarity(spark):
    """On a table with pairs of Jaccard 0.8 or more that differ in more than four bits, and chains of edited copies."""
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(8)
    for k in range(40):
        words = [f"v{rng.randrange(10_000)}" for _ in range(rng.randint(5, 300))]
        for n in range(8):
            rows.append((1_000_000 + 10 * k + n, " ".join(words)))
            words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    want = jaccard_groups(dict(rows))
    assert {r.doc_id: r.component_id for r in similar_documents(docs).collect()} == want
    assert {r.doc_id for r in one_of_each_group(spark, docs, "").collect()} == set(want.values())


def test_stage_finds_pairs_by_fingerprints(spark, monkeypatch):
    """With bands that bring nothing together the index of fingerprints alone still finds the near copies."""
    from sedimenta.llm import similar
    from sedimenta.llm.super_minhash import described_sets, distinct_sets

    rows = [(10 * k + n, " ".join(f"v{k}x{i}" for i in range(20_000)) + " end" * n) for k in range(6) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() <= 4 for (i, a) in rows for (j, b) in rows if i // 10 == j // 10 and abs(i - j) == 1)
    nodes = distinct_sets(described_sets(docs, "doc_id", "text", 5), "doc_id")
    least = {r["key"]: r["least"] for r in nodes.collect()}
    assert {least[r.a] // 10 - least[r.b] // 10 for r in fingerprint_pairs(docs, nodes).collect()} == {0}
    alone = lambda *args: described_sets(*args).withColumn("bands", F.array(F.xxhash64("key")))
    monkeypatch.setattr(similar, "described_sets", alone)
    assert sorted(r.doc_id for r in one_of_each_group(spark, docs, "").collect()) == [0, 10, 20, 30, 40, 50]


def test_stage_keeps_one_row_without_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (5, b + " end"), (7, "alone"), (7, "alone"), (8, "alone"), (3, b), (3, b + " more"), (None, "x"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, key string")
    kept = one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t is not None and t.startswith("a0 ") for _, t in got) == 1
    assert [i for i, t in got if t is not None and t.startswith("b0 ")] == [3]
    assert sorted((i or 0, t or "") for i, t in got if t is None or t[1:2] != "0") == [(0, ""), (0, "x"), (7, "alone"), (7, "alone")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (301, 300), (300, 301)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 301: 300}
    assert components(edges.limit(0)).collect() == []


def plain_shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edited_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = docs.select(F.col("doc_id") * 3 - 40, "text").unionByName(spark.createDataFrame([(7, None), (1_000_000, "é"), (9, " ")], "`((doc_id * 3) - 40)` bigint, text string")).toDF("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in more.collect())
    got = {r.doc_id: r for r in sketches.edited_fingerprints(more.withColumn("bucket", F.lit("x")).repartition(5)).collect()}
    assert len(got) == len(rows)
    memory, errors = sketches.Hashes(), []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        kept = [sketches.sketch(t, memory) for t in (text, edited, after)]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(sketches.spelled, kept[:2]))
        assert (r.near_edited, r.near_next) == (sketches.likeness(kept[0], kept[1]), sketches.likeness(kept[0], kept[2]))
        a, b = plain_shingles(text), plain_shingles(edited)
        if len(a) > 100 and len(b) > 100:
            errors.append(r.near_edited - len(a & b) / min(len(a), len(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_sketch_edge_cases(spark):
    one = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    (only,) = sketches.edited_fingerprints(one).collect()
    assert only.near_next == 1.0 and only.fingerprint
    assert sketches.edited_fingerprints(one.limit(0)).collect() == []
    same = spark.createDataFrame([(1, None), (1, ""), (None, "x y"), (2, "x y")], "doc_id bigint, text string")
    got = sketches.edited_fingerprints(same).collect()
    assert len(got) == 4 and {r.fingerprint for r in got if r.n_chars == 3} == {got[[r.n_chars for r in got].index(3)].fingerprint}
    assert sketches.likeness(np.zeros(0), np.zeros(0)) == 1.0


def plain_dedup(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        out[doc] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def substring_rows():
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    rows += [(200 + k, t) for k, (_, t) in enumerate(rows[:10])]
    line = " ".join(f"w{k}" for k in range(30))
    rows += [(300 + k, f"start{k} {line} end{k}\n\x0b{line}") for k in range(12)]
    return rows + [(400, "a " * 50 + "b " + "a " * 50), (401, "x y z w v " * 12), (402, None), (403, ""), (404, "\xa0 ".join("abcdefghijklmnopqrstuv"))]


@pytest.mark.parametrize("hot, shard_windows", [(20_000, 200_000), (2, 60)])
def test_substring_dedup(spark, hot, shard_windows):
    rows = substring_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n_words string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(docs, hot=hot, shard_windows=shard_windows).collect()}
    assert got == plain_dedup(rows)


def test_substring_dedup_on_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op7_substrings(spark, sf_dir).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in plain_dedup(rows).items()}


def test_substring_repeated_rows(spark):
    line = " ".join(map(str, range(25)))
    docs = spark.createDataFrame([(1, line), (1, line), (1, "q " + line), (None, line)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.substring_dedup(docs).collect())
    assert got == [(0, 25, 0), (1, 25, 25), (1, 25, 25), (1, 26, 25)]
    assert substrings.substring_dedup(docs.limit(0)).collect() == []


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 4, 400), 0, rng.integers(1, 4, 200), 0]
    order = rng.permutation(len(text))
    index = Index(text, order, 4)
    patterns = np.array([[a, b, c, d] for a in range(1, 4) for b in range(1, 4) for c in range(1, 4) for d in range(1, 4)])
    matched, least = index.matching(patterns)
    for pattern, m, first in zip(patterns.tolist(), matched.tolist(), least.tolist()):
        at = [k for k in range(len(text) - 3) if text[k:k + 4].tolist() == pattern]
        assert (m == 4) == (len(at) > 1)
        if len(at) > 1:
            assert first == min(order[at])
