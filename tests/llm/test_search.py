import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from sparkloom.llm import order_minhash as near
from sparkloom.llm._words import shingles, word_hashes
from sparkloom.llm.secret_scan import secret_scan
from sparkloom.llm.top_k import top_k
from sparkloom.session import materialize
from tests.llm.cases import ODD, docs


def plain_top(rows, every, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(256 * np.array(v, np.float32).astype(float))))
    out = []
    for q, a in {i: v for i, v in good if i % every == 0}.items():
        n = lambda b: min(len(a), len(b))
        scored = sorted((-int(a[: n(b)] @ b[: n(b)]), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(5)]  # ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2050, [0.0] * 8), (2051, [1.0] * 3), (2100, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    assert sorted(map(tuple, top_k(df).collect())) == plain_top(rows, 50, 5)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(df.where("vec_id = 1")).count() == 0
    assert top_k(df.where("vec_id IN (50, 51)")).count() == 1


def test_top_k_in_several_blocks(spark, monkeypatch):
    from sparkloom.llm import top_k as module

    monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    monkeypatch.setattr(module, "HEAD", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, every=3).collect())) == plain_top(rows, 3, 5)


def test_top_k_of_many_components(spark, monkeypatch):
    from sparkloom.llm import top_k as module

    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=23) * np.linspace(3, 0.1, 23)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for basis, gram in ((512, 1 << 22), (5, 1 << 22), (512, 50)):  # one rotation, runs of coordinates, runs of two
        monkeypatch.setattr(module, "BASIS", basis)
        monkeypatch.setattr(module, "GRAM", gram)
        monkeypatch.setattr(module, "PAIR_BYTES", 4_000)
        monkeypatch.setattr(module, "BLOCK_BYTES", 8 * 23 * 11)
        assert sorted(map(tuple, top_k(df, every=10).collect())) == plain_top(rows, 10, 5)
    wide = [(i, rng.normal(size=5_000).tolist()) for i in range(12)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, every=6).collect())) == plain_top(wide, 6, 5)


def brute_classes(rows):
    """Smallest id of each class of equal word sequences and of pairs that align."""
    kmers, parent = {}, {}
    for i, text in rows:
        if i is not None:
            w = word_hashes(text or "")
            kmers.setdefault(i, shingles(w, near.WORDS))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    index, shared = defaultdict(list), Counter()
    for i, k in kmers.items():
        for x in k.tolist():
            for j in index[x]:
                shared[j, i] += 1
            index[x].append(i)
    for a, b in shared:
        if near.aligned(kmers[a], kmers[b]) > 0:
            link(a, b)
    return {i: find(i) for i in kmers}


def near_corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(25):
        words = [word() for _ in range(rng.randint(80, 200))]
        if base % 2:
            words[10:10] = passage
        rows.append((100 * base, " ".join(words)))
        for copy in range(rng.choice([1, 2, 30 if base == 3 else 3])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                edited[rng.randrange(len(edited))] = word()
            rows.append((100 * base + copy + 1, rng.choice([" ", "\n"]).join(edited).upper() + rng.choice(["", "!"])))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    found = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_classes(rows)
    assert len(set(found.values())) < len(found)


def brute_row_classes(rows):
    """Per row the least id of its text's class, and a name of that class; texts are nodes whatever their ids."""
    nodes = {}
    for i, text in rows:
        nodes.setdefault(word_hashes(text).tobytes(), (len(nodes), text))
    classes = brute_classes([(k, text) for k, text in nodes.values()])
    at = [classes[nodes[word_hashes(text).tobytes()][0]] for _, text in rows]
    least = {c: min(i for (i, _), x in zip(rows, at) if x == c) for c in set(at)}
    return [least[c] for c in at], at


def test_ids_that_repeat(spark):
    three = [(0, "text b of some words"), (1, "text a of other words"), (1, "text b of some words")]
    found = sorted(map(tuple, near.near_duplicates(docs(spark, three)).collect()))
    assert found == [(0, 0), (1, 0), (1, 1)]
    kept = near.near_duplicate_filter(docs(spark, three)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(three[:2])
    rng = random.Random(12)
    rows = [(rng.randrange(25), text) for _, text in near_corpus() for _ in range(rng.choice([1, 1, 2]))]
    rows += rng.sample(rows, 20)
    df = docs(spark, rows)
    least, names = brute_row_classes(rows)
    assert sorted(map(tuple, near.near_duplicates(df).collect())) == sorted((i, c) for (i, _), c in zip(rows, least))
    kept = [(r["doc_id"], r["text"]) for r in near.near_duplicate_filter(df).collect()]
    assert len(kept) == len(set(names))
    assert {dict(zip(rows, names))[k] for k in kept} == set(names)


def test_filter_with_full_bit_sets(spark, monkeypatch):
    from sparkloom.llm import _bits

    monkeypatch.setattr(_bits, "LEAST_BITS", 64)
    monkeypatch.setattr(_bits, "MOST_BITS", 64)
    rows = near_corpus()
    expected = set(brute_classes(rows).values())
    assert {r["doc_id"] for r in near.near_duplicate_filter(docs(spark, rows)).collect()} == expected


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # a crowd around one text, below the similarity, in which each has a twin
        one = list(base)
        for at in rng.sample(range(110), 3):
            one[at] = f"x{rng.random()}"
        rows += [" ".join(one), " ".join([*one[:-1], f"y{i}"])]
    rows = list(enumerate(rows))
    used = []
    kept = near._neighbours
    monkeypatch.setattr(near, "_neighbours", lambda rows, *rest: used.append(rows.count()) or kept(rows, *rest))
    monkeypatch.setattr(near, "SMALL", 4)
    found = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs(spark, rows)).collect()}
    assert used[0] > 0
    assert found == brute_classes(rows)


def test_large_buckets_compare_all_members(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 300  # texts 2k and 2k + 1 link and share sketches 0 and 6; in every other sketch all differ
    marks = rng.integers(1, 1 << 62, (n, near.SKETCHES))
    marks[:, 0] = 5
    marks[1::2, 6] = marks[::2, 6]
    kmers = rng.integers(0, 1 << 32, (n, 50)).astype("<u4")
    kmers[1::2, 1:] = kmers[::2, 1:]
    who = [((i, 50), 0, 5, n, 50 * n, i) for i in range(n)]
    rows = spark.createDataFrame(who, "who struct<id:long,n:long>, t int, key long, size long, mass long, label long")
    seqs = spark.createDataFrame([(i, bytearray(k.tobytes())) for i, k in enumerate(kmers)], "id long, seq binary")
    brief = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(marks)], "id long, sketch array<long>")
    for block, kmers in ((32, 1 << 19), (1024, 1 << 19), (1024, 2_000)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "BLOCK_KMERS", kmers)
        found = near._neighbours(rows, seqs, brief, near.LEAST).collect()
        assert sorted(map(tuple, found)) == [(i + 1, i) for i in range(0, n, 2)]


def test_near_duplicates_odd_texts(spark):
    texts = [*ODD, "one"]
    df = docs(spark, texts)
    rows = near.near_duplicates(df).collect()
    assert len(rows) == len(texts)
    found = defaultdict(set)
    for r in rows:
        found[r["doc_id"]].add(r["class_id"])
    assert found[None] == {None} and found[2] == {2} and found[3] == {3} and found[12] == {4}
    kept = near.near_duplicate_filter(df)
    assert kept.columns == df.columns
    texts = sorted(r["text"] or "" for r in kept.collect() if r["doc_id"] == 1)
    assert texts == ["", "the same text of a row"]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_alignment_counts_matches_in_order():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, a) == 1.0
    moved = np.concatenate([a[50:], a[:50]])
    assert near.aligned(a, moved) == 0.0
    cut = np.concatenate([a[:45], a[55:]])
    assert near.aligned(a, cut) == 0.9
    assert near.aligned(a, a[:79]) == 0.0 and near.aligned(a, a[:80]) == 0.8


def test_pipeline_stages(spark):
    rng = random.Random(1)
    words = "the of and small green house river stone was near with that light from".split()
    good = [" ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) + str(i) * (k % 3 == 0) for k in range(60)) for i in range(30)]
    texts = [*ODD, *good, good[0], good[1] + " extra", good[2] + " password=verysecret99"]
    df = docs(spark, texts, start=1).select("doc_id", "text", "lang", "source", "n_chars")
    now, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = materialize(stage(spark, now, ""), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == df.columns
            assert now.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    ids = {r["doc_id"] for r in seen["quality_rules"].collect()}
    assert {len(ODD) + 1 + i for i in range(30)} <= ids
    left = seen["near_duplicates"]
    expected = brute_classes([(r["doc_id"], r["text"]) for r in seen["language_id"].collect()])
    assert {r["doc_id"] for r in left.collect()} - {None} == set(expected.values())
    assert seen["secret_scan"].count() == left.count()
    assert secret_scan(seen["secret_scan"]).where("n_assign > 0").count() == 0
    assert {r["doc_id"] for r in seen["packing"].collect()} == {r["doc_id"] for r in seen["secret_scan"].collect()}
