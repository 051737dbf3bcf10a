import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import language_id, quality_classifier
from sparkloom.llm._words import word_hashes
from tests.llm.cases import ODD, docs

WORDS = {"xx": "aba kaba taka", "yy": "mone sone lone", "zz": "ürü yürü sürü"}


def corpus(spark, n=120):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy_and_folds(spark):
    df = corpus(spark)
    found = language_id.language_id(df).join(df, "doc_id").collect()
    assert len(found) == 120
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


def test_held_out_labels_do_not_matter(spark):
    df = corpus(spark)
    changed = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'qq' ELSE lang END AS lang")
    a, b = (sorted(map(tuple, language_id.language_id(x).collect())) for x in (df, changed))
    assert a == b


def test_language_odd_texts(spark):
    model = language_id.train(corpus(spark))
    df = docs(spark, [*ODD, "123 !?"])
    found = language_id.language_id(df, model)
    assert found.count() == df.count()
    flat = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert flat[2] == flat[3] == flat[12] == "und"
    kept = language_id.language_filter(df, model)
    assert kept.columns == df.columns and kept.where("trim(text) = ''").count() == 0
    assert language_id.language_id(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def plain_grams(text):
    """N-grams of the runs of letters, one by one."""
    line = [0]
    for c in text or "":
        low = c.lower()
        if c.isalpha():
            line.append(ord(low) if len(low) == 1 else ord(c))
        elif line[-1]:
            line.append(0)
    line += [0] if line[-1] else []
    grams = [(x,) for x in line[1:]] + list(zip(line, line[1:])) + [g for g in zip(line, line[1:], line[2:]) if g[1]]
    return Counter(plain_bucket(g) for g in grams)


def plain_bucket(gram, buckets=language_id.BUCKETS):
    h = len(gram)
    for x in gram:
        h = (h + x) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return (h >> 17) & (buckets - 1)


def counted(texts, buckets=language_id.BUCKETS):
    out = [Counter() for _ in texts]
    for start, text, bucket, n in language_id.ngram_counts(texts, buckets):
        for i, b, c in zip(text.tolist(), bucket.tolist(), n.tolist()):
            out[start + i][b] += c
    return out


def test_ngram_counts_match_a_plain_count(monkeypatch):
    rng = random.Random(4)
    texts = [t[1] if isinstance(t, tuple) else t for t in ODD] + ["\U00030000 \U00031350", "Ab, cde!  FG 12 hé" * 3]
    texts += ["".join(rng.choice("abcÉ 1日\0") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    for chunk in (language_id.CHUNK, 50, 7, 2):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert counted(texts) == [plain_grams(t) for t in texts]


def test_long_texts_are_counted_whole():
    text = "Abc déf, ghi 12 " * 40_000
    assert len(text) > 2 * language_id.CHUNK
    assert counted([text, "x", None, text + "y"]) == [plain_grams(t) for t in (text, "x", None, text + "y")]


def plain_bayes(rows):
    """{id: (language, posterior)} of (id, text, lang) rows, counted one by one."""
    learnt = [(text, lang) for i, text, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    sums, size = defaultdict(Counter), Counter(lang for _, lang in learnt)
    for text, lang in learnt:
        sums[lang] += plain_grams(text)
    total = {lang: sum(c.values()) for lang, c in sums.items()}
    log = lambda lang, b: math.log((sums[lang][b] + 0.5) / (total[lang] + 0.5 * language_id.BUCKETS))
    out = {}
    for i, text, _ in rows:
        grams = plain_grams(text)
        if not grams or not size:
            out[i] = ("und", 0.0)
            continue
        score = {lang: math.log(size[lang] / len(learnt)) + sum(n * log(lang, b) for b, n in grams.items()) for lang in size}
        best = min(score, key=lambda x: (-score[x], x))
        out[i] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    return out


def test_bayes_matches_brute_force(spark):
    df = corpus(spark)
    expected = plain_bayes([tuple(r) for r in df.collect()])
    for r in language_id.language_id(df).collect():
        assert r["lang_pred"] == expected[r["doc_id"]][0]
        assert r["score"] == pytest.approx(expected[r["doc_id"]][1])


def test_language_ties_and_bounds(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("aa bb", "yy"), ("aa bb", "xx")] * 12)]
    df = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, text string, lang string")
    even = df.where("lang = 'xx'").limit(3).unionAll(df.where("lang = 'yy'").limit(3))
    model = language_id.train(even)
    assert model.predict(["aa", "bb", "1"]) [0] == ["xx", "xx", "und"]
    with pytest.raises(ValueError):
        language_id.train(df, most=1)


def quality_corpus(spark, n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("the of small green house and river stone".split()) + ("" if good else "###") for _ in range(rng.randint(15, 60))]
        rows.append((i, " ".join(words), None))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_accuracy(spark):
    d, labels = quality_corpus(spark)
    found = quality_classifier.quality_scores(d, labels).join(labels, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_quality_odd_texts(spark):
    d, labels = quality_corpus(spark, 60)
    model = quality_classifier.train(d, labels)
    df = docs(spark, ODD)
    found = quality_classifier.quality_scores(df, labels, model)
    assert found.count() == df.count() and all(0 <= r["score"] <= 1 for r in found.collect())
    assert quality_classifier.quality_scores(df, labels.limit(0)).first()["score"] == 0.5
    assert quality_classifier.quality_scores(df.limit(0), labels, model).count() == 0


def test_training_rows_keep_all_words():
    text = " ".join(f"word{i}" for i in range(5_000))
    index, value = quality_classifier.features(text, None)
    words = len(set((word_hashes(text) & np.uint64(quality_classifier.BUCKETS - 1)).tolist()))
    assert words > 4_000 and len(index) == words + len(quality_classifier.STATISTICS)
    assert value[:words] == pytest.approx(1 / np.sqrt(words))


def test_fit_matches_plain_gradients(monkeypatch):
    """Adam on the loss, its gradient taken pair by pair."""
    q = quality_classifier
    monkeypatch.setattr(q, "EPOCHS", 3)
    monkeypatch.setattr(q, "BATCH", 16)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        index = np.sort(rng.choice(30, 5, replace=False))
        rows.append((index, rng.uniform(0.2, 0.6, 5), float((index < 9).sum() > 1)))
    model = q.fit(rows, seed=5)

    rng = np.random.default_rng(5)
    theta = np.zeros((q.FEATURES + 1, q.RANK + 1))
    theta[:-1, 1:] = rng.normal(0, 0.02, (q.FEATURES, q.RANK))
    share = np.mean([y for _, _, y in rows])
    theta[-1, 0] = np.log(share / (1 - share))
    first, second, t = defaultdict(float), defaultdict(float), 0
    for _ in range(3):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 16):
            part, grad = [rows[i] for i in order[at : at + 16]], defaultdict(float)
            for index, value, y in part:
                pairs = sum(theta[i, 1:] @ theta[j, 1:] * x * z for a, (i, x) in enumerate(zip(index, value)) for j, z in list(zip(index, value))[:a])
                error = (1 / (1 + np.exp(-(theta[-1, 0] + theta[index, 0] @ value + pairs))) - y) / len(part)
                grad[q.FEATURES, 0] += error
                for i, x in zip(index, value):
                    grad[i, 0] += error * x
                    for k in range(1, q.RANK + 1):
                        grad[i, k] += error * x * sum(theta[j, k] * z for j, z in zip(index, value) if j != i)
            t += 1
            for (i, k), g in grad.items():
                g += q.DECAY * theta[i, k] if i != q.FEATURES else 0
                first[i, k] = 0.9 * first[i, k] + 0.1 * g
                second[i, k] = 0.999 * second[i, k] + 0.001 * g * g
                theta[i, k] -= q.RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first[i, k] / (np.sqrt(second[i, k]) + 1e-8)
    assert model.bias == pytest.approx(theta[-1, 0])
    assert model.linear == pytest.approx(theta[:-1, 0], abs=1e-9)
    assert model.factors == pytest.approx(theta[:-1, 1:], abs=1e-9)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality_classifier.Model(0.1, rng.normal(size=quality_classifier.FEATURES), rng.normal(size=(quality_classifier.FEATURES, quality_classifier.RANK)) * 0.1)
    index, value = quality_classifier.features("some words of a text with words", 12.0)
    pairs = sum(float(model.factors[i] @ model.factors[j]) * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[:a])
    margin = 0.1 + float(model.linear[index] @ value) + pairs
    assert model.score("some words of a text with words", 12.0) == pytest.approx(1 / (1 + np.exp(-margin)))
