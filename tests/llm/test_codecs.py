import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing
from sparkloom.llm.sentence_pieces import Codec, decode_documents, encode_documents, log_probabilities, mark, units_of
from tests.llm.cases import ODD, docs


@pytest.fixture(scope="module")
def codec():
    return Codec()


def exhaustive(vocabulary, text, n):
    """Scores of the n best paths over the whole text, from lists at every position."""
    m = mark(" " + text) if text else ""
    best = [[0.0]]
    for j in range(1, len(m) + 1):
        best.append(sorted((v + s for i, _, s in vocabulary.edges_back(m, j) for v in best[i]), reverse=True)[:n])
    return best[-1]


def test_nbest_is_exact_and_restores(codec):
    rng = random.Random(3)
    letters = ["a", "e", "t", "h", "n", " ", "  ", "é", "ß", "▁", "\n", "日", "\U0001f600", "!"]
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        found = codec.encode(text, 5)
        assert [s for s, _ in found] == pytest.approx(exhaustive(codec.vocabulary, text, 5))
        assert len({tuple(ids) for _, ids in found}) == len(found)
        for score, ids in found:
            assert codec.decode(ids) == text
            plain = [i for i in ids if i not in codec.vocabulary.byte_ids]
            if len(plain) == len(ids):
                assert score == pytest.approx(sum(codec.vocabulary.scores[i] for i in ids))


def test_encode_query(spark, codec):
    df = docs(spark, ODD)
    found = encode_documents(df).collect()
    assert len(found) == len(ODD) and all(r["restored"] for r in found)
    for r in found:
        text = {d["doc_id"]: d["text"] for d in df.collect()}[r["doc_id"]] if r["doc_id"] != 1 and r["doc_id"] is not None else None
        if text:
            score, ids = codec.encode(text)[0]
            assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
            assert r["score"] == pytest.approx(score)
    assert encode_documents(df.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, codec.encode("a b")[0][1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode_documents(rows).collect()} == {1: "a b", 2: None, 3: ""}


def test_encode_gives_ids_and_nbest(spark, codec):
    df = docs(spark, ["a stone by the river  and é", "", "q", "▁ mixed 😀 words"])
    rows = encode_documents(df)
    for r, d in zip(rows.orderBy("doc_id").collect(), df.orderBy("doc_id").collect(), strict=True):
        found = codec.encode(d["text"], 4)
        assert r["ids"] == found[0][1] and [x["ids"] for x in r["nbest"]] == [ids for _, ids in found]
        assert [x["score"] for x in r["nbest"]] == pytest.approx([score for score, _ in found])
    back = {r["doc_id"]: r["text"] for r in decode_documents(rows).collect()}
    assert back == {d["doc_id"]: d["text"] for d in df.collect()}


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The library's own unigram model with the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    for i, score in log_probabilities(path).items():
        model.pieces[i].score = score
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    out = tmp_path_factory.mktemp("model") / "unigram.model"
    out.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(out)), str(out)


def sample_texts():
    rng = random.Random(8)
    words = "the house of stone and rivers über Größe déjà números 1234 x= can't ▁ 日本 !!".split()
    made = [" ".join(rng.choice(words) + rng.choice(["", "", "er", "ing"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*made, "  two  spaces   three", "line\nbreak", "the house"]


def test_best_path_is_the_library_s(codec, unigram):
    library, path = unigram
    own = Codec(path)
    assert own.vocabulary.scores == pytest.approx(codec.vocabulary.scores, abs=1e-5)
    for text in sample_texts():
        if "▁" in text:
            continue  # the library takes a literal mark for a space
        (score, ids), expected = codec.encode(text)[0], library.encode(text)
        if ids != expected:  # the library adds up in single precision: only equal scores may part
            assert sum(codec.vocabulary.scores[i] for i in expected) == pytest.approx(score, abs=1e-4)
        assert own.encode(text)[0][1] == ids


def test_ties_take_the_longer_last_piece():
    codec = Codec()
    codec.vocabulary.scores = np.full_like(codec.vocabulary.scores, -1.0)
    for text in ("the", "therein", "stonewall rivers"):
        found = codec.encode(text, 30)
        tied = [len(codec.vocabulary.raw[ids[-1]]) for score, ids in found if score == found[0][0]]
        assert tied[0] == max(tied)


def test_known_words_are_kept_within_a_bound(monkeypatch):
    from sparkloom.llm import sentence_pieces

    monkeypatch.setattr(sentence_pieces, "CACHE", 20)
    small, plain = Codec(), Codec()
    for text in sample_texts()[:40]:
        assert small.encode(text, 3) == plain.encode(text, 3)


def test_units_cover_texts():
    for text in ("a  b", " x ", "   ", "q"):
        assert "".join(units_of(text)) == " " + text


def check_pieces(rows, texts):
    """Pieces against plain encoding: (doc_id, text) pairs in ``texts``."""
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    expected = defaultdict(list)
    for doc_id, text in texts:
        expected[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    total = 0
    for doc_id, every in expected.items():
        lengths = sorted(len(x) for x in every)
        own = [r for r in rows if r["doc_id"] == doc_id]
        assert sum(r["length"] for r in own) == sum(lengths)
        total += sum(lengths)
        if len(every) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                ids = every[0][r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and r["doc_tokens"] == len(every[0]) and r["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
                at += r["length"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return total, padding


def test_packing_odd_texts(spark):
    df = docs(spark, ODD).coalesce(1)
    rows = packing.pack_documents(df).collect()
    total, padding = check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert padding <= 4096
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_gives_token_ids(spark):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["the river and a stone", "", "river stone " * 3000]
    found = defaultdict(list)
    for r in sorted(packing.pack_documents(docs(spark, texts)).collect(), key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        found[r["doc_id"]] += r["ids"]
    assert found == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts, 1)}


def test_a_worker_keeps_the_words_met_first(monkeypatch):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    words = packing.WordEncoder(None)
    monkeypatch.setattr(packing, "CACHE", 60)
    monkeypatch.setattr(packing, "KEPT", 20)
    rng = random.Random(5)
    for i in range(30):
        texts = [" ".join([*["the", "stone,"][: 2 if i == 0 else 0], *(f"{rng.choice(['w', 'Größe', 'x0'])}{chr(97 + i % 26)}{rng.randrange(99)}!" for _ in range(25))]) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert "the" in words.known and len(words.known) <= 60 + 3 * 27 * 2
    words.forget()
    assert len(words.known) <= 20 and "the" in words.known


def test_a_task_of_packing_keeps_few_words(spark, monkeypatch):
    """The task's function, called in this process, and what the process holds after it."""
    text = " ".join(f"k{i}" for i in range(70_000))
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    run = packing.pack_documents(df)
    pieces = [n for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [0], "text": [text]})])) for n in b.column("length").to_pylist()]
    assert sum(pieces) > 70_000 and 0 < len(packing.encoder(None).known) <= packing.KEPT


def test_tiers_fill(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["stone", "river", "x1", "don't", "Größe.", "0"]) for _ in range(rng.choice([3, 200, 900, 2500, 6000]))) for _ in range(60)]
    df = docs(spark, texts).coalesce(1)
    rows = packing.pack_documents(df).collect()
    total, padding = check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert padding <= 4096 and total > 50_000
    steps = defaultdict(dict)
    for r in rows:
        steps[r["step_group"]][r["sequence_id"]] = r["window"]
    sizes = [sum(s.values()) for s in steps.values()]
    assert max(sizes) <= packing.STEP and sizes.count(packing.STEP) >= len(sizes) - 2


def test_pool_takes_the_longest_that_fits():
    pool = packing.Pool()
    for i, n in enumerate((5, 9, 2)):
        pool.put(i, 0, n)
    assert pool.take(8) == (0, 0, 5) and pool.take(1) is None and pool.tokens == 11
    assert packing.fill(pool, 10) == [(1, 0, 9), (2, 0, 1)] and pool.take(4) == (2, 1, 1)
