import random
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import packing
from sparkloom.llm import queries as llm
from tests.llm.cases import ODD
from tests.llm.test_codecs import check_pieces
from tests.llm.test_models import plain_bayes
from tests.llm.test_search import brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and small green house river stone was near with that light from", "fr": "le la les petit maison avec pour dans une vert pierre lumière que qui"}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(61):
        lang = rng.choice(sorted(WORDS))
        words = [rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "a", f"{i}"]) for _ in range(70)]
        rows.append([f"{' '.join(words[:30])}\n{' '.join(words[30:])}", lang])
    rows[60][0] += " password=verysecret99 login=bob"
    rows += [[rows[3][0], "en"], [rows[4][0] + " end", rows[4][1]], ["a b c " * 40, "en"]]
    rows += [[t[1] if isinstance(t, tuple) else t, "en"] for t in ODD]
    return [(i, text, lang, "s", None if text is None else len(text)) for i, (text, lang) in enumerate(rows)]


def by_sql(name, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    return con.execute(llm.oracle_sql()[name]).df()


def brute_pipeline(rows):
    """The texts that reach the last stage, by SQL and plain loops."""
    kept = by_sql("op2_quality_rules", rows)
    rows = [r for r in rows if r[0] in set(kept[kept["kept"]]["doc_id"])]
    found = plain_bayes([(r[0], r[1], r[2]) for r in rows])
    rows = [r for r in rows if found[r[0]][0] != "und" and found[r[0]][1] >= 0.5]
    classes = brute_classes([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    spans = {r["doc_id"]: r["spans"] for _, r in by_sql("op5_secret_scan", rows).iterrows()}
    out = []
    for doc_id, text, *_ in rows:
        clean, last = [], 0
        for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[doc_id].split(",") if x):
            if a >= last:
                clean += [text[last:a], "[REDACTED]"]
            last = max(last, b)
        out.append((doc_id, "".join([*clean, text[last:]])))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = brute_pipeline(rows)
    assert len(texts) > 40 and any("[REDACTED]" in t for _, t in texts)
    assert {r["doc_id"] for r in found} == {i for i, _ in texts}
    check_pieces(found, texts)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, text in texts:
        ids = [x for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_packing_over_several_tasks(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["stone", "river", "x1", "don't", "Größe.", "0"]) for _ in range(rng.choice([3, 200, 900, 2500, 6000]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(df).collect()
    _, padding = check_pieces(rows, list(enumerate(texts)))
    assert padding <= 5 * 4096
    windows = {(r["step_group"], r["sequence_id"]): r["window"] for r in rows}
    sizes = Counter()
    for (step, _), window in windows.items():
        sizes[step] += window
    assert max(sizes.values()) <= packing.STEP and list(sizes.values()).count(packing.STEP) >= len(sizes) - 2 * 5
