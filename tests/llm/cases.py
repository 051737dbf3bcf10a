"""Documents with odd cells, shared by the tests of the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, __row string"


def docs(spark, texts, start=1):
    """Rows with clashing extra columns; a pair gives (doc_id, text)."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (start + i, t)
        rows.append((doc_id, text, "en", "s", None if text is None else len(text), "x", None, "y", "z"))
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977} and{i} the" for i in range(1_500))
ODD = [None, "", " \n\t ", "one", (None, "a text without an id the of and to"), "é" * 50, LONG, "the same text of a row", (1, "the same text of a row"), (1, "the same text of a row"), "日本 \U0001f600 ▁ mixed\x1ctext\x0b0 '0' x0x <|endoftext|> it's"]
