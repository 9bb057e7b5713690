"""Fixtures shared by the operators' tests."""

#: Texts that every operator must take: null, empty, blank, one word, no letters, repeated, unusual characters, very long.
ODD_TEXTS = [None, "", " \n\t ", "word", "123 %%% ***", "a b c a b c a b c", "a b c a b c a b c", "Zażółć gęślą jaźń 你好 🙂 é", "line\nline\n\nline", "x" * 50_000, "the cat sat on the mat " * 4000]


def documents(spark, texts=ODD_TEXTS, langs=("en",), sources=("a", "b")):
    """Documents with nulls in every column, a repeated row and columns that clash with results' names."""
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or ""), -1, "x") for i, t in enumerate(texts)]
    rows += [(None, "null key", None, None, None, None, None), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string")


def nothing(spark):
    """An empty table of documents."""
    return documents(spark).filter("false")
