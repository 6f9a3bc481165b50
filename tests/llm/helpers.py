"""Small frames with the awkward cases every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score string, n_words string"


def odd_docs(spark):
    long = "the quick brown fox jumps over the lazy dog again and " * 6000
    texts = [None, "", "   \n\t ", "one", "one two", "same words here for two rows " * 6, "same words here for two rows " * 6, long, "Ünï cödé — 漢字 𝔘 " * 12, "x" * 50_000]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", None, "k", "c", "s", "n") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id " * 8, "en", "s0", 1, None, None, None, None), rows[5], (5, "another text of the same id " * 5, "de", "s1", 2, "", "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=((5, 1, 0), (5, 1, 1), (7, 0, 1), (None, 1, 1), (99, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
