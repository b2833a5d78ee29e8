"""Small document tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    """A documents table; ids default to the position."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)
