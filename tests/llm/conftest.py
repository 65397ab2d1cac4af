import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today."),
    (2, "the quick brown fox jumps over the lazy dog today."),
    (3, "The quick brown fox jumps over the lazy dog today."),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, LONG),
    (8, LONG),
    (9, "one two"),
    (10, "one two"),
    (None, "a row without an id"),
    (11, "naïve café 🌍 ÀÉ"),
    (11, "naïve café 🌍 ÀÉ"),
    (12, "12345 !!"),
]
#: Columns that clash with names the operators use or return.
CLASHES = ("kept", "score", "shard", "rate", "n_entities", "tokens")


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(i, t, "en", "src", *(["x"] * len(CLASHES))) for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
