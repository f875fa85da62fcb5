import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Names that operators give to columns of their own.
CLASHING = (
    "_gone _row _keep0 _keep1 _id _h _text _words _nth _cuts _masked _changed _bad _times _sha1 _c _salt _rank "
    "_new _run _line _grams _windows _places rep component value step part row piece length ids print"
).split()


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as documents, with further columns that clash with results."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, h int"
        full = [(i, t, "en", None, None if t is None else len(t), 7, "x", 1) for i, t in rows]
        docs = spark.createDataFrame(full, schema)
        return docs.select("*", *(F.lit(n).alias(name) for n, name in enumerate(CLASHING)))

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


#: Null, empty, blank, tied and repeated texts, and a long one.
EDGES = [
    (-1, None), (-2, ""), (-3, " \n\t "), (-4, "one two"), (-5, "one two"), (-5, "one two"),
    (None, "one two three four five six"), (-6, "word " * 30_000), (-7, "a b c d e\n" * 40),
]


@pytest.fixture
def edges():
    return EDGES
