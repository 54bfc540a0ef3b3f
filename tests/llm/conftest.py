import pytest

LONG = "\n".join(f"row {k} tells of the {k * 7919 % 1000} boats that left the harbour before dawn" for k in range(4000))
TEXTS = [None, "", "   \n\t", "7 7 7", "one word", LONG, LONG, "the quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", "a\x1cb ΣΑΣ Straße don't", "\U0001f600 smile"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with names that clash."""
    rows = [(k, t, ["en", None][k % 2], ["src-1", None, "src-12"][k % 3], None if t is None else len(t), "x") for k, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "no id at all", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
