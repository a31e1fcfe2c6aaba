import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """The session with a checkpoint folder and the package on the executors."""
    from modelward.session import ensure_checkpoint_dir, ship_package

    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


LONG = "word " * 120_000 + "x" * 300_000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "b"), (1, "Alpha beta gamma delta epsilon zeta.", "b"), (2, None, None), (3, "", "a"), (4, " \t\n ", "a"),
    (5, "Alpha  beta gamma delta epsilon zeta.", None), (None, "alpha BETA", "a"), (None, None, "a"), (6, "é😀 <|endoftext|> 'tis so", "a"), (7, LONG, "b"), (8, LONG, "b"),
]
#: Names that operators use inside or return.
EXTRA = "id long, size long, target double, taken long, component string, kept boolean, score double, label int, mark long, `_text` string, `_key` string, `_size` int, start long, words string"


@pytest.fixture(scope="session")
def odd(corpus):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    width = EXTRA.count(",") + 1
    return corpus.createDataFrame([(*r, *[None] * width) for r in ROWS], f"doc_id long, text string, source string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(corpus):
    return corpus.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
