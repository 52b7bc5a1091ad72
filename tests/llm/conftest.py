import pytest

CLASH = "score double, piece int, fp long, length long, salt int, rank int, v string, next string, blk long, guest int, component_id long, held_out int, predicted int, spans string, shard int, block int, id long, __mark string, __id string, __gone long, __HASH string, mark string, row string, gone long, component string, label long"
ODD = [
    (1, "plain words stand here, and more of them. A second sentence."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "x" * 20000),
    (6, "ab " * 15000),
    (7, "plain words stand here, and more of them. A second sentence."),
    (7, "plain words stand here, and more of them. A second sentence."),
    (None, "a row without an id"),
    (None, None),
    (2**40, "日本語 テキスト 😀 é ▁ <|endoftext|> \x00 \x85 end"),
    (-3, "negative id.\n\nTwo line ends.\n"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with columns whose names clash with those that operators make."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(i, t, "en", "s", len(t or ""), *([None] * len(names))) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    from quarrymill.sources import read_table

    return read_table(spark, sf_dir, "documents")


@pytest.fixture(scope="session", autouse=True)
def _ready(spark):
    from quarrymill.sources import importable

    importable(spark)


def plan_of(df):
    return df._jdf.queryExecution().toString()
