import pytest

LONG = " ".join(f"word{i % 997} {i}" for i in range(20_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 20),
    (2, "The quick brown fox jumps over the lazy dog. " * 20),
    (3, None),
    (4, ""),
    (5, " \n\t \n"),
    (6, "x"),
    (7, LONG),
    (7, LONG),
    (8, "<|endoftext|> a <|startoftext|>b tab\tand\u00a0nbsp  two   spaces\n\n\nlines don't 12,34 é\u0301 ß\u1e9e \u4f60\u597d \U0001f600"),
    (None, "a row without an id, but with words enough to be looked at like any other row of the table"),
    (9, "JUNK!! $$$ ### *** " * 60),
    (10, "same line\nsame line\nsame line\nother line of words\n" * 10),
]
#: Names that operators use for columns of their own.
CLASHING = "key n ids tid h fp row base word c pw_n pw_u pw_key_ start entry a b node root marks text_ label quality".split()


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) + ("clash",) * len(CLASHING) for k, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
