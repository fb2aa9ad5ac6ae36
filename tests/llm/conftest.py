import pytest

AWKWARD = [
    (1, "a b c d e f g h i j k l m n o p q r s t"),
    (2, "x a b c d e f g h i j k l m y\tz"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one two three"),
    (7, "one two three"),
    (7, "one two three"),
    (None, "a b c d e f g h i j k l m n o p q r s t"),
    (9, "Straße ÉTÉ naïve 日本語 word " * 40),
    (10, "A B C D E F G H I J K L M N O P Q R S T"),
    (11, "a b c d e f g h i j k l m n o p q r s t"),
    (12, "w%d " * 30 % tuple(range(30))),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and repeated rows, ties, and other columns whose names an operator may use itself."""
    rows = [(i, t, "en", None, 0, 1, "b", 1.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, batch string, score double")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
