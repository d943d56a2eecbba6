import pytest

ODD_TEXTS = [None, "", " \n\t ", "one", "a b c d", "x " * 3000, "é ü 中文 🙂 " * 8]


#: Names that operators use inside or for results.
INTERNAL = ("_here", "_id", "_hash", "_key", "_stay_doc", "_doc", "_mark", "_text", "_k0", "_block", "_inside", "_first", "_n", "_number", "c0", "votes", "quality", "kept", "score", "lang_pred", "class_id", "class_key", "__doc", "mark", "runs", "sequence_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of trouble: nulls anywhere, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id but some words in here", None, None, None), (3, "one", "en", "s", 0), (3, "another text of the same id", None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    names = ("key", "doc", "bucket", "length", "start", "shard", "digest", "items", "_x", *INTERNAL)
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)


def vocabulary_text(rng, n, words=("the", "of", "reon", "thble", "and", "Ander", "stion,", "onwh.", "in", "eash", "ouble", "hent")):
    return " ".join(rng.choice(words) + rng.choice(("", "", "a", "er", "ti")) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return vocabulary_text
