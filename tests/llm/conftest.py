import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the a of to and data model tree river house light number quick slow over under seven blue green über straße naïve 日本 слово don't it's x1 42 3.14 ... -- #tag $5 a|b <p> & ! ? e-mail".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents():
    """Texts with nulls in every column, empty and long ones, ties, repeated rows and ids."""
    r = random.Random(5)
    rows = [(k, prose(r, r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["web", "web", "web", "book", None]), k) for k in range(60)]
    rows += [(100, None, "en", "web", None), (101, "", "en", "web", 0), (102, " \n\t ", None, None, 3), (None, prose(r, 30), "en", "web", 1), (None, None, None, None, None)]
    base = prose(r, 200)
    rows += [(200 + k, base, "en", "web", 1) for k in range(4)] + [(210 + k, base + " extra" * k, "en", "book", 1) for k in range(3)]
    rows += [(3, rows[3][1], "en", "web", 1), rows[4], (5, "another text with the same id as before", "de", "web", 2)]
    rows += [(300, prose(r, 6000), "en", "web", 1), (301, "word " * 3000, "en", "web", 1), (302, "x" * 50_000, "en", "web", 1)]
    rows += [(310, "one", "en", "web", 1), (311, "one two", "en", "web", 1), (312, "ONE\ttwo\r\n", "en", "web", 1), (313, "naïve cafe thin 　 end  ", "en", "web", 1), (314, "I'll don't WE'VE 'sx ''s it'ſ  \n\n x", "en", "web", 1), (315, "ΟΔΟΣ Σ İstanbul ẞ ǅ ﬁ é", "el", "web", 1), (316, "<|endoftext|> and <|startoftext|>x", "en", "web", 1), (317, "a\x00b\x0b\x0cc\x1c\x1fd\u0085e", "en", "web", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_documents):
    """The same as a table, with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(odd_documents, SCHEMA)
    return d.select("*", F.lit("c").alias("text_length"), F.lit(1).alias("block"), F.lit("x").alias("slot"), F.lit(None).cast("string").alias("family"), F.lit(2).alias("score"), F.lit(3).alias("y"), F.lit(0).alias("n_words"), F.lit(True).alias("kept"), F.lit("h").alias("host"), F.lit(7).alias("label"), F.lit(1).alias("list"), F.lit(1).alias("x"), F.lit(1).alias("bucket"), F.lit(1).alias("carried")).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
