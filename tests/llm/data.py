"""Rows with all that operators have to bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"line {i % 700} of a very long text, with some words in it: {i * i}" for i in range(30_000))
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards mix boxes of dark liquor jugs near a quiet village by some old river".split()
PROSE = " ".join(WORDS[i * 7 % len(WORDS)] + ("." if i % 11 == 0 else "") for i in range(160))

ROWS = [
    (1, "One line here, long enough\nAnother line, also long enough\nshort", "en", "a", 10),
    (2, "  one LINE here, long enough \nsomething new of its own", "en", "a", 10),
    (2, "  one LINE here, long enough \nsomething new of its own", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t ", None, "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, "ONE LINE HERE, LONG ENOUGH\nANOTHER LINE, ALSO LONG ENOUGH\nSHORT", "en", "a", 10),
    (None, "a text without an id, which is long enough", "fr", "c", 5),
    (None, "a text without an id, which is long enough", "fr", "c", 5),
    (8, PROSE, "en", "c", 1),
    (9, PROSE + " and then it ends", "en", "c", 1),
    (10, PROSE, None, None, 1),
    (11, "été à l'école où ça va naïf — Ünïcödé 漢字 😀 x\x1c\x85", "fr", "c", 1),
    (12, "!!!! ???? 12345", None, "a", 15),
    (13, "aaaa" * 500, "xx", "a", 2000),
]


def docs(spark, rows=ROWS):
    """Rows of documents with further columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "label", "half", "h1", "pos", "key", "fp", "norm", "digest", "mix_src", "mix_rate", "mix_copy", "near_dup_id", "copy_id", "node", "root", "n", "kind", "score"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
