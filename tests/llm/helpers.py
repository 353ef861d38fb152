"""Small tables with all the odd rows that operators must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
ODD = [
    (1, "One two three four five six seven eight nine ten.", "a"), (2, None, None), (3, "", "b"), (None, "A text without an id, and some words in it.", "c"),
    (4, " \n\t ", None), (5, LONG, "long"), (6, "One two three four five six seven eight nine ten.", "copy"), (6, "One two three four five six seven eight nine ten.", "copy"),
    (7, "x", None), (8, "ñandú 漢字 😀 it's they're <|endoftext|> 123\r\n  end ", None),
]


def docs(spark, rows=None, **names):
    df = spark.createDataFrame(ODD if rows is None else rows, DOCS)
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    return df


def by_id(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
