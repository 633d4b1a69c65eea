"""Small tables with the awkward cases that every operator has to bear."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names an operator also gives to columns of its own.
CLASHING = ("score", "size", "fp", "digest", "keep_id", "component_id", "label", "shard", "tokens", "copies", "node", "word", "item_id", "count", "__score", "__hits", "__digest", "__id", "__fp", "__root", "range", "part", "hot", "piece", "__keep_id", "__SIZE")

LONG = " ".join(f"word{i % 977} stone{i % 131}" for i in range(30_000))
TEXTS = ["the cat sat on the mat today", "The CAT sat on the mat today", None, "", " \t\n", LONG, "É À ﬁne café ½ ①", "a", "a", "<|endoftext|> it's", "x y"]


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)


def awkward(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, "a"), (7, "a"), (None, "a"), (None, "only here, without an id"), (None, None)]
    df = documents(spark, rows)
    for name in CLASHING:
        df = df.withColumn(name, df.n_chars)
    return df


def same_rows(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))
