"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing column names."""
from pyspark.sql import functions as F

LONG = "lorem " * 30_000 + "tail"


def documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "alone without id"), (None, None), (4, LONG), (5, LONG),
            (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (6, "another text of the same id"),
            (7, "x" * 200_000), (8, "été ÉTÉ 你好 🎉 <tag> & | #"), (9, "one"), (10, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit("clash") for c in ("n_words", "n_tokens", "ids", "spans", "key", "rid", "label", "n", "host", "id", "kept",
                                         "noisy", "log_weight", "score", "labels", "__text", "__id", "__hash", "decoded", "items")}
    return df.withColumns(clash), rows
