"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import re

from pyspark.sql import types as T

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


def documents(spark, rows, **extra):
    """doc_id and text, plus columns that operators use as names of their own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] +
                          [T.StructField(k, T.StringType()) for k in extra])
    return spark.createDataFrame([(i, t, *extra.values()) for i, t in rows], schema)


def collected(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)
