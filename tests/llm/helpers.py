"""Small tables for the tests of the corpus operators."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, rows):
    """A documents table from (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The same with columns named as those that operators add or use inside."""
    from pyspark.sql import functions as F

    names = "fp v label a b anchor n word path cell size key place held_out score n_bytes shard_id spans item_ids n_words rank code id home text_start target mix_size".split()
    return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))


def duck(sql, **tables):
    """Rows of a query over Spark or Parquet tables, as a sorted list of tuples by sorted column names."""
    con = duckdb.connect()
    for name, table in tables.items():
        if isinstance(table, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{table}')")
        else:
            con.register(name, table.toArrow())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def frame(**columns):
    return pd.DataFrame(columns)
