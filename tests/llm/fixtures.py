"""Small tables with the odd cases that every operator has to take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and other words that follow. " * 6000


def documents(spark, texts, **extra):
    """Documents with ids from 0; extra adds constant columns."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


def odd_documents(spark):
    """Null ids, null, empty, blank, very long and repeated rows, and columns whose names operators use."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, LONG, "en", "s", len(LONG)),
        (None, "a text without an id stays alone here", "en", "s", 10), (5, "same row twice in this table", "en", "s", 3),
        (5, "same row twice in this table", "en", "s", 3), (6, "é漢字😀 \x00 odd", None, "s", 1),
    ]
    from pyspark.sql import functions as F

    clash = {c: F.lit("mine") for c in ("score", "reg", "_w", "term", "item", "kept", "component_id", "label", "toxic", "quality", "pos", "_h", "text_hash", "items")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def save(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
