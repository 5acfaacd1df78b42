"""Edge fixtures and the comparison with SQL that the tests of this folder share."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(1)
WORDS = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "ne", "so", "tra", "vel") for b in ("n", "r", "sta", "x", "ly", "do", "kim")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


LONG = prose(4000, 99) + "\n" + "x" * 1_300_000 + " " + prose(100, 98)
PASSAGE = prose(60, 5)


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, repeated ids, copies and shared passages."""
    base = prose(120, 1)
    near = " ".join(w if i % 40 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, near, "en", "b", 10), (3, near, "en", "b", 10), (4, None, "en", "a", None), (5, "", None, "b", 0),
        (6, "   \n\t ", "de", None, 5), (7, "Kurz, ja!", "de", None, 9), (None, prose(50, 7), "fr", "c", 1), (None, None, None, None, None),
        (8, prose(40, 8) + " " + PASSAGE + " " + prose(40, 9), "en", "c", 1), (9, PASSAGE + "\n" + prose(80, 10), "en", "c", 1), (10, "Ünï çødé ßtraße " * 30, "de", "a", 1),
        (11, "one", "en", "a", 1), (12, "wor wor wor " * 40, "en", "a", 1), (13, LONG, "en", "d", 1), (14, base.upper() + "!!", "en", "a", 1), (3, prose(70, 11), "es", "b", 2),
        (15, "***", "en", "a", 3), (16, "a b c \x0b\x0c d", "en", "a", 8),
    ]
    return rows


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def against_sql(spark, query, sql: str, folder, **tables) -> int:
    """Runs the query and its SQL over the tables, written as Parquet; returns the number of rows, which must agree."""
    c = duckdb.connect()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = rows_of(query(spark, str(folder)))
    frame = c.execute(sql)
    names = [d[0] for d in frame.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(plain(r[i]) for i in order) for r in frame.fetchall())
    assert got == want
    return len(got)


def docs(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, DOCS)


def clashing(df):
    """Extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("n_words", "class_id", "part", "block_no", "node", "key", "copy", "size", "__key", "lang_pred", "selected", "grams")])


__all__ = ["Row"]
