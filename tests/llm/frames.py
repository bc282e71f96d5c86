"""Small frames for the tests of the training-data operators."""

import random

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Extra columns whose names the operators use themselves.
CLASH = "kept BOOLEAN, size STRING, th STRING, rid STRING, bucket STRING, shard STRING, score STRING, key STRING, " \
        "copies STRING, digest STRING, label STRING, _text STRING, n LONG, row_key STRING"
LONG = " ".join(random.Random(5).choice(["lorem", "ipsum", "dolor", "sit", "amet,", "consectetur."])
                for _ in range(60_000))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (2, "the cat sat on the mat and looked at the dog", "en", "a", 44),     # exact copy
        (3, "the  cat sat on the mat and looked\tat the dog\n", "en", "b", 47),  # longer original
        (4, None, "en", "b", None),
        (5, "", None, None, 0),
        (6, LONG, "la", "c", len(LONG)),
        (7, "12345 !!! ... 678", "en", "c", 17),
        (None, "le chat est sur la table et le chien dort", "fr", None, 41),
        (None, None, None, None, None),
        (8, "repeated row", "en", "a", 12),
        (8, "repeated row", "en", "a", 12),
        (9, "été 中文 \U0001f600 ß İ", "de", "\U0001f600", 13),
        (10, "one", "en", "z", 3),
    ]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split(" ")
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    """(doc_id, text) pairs, null as empty, by id."""
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
