"""Frames that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import os

SF = os.environ.get("SEEKLOOM_TEST_DIR", "/root/testdata/sf0.001")
LONG = "the quick brown fox jumps over lazy dogs near station walls " * 4000
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, base int, token_ids string, label string"


def edge_docs(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and then runs far away from here today", "en", "a", 82),
        (1, "the quick brown fox jumps over the lazy dog and then runs far away from here today", "en", "a", 82),
        (2, "", "en", None, 0),
        (3, None, None, "b", None),
        (None, "some text without an id", "en", "a", 23),
        (4, LONG, "en", "a", len(LONG)),
        (5, " \n\t ", "fr", "a", 4),
        (6, "Ünïcode 日本語 🙂 mail me at x.y@mail.example.com or +1 (555) 555-0100", "de", "a", 70),
        (7, "?!… ###", None, None, 7),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, "t", "l") for r in rows], DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
