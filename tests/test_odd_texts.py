"""Queries give DuckDB's rows on texts where Java's rules on characters are others."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evalweave.functions import semantics, text
from evalweave.plans import registry

ODD = [
    "OURÉ!! ÉA",  # a letter that touches letters beyond ASCII
    "中B中 C",
    "déC",
    "anſwer iſ c",  # long s
    "optıon e or optİon e",  # dotless and dotted i
    "x\n c  B",  # what ends a line
    "x\rc\r\nB",
    "x\u0085d\u0085 B",
    "x\nd\u000b\n",  # what is blank
    "final\u000banswer: d",
    "x\nd\u00a0",  # what is trimmed
    "x\nd\u3000 ",
    None,
    "",
]


@pytest.fixture
def documents(spark, tmp_path):
    # every remainder by 2, 3 and 5, below zero too
    rows = [(i * len(ODD) + j, t, lang, "web", n) for i in range(-15, 16) for j, t in enumerate(ODD) for lang, n in [(("fr", 12), ("É", -3), (None, None))[i % 3]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_answer_letters(spark, documents):
    got = registry.queries()["f10_answer_letters"](spark, documents).select("doc_id", "k", "letter", "final").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, k, letter, final FROM ({registry.oracle_sql()['f10_answer_letters']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_final_letter_has_two_readings(spark):
    """By itself a letter that touches one beyond ASCII is part of a word, as in Python."""
    told = F.lit("OURÉ ÊC")
    assert spark.range(1).select(text.final_letter(told)).first()[0] == ""
    assert spark.range(1).select(text.final_letter(told, semantics.re2)).first()[0] == "C"
