"""Rows that share a doc_id but not a text are each cut from their own text."""

from evalweave.llm import substring


def test_rows_of_one_id_keep_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    own = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(1, passage, 3, "first"), *((5, f"{passage} {t}", 4, k) for k, t in own.items()), (5, None, 0, "null"), (9, own["a"] + " end", 2, "last"), (None, passage, 1, "loose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string").repartition(3)
    got = {r.source: r for r in substring.drop_passages(docs).collect()}
    assert len(got) == len(rows)
    assert {k: got[k].text for k in own} == own
    assert all(got[k].n_chars == len(t) for k, t in own.items())
    for doc_id, text, n_chars, source in rows:
        if source not in own:
            assert (got[source].doc_id, got[source].text, got[source].n_chars) == (doc_id, text, n_chars)
