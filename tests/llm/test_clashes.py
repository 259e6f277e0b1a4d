"""Inputs with columns named like the operators' own, repeated rows, conflicting labels and bad samples."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm import exact, langid, media, neardup, packing, pieces, quality, simple8b, substring, toxicity

CLASHING = ["kept", "slot", "__slot", "__of", "__marks", "__kept", "row", "marks", "sha", "n", "rep", "key", "label", "batch", "entries", "at", "fp", "spans", "place", "n_cp", "rest", "gid", "tag", "digit", "cuts", "cut", "of", "size", "y", "ids", "a.b"]
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [(1, PASSAGE, 1), (2, "own words " + PASSAGE, 1), (3, "other text", 1), (4, "other  text", 1), (5, None, 0), (None, "other text", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", lab) for i, t, lab in ROWS], "doc_id long, text string, lang string, source string, n_chars long, filler string, lab int")
    return out.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat_ws(":", "filler", F.col("doc_id").cast("string")).alias(c) for c in CLASHING))


def _whole(rows, docs):
    """The rows that came out still have their own columns."""
    assert rows.columns == docs.columns
    out = rows.collect()
    for r in out:
        assert all(r[c] == ("x" if r.doc_id is None else f"x:{r.doc_id}") for c in CLASHING)
    return out


def test_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(i, lab, 1 - lab, "z") for i, _, lab in ROWS if i], "doc_id long, quality int, toxic int, y string")
    assert sorted(r.doc_id or 0 for r in _whole(exact.drop_copies(docs), docs)) == [0, 1, 2, 4, 5]
    assert sorted(r.doc_id or 0 for r in _whole(neardup.drop_near_copies(docs), docs)) == [0, 1, 3, 5]
    cut = {r.doc_id: r for r in _whole(substring.drop_passages(docs), docs)}
    assert (cut[2].text, cut[2].n_chars, cut[1].text, len(cut)) == ("own words", 9, PASSAGE, len(ROWS))
    assert len(_whole(toxicity.drop_toxic(docs, labels, threshold=1.1), docs)) == len(ROWS)
    byte, word, piece = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    for out in (langid.identify(docs), toxicity.score_documents(docs, labels), quality.score_documents(docs, labels), pieces.digests(docs, piece), simple8b.token_file(docs, byte)[0], packing.pack(docs, word), media.text_media(docs)[0], neardup.near_duplicates(docs), exact.exact_duplicates(docs), substring.substring_digests(docs)):
        assert out.count() >= len(ROWS)


def test_equal_rows_of_one_id_leave_one(spark):
    rows = [(1, "one text", "a"), (1, "one text", "b"), (1, "one  text", "c"), (1, "another", "d"), (2, "one text", "e"), (2, "lone", "f"), (3, None, "g"), (3, "", "h"), (4, "single", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = exact.drop_copies(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "another"), (1, "one  text"), (2, "lone"), (3, ""), (4, "single")]


def test_packed_rows_of_one_id_have_their_own_checksums(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    # equal token counts, unlike texts, cut by windows of 8
    texts = ["alpha beta gamma delta epsilon", "zeta eta theta iota kappa", "alpha beta gamma delta epsilon", "kappa iota"]
    docs = spark.createDataFrame([(i, t) for i in (7, None) for t in texts], "doc_id long, text string")
    want = {}
    for t in texts:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[ids.tobytes()] = want.get(ids.tobytes(), 0) + 2
    for size in (4, 8, 16):
        rows = packing.pack(docs, path, size).collect()
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        sums = sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in rows)
        # every piece's checksum is that of one of the texts at its place, and all tokens are there
        parts = {(s, n, zlib.crc32(np.frombuffer(x, "<u4")[s : s + n].tobytes())) for x in want for s in range(len(x) // 4) for n in range(1, len(x) // 4 - s + 1)}
        assert all((s, n, c) in parts for _, s, n, c in sums)
        assert sum(r.length for r in rows) == sum(len(x) // 4 * k for x, k in want.items())
        for x, k in want.items():  # as many first pieces as rows begin so
            one = {zlib.crc32(x[: 4 * n]) for n in range(1, len(x) // 4 + 1)}
            assert sum(s == 0 and c in one for _, s, _, c in sums) == k


def test_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(i, 0, 1 - i % 2) for i in range(0, 40, 4)], "doc_id long, quality int, toxic int")
    rows, _ = toxicity.training_rows(docs, labels, "toxic", F.lit(False), 1000)
    assert {int(r.text.split()[1]): r.y for r in rows.collect()} == {i: i % 2 for i in range(40) if i % 4}


@pytest.mark.parametrize("data", [b"P2 1 1 255 300", b"P2 1 1 15 -3", b"P3 1 1 9 1 2 10", b"P5 1 1 9\n\x0a", b"P6 1 1 99\n\x01\x02\x64"])
def test_samples_out_of_range(data):
    with pytest.raises(ValueError, match="range"):
        media.decode(data)


def test_area_means_block_by_block():
    rng = np.random.default_rng(3)
    for shape in ((1, 64), (3, 64), (20_000, 64), (33, 70)):
        grey = rng.integers(0, 256, shape, dtype=np.uint8)
        for height, width in ((8, 9), (32, 32)):
            rows = np.linspace(0, shape[0], height + 1)
            cols = np.linspace(0, shape[1], width + 1)
            cover = lambda e, n: np.clip(np.minimum(e[1:, None], np.arange(1, n + 1)) - np.maximum(e[:-1, None], np.arange(n)), 0, None)
            want = cover(rows, shape[0]) @ grey @ cover(cols, shape[1]).T / ((rows[1] - rows[0]) * (cols[1] - cols[0]))
            assert np.allclose(media.area_resize(grey, height, width), want)


def test_rows_of_one_id_are_counted_once(spark):
    long = "y" * 100
    rows = [(1, long), (1, long), (1, "y " * 100), (2, long), (3, long + "z"), (3, long + "z"), (4, "y" * 64), (4, "y" * 64), (5, long + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect())
    assert got == [(1, 1, 4, True)] * 3 + [(2, 1, 4, False)] + [(3, 5, 3, False)] * 2 + [(4, 4, 2, True)] * 2 + [(5, 5, 3, True)]
