"""Words that a polynomial modulo 2^64 can't part, special tokens' literals, and the space marker as text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalweave.llm import common, neardup, packing, pieces, simple8b, substring
from evalweave.llm.units import encoder

LATIN = "doc_id long, text string"


def morse(n, a="a", b="b"):
    """The Thue-Morse word of n letters and its complement."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return [a if x == 0 else b for x in bits], [b if x == 0 else a for x in bits]


PAIRS = [tuple("".join(x) for x in morse(n)) for n in (16, 64, 1024, 4096)]


def test_words_and_runs_of_words_differ():
    for one, two in PAIRS:
        (h,) = common.hashed_words([f"{one} {two}"])
        assert (h[:, 0] != h[:, 1]).all()
    a, b = (" ".join(x) for x in morse(4096, "left", "right"))
    ha, hb = common.hashed_words([a, b])
    for row in (0, 1):
        assert not np.isin(common.windows_hash(ha[row], 2048), common.windows_hash(hb[row][:2048], 2048)).all()
        spans = [common.spans_hash(h[row], np.array([0]), np.array([4096])) for h in (ha, hb)]
        assert spans[0] != spans[1]


def test_equal_bytes_decide_hashes():
    words = ["x" * n for n in range(1, 40)] + ["x" * n + "\0" for n in range(1, 40)]
    (h,) = common.hashed_words([" ".join(words * 2)])
    assert (h[:, : len(words)] == h[:, len(words) :]).all()
    assert len({tuple(c) for c in h.T.tolist()}) == len(words)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 31, 50])
def test_windows_and_spans_hash_only_their_words(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, 90, dtype=np.uint64)
    both = np.concatenate([x, x[::-1], x])
    w = common.windows_hash(both, n)
    assert len(w) == len(both) - n + 1
    assert (w[: 90 - n + 1] == w[180:]).all()
    assert len(np.unique(w[:90])) == 90
    s = common.spans_hash(both, np.array([3, 183, 4]), np.array([n, n, n]))
    assert s[0] == s[1] != s[2]


def test_operators_tell_them_apart(spark):
    tail = " ".join(f"w{i}" for i in range(60))
    one, two = PAIRS[2]
    texts = [f"{one} {tail}", f"{two} {tail}", f"{one} {two}", " ".join([one] * 60), " ".join([two] * 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), LATIN)
    cut = {r.doc_id: r for r in substring.substring_digests(docs, 50, 1).collect()}
    assert [cut[i].n_removed for i in range(5)] == [0, 60, 0, 0, 0]
    near = {r.doc_id: r for r in neardup.near_duplicates(docs, 3, 85, 32, 6).collect()}
    assert [near[i].component_id for i in range(5)] == [0, 0, 2, 3, 4]
    assert [near[i].n_shingles for i in range(5)] == [59, 59, 1, 1, 1]
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.digests(docs, path).collect():
        assert r.parity
        assert r.ids_crc32 == zlib.crc32(np.array(reference.encode(texts[r.doc_id]), "<u4").tobytes())
    for name, end, run in (("byte_bpe_50k.json", 0, lambda p: simple8b.token_file(docs, p)[0]), ("word_bpe_49k.json", 2, lambda p: packing.pack(docs, p, 1 << 20))):
        p = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(p)
        want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4") for t in texts]
        for r in run(p).collect():
            at = r.start if name[0] == "w" else 0
            n = r.length if name[0] == "w" else r.n_tokens
            assert r.ids_crc32 == zlib.crc32(want[r.doc_id][at : at + n].tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_literals_are_the_librarys(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "x<|startoftext|>y", "<|EndOfText|> plain", "", "no literal here", "<|endoftext|> " * 50, "ends <|endoftext|"]
    assert [x.tolist() for x in encoder(path).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_marker_in_a_text(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a ▁b", "▁", "a  b ", " lead", "plain", "  ", "é\x00ÿ🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), LATIN)
    rows = {r.doc_id: r for r in pieces.digests(docs, path).collect()}
    assert all(r.parity for r in rows.values())
    assert [rows[i].units_round_trip for i in range(len(texts))] == ["▁" not in t for t in texts]


def test_finer_units_change_no_ids():
    """Letters, signs, contractions and white space in any order, against the plain library."""
    rng = random.Random(3)
    alphabet = [*"ab Z'.,-\n\n\t  59(\"é日'sSt", "\r\n", "\n\n", "'s ", "'LL", " \n", "\u00a0", "\u0301", "İ", "ß", "ﬁ", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder(path).encode(texts)] == want


def test_pieces_of_odd_texts_match():
    rng = random.Random(4)
    alphabet = [*"ab Z'.,\n\t  59é日▁▁ s", "  ", "   "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    code = pieces.coder(public_tokenizers.path("piece_bpe_32k.model"))
    ids = code.encode(texts)
    assert ids == code.batch(texts)
    assert all(code.check(texts, ids))
    assert code.kept(texts, ids) == [a == b for a, b in zip(code.decode(ids), texts, strict=True)]
