"""SentencePiece models run by the tokenizers library.

The model file is a protobuf message; the few fields needed are read here. From them
the library's normaliser, space marker, merges or unigram scores, byte fallback and
decoder are rebuilt. Texts are encoded in batches on several threads, decoded by the
library, and the ids of every whole text are compared with those that a SentencePiece
processor gives for it.

Where no piece has a space marker after another character, tokens never reach over the
gap before a marker, so a text's ids are those of its units in a row, each a marker and
a word. Units are told apart by their bytes and remembered; the new ones of many texts
go through the rebuilt tokenizer as one text a thread, and the library's decoder has to
give that text back.

Edge cases: null and empty texts have no ids; characters without a piece become bytes,
or the unknown id; a marker that stands in a text itself decodes to a space, so its
round trip is false; rows that repeat a doc_id are each encoded.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalweave.llm.common import batches, texts_of
from evalweave.llm.units import Memo, by_units

MARK = "▁"
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_coders: dict[tuple[str, int], PieceCoder] = {}


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(field number, value) of a protobuf message: numbers, floats' bytes or nested bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(data: bytes) -> PieceModel:
    pieces, trainer, norm = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            norm = dict(fields(value))
    return PieceModel(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every cut of a piece into two pieces, best score first; of one piece, by its parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    out = []
    for i, (p, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            cuts = sorted((ids[p[:k]], ids[p[k:]], k) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
            out += [(-score, i, n, p[:k], p[k:]) for n, (_, _, k) in enumerate(cuts)]
    return [(a, b) for *_, a, b in sorted(out, key=lambda x: x[:3])]


def build(model: PieceModel):
    """The tokenizers library's counterpart."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model.pieces), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    out = Tokenizer(core)
    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    # fused first: replacing in one string is cheaper than in every token
    parts: list = [decoders.ByteFallback()] if model.byte_fallback else []
    parts += [decoders.Fuse(), decoders.Replace(MARK, " ")]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    return out


def splits(model: PieceModel) -> bool:
    """Has no piece a marker after another character, and does normalisation change nothing but spaces?"""
    plain = model.escape and model.dummy_prefix and not model.charsmap and not model.squeeze
    return plain and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


class PieceCoder:
    """Ids of texts by the rebuilt tokenizer, and back, on several threads."""

    def __init__(self, path: str, threads: int = 2, half: int = 400_000):
        # the library reads the first at each batch, the other once
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer, self.threads = build(self.model), threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.parted, self.memo = splits(self.model), Memo(half)
        self.lost: set[bytes] = set()  # units that decode to something else
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, units: list[bytes]) -> list[bytes]:
        """Ids of units of one space and a word: in a row of such units every piece with a marker begins one."""
        size = -(-len(units) // self.threads) or 1
        rows = [units[at : at + size] for at in range(0, len(units), size)]
        # the normaliser puts back the first space
        texts = [b"".join(r)[1:].decode("utf-8", "surrogatepass") for r in rows]
        coded, out = self.batch(texts), []
        for row, text, ids, back in zip(rows, texts, coded, self.decode(coded), strict=True):
            found = np.array(ids, "<u4")
            cuts = np.append(np.flatnonzero(self.begins[found]), len(found)).tolist()
            if len(cuts) != len(row) + 1:
                raise RuntimeError("units and markers differ")
            data = found.tobytes()
            parts = [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out += parts
            if back != text:
                self.lost |= {u for u, ids_ in zip(row, parts, strict=True) if not self._kept(u, ids_)}
        return out

    def _kept(self, unit: bytes, ids: bytes) -> bool:
        """Does the library's decoder give the unit back? Its first space is the normaliser's."""
        return self.decode([array("I", ids).tolist()])[0].encode("utf-8", "surrogatepass") == unit[1:]

    def _look(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, each spaces and a word."""
        self.memo.turn()
        known, old = self.memo.new, self.memo.old.get
        out = list(map(known.get, units))
        new = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = old(units[i])
            if ids is None:
                new.append(i)
            else:
                known[units[i]] = out[i] = ids
        words = [i for i in new if len(units[i]) > 1 and units[i].rfind(b" ") == 0]
        for i, ids in zip(words, self._words([units[i] for i in words]), strict=True):
            out[i] = ids
            if len(units[i]) <= 64:
                known[units[i]] = ids
        for i in new:
            if out[i] is None:  # several spaces, or the last ones of a text: seen after a word
                one, more = self.batch(["a", "a" + units[i].decode("utf-8", "surrogatepass")])
                known[units[i]] = out[i] = array("I", more[len(one) :]).tobytes()
                if self.decode([more])[0].encode("utf-8", "surrogatepass") != b"a" + units[i]:
                    self.lost.add(units[i])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.parted:
            return self.batch(texts)
        raw = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        return [ids.tolist() for ids in by_units(raw, _before_spaces, self._look)]

    def kept(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Does each text come back? By its units, which were decoded when first seen; whole texts where there are no units, or one was lost."""
        if not self.parted or self.lost:
            return [a == b for a, b in zip(self.decode(ids), texts, strict=True)]
        return [MARK not in t for t in texts]  # a marker in a text becomes a space

    def check(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Are these the ids that SentencePiece gives for each whole text?"""
        return [a == b for a, b in zip(self.reference.encode(texts, num_threads=self.threads), ids, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts by the library's decoder."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _before_spaces(buf: np.ndarray) -> np.ndarray:
    """A space that follows something else; the first unit of a text begins anyway."""
    space = buf == 0x20
    return space[:-1] & ~np.concatenate([[False], space[:-2]])


def coder(path: str, threads: int = 2) -> PieceCoder:
    if (path, threads) not in _coders:
        _coders[path, threads] = PieceCoder(path, threads)
    return _coders[path, threads]


def encode(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, ids, and whether SentencePiece gives the same, of every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model, threads)
        for batch in parts:
            for some, texts in batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1 << 22):
                ids = code.encode(texts)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(code.check(texts, ids))], ["doc_id", "ids", "parity"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<long>, parity boolean")


def decode(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id and text of each (doc_id, ids)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model, threads)
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.decode(batch.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), parity and units_round_trip of every text.

    ``parity``: SentencePiece gives the same ids for the whole text. ``units_round_trip``:
    the library's decoder gives back every unit of the text, as seen when the unit was new
    to its worker; whole texts are decoded once a unit was lost, and by :func:`decode`.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model, threads)
        for batch in parts:
            for some, texts in batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1 << 22):
                ids = code.encode(texts)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(array("I", x).tobytes()) for x in ids], pa.int64()), pa.array(code.check(texts, ids)), pa.array(code.kept(texts, ids))], ["doc_id", "n_tokens", "ids_crc32", "parity", "units_round_trip"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, units_round_trip boolean")
