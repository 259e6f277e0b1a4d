"""Encoding by the tokenizers library, each distinct space-delimited unit once.

A pre-tokeniser that never lets a token cross the gap before a word makes the ids of a
text the ids of its units in a row. Two such kinds are known here, read off the
tokenizer's own file; any other tokenizer encodes whole texts. Units of Latin letters,
digits and signs are cut by the file's own pattern and go straight to the library's
BPE model; all others go through the library whole. Memos are bounded, in two
generations, and live as long as the Python worker. Units are told apart by their bytes.
Texts in which an added token's literal stands are encoded whole, as the library treats
it as that token.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

# Encoders of a worker, by file.
_encoders: dict[str, UnitEncoder] = {}
_PLAIN = re.compile(r" ?[\n!-~¡-įı-ɏ]+").fullmatch  # without U+0130, whose lower case is two characters
_SIGNS = b'.,;:!?|*$%&#)"'
# Bytes that begin no white space in UTF-8, nor what Python or a pattern may take for it.
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER, _SIGN, _OTHER = 2, 3, 5
# Letters, signs but the apostrophe, and what else is visible in ASCII; 0 for all other bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x27, *range(0x30, 0x3A)]] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
# Fixed value: the pattern that ByteLevel pre-tokenisation uses.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """ByteLevel's letter for each byte: visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def unit_kind(spec: dict) -> tuple[str, str]:
    """``attached``: a space goes with the word after it; ``dropped``: spaces vanish; else ``whole``. And the pattern."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] != "BPE":
        return "whole", ""
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "attached", _BYTE_LEVEL
    parts = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        plain = parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("add_prefix_space") and parts[1].get("use_regex") is False
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if plain and pattern.endswith(r"|[^\s\p{L}\p{N}]+") and steps == ["NFC", "Replace", "Lowercase"]:
            return "dropped", pattern
    return "whole", ""


class Memo:
    """A bounded dictionary: what wasn't used while the newer half filled up is forgotten."""

    def __init__(self, half: int):
        self.half, self.new, self.old = half, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        self.turn()
        self.new[key] = value

    def turn(self) -> None:
        """Begin a new half if this one is full."""
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new


class UnitEncoder:
    """Ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str, half: int = 250_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.kind, pattern = unit_kind(spec)
        added = spec.get("added_tokens") or []
        if any(t.get("normalized") for t in added):  # to be found only after normalisation
            self.kind, pattern = "whole", ""
        self.added = [t["content"] for t in added]
        self.pieces = regex.compile(pattern).findall if pattern else None
        self.model, self.letters, self.longest = self.tokenizer.model, _byte_letters(), longest
        self.units, self.signs = Memo(half), {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _word(self, core: bytes) -> bytes:
        """Ids of one pre-token, straight from the BPE model."""
        if core.isalpha():
            letters = core.decode()
        elif core[0] == 0x20 and core[1:].isalpha():
            letters = self.letters[0x20] + core[1:].decode()
        else:
            letters = core.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _sign(self, sign: bytes) -> bytes:
        ids = self.signs.get(sign)
        if ids is None:
            ids = self._whole([sign.decode()])[0]
            if len(sign) <= 8:
                self.signs[sign] = ids
        return ids

    def _new(self, unit: bytes) -> bytes | None:
        """Ids of a unit of plain letters and signs; None if the library has to see it whole."""
        core = unit.rstrip(_SIGNS)
        word = core[1:] if core[:1] == b" " else core
        if word.isalpha() or (word and (text := word.decode("utf-8", "surrogatepass")).isalpha() and _PLAIN(text)):
            if self.kind == "dropped":
                core = word.decode().lower().encode()
            ids = None if core == unit else self.units.get(core)
            if ids is None:
                ids = self._word(core)
                if core != unit:
                    self.units.new[core] = ids
            return ids + self._sign(unit[len(unit.rstrip(_SIGNS)) :]) if unit[-1] in _SIGNS else ids
        text = unit.decode("utf-8", "surrogatepass")
        if not _PLAIN(text):
            return None
        out = []
        for p in self.pieces(text if self.kind == "attached" else text.lower()):
            raw = p.encode()
            ids = self.units.get(raw)
            if ids is None:
                ids = self._word(raw)
                self.units.new[raw] = ids
            out.append(ids)
        return b"".join(out)

    def _look(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units. Plain words, the most of all new units, are handled in the loop itself."""
        memo, tokenize, longest = self.units, self.model.tokenize, self.longest
        memo.turn()
        new, old = memo.new, memo.old.get
        out, odd = list(map(new.get, units)), []
        space = self.letters[0x20] if self.kind == "attached" else None
        for i in [i for i, ids in enumerate(out) if ids is None]:
            u = units[i]
            ids = old(u)
            if ids is None:
                if len(u) > longest:
                    odd.append(i)
                    continue
                if space and u[0] == 0x20 and u[1:].isalpha():
                    ids = array("I", [t.id for t in tokenize(space + u[1:].decode())]).tobytes()
                else:
                    ids = self._new(u)
                    if ids is None:
                        odd.append(i)
                        continue
            new[u] = out[i] = ids
        for i, ids in zip(odd, self._whole([units[i].decode("utf-8", "surrogatepass") for i in odd]), strict=True):
            out[i] = ids
            if len(units[i]) <= longest:
                new[units[i]] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.kind == "whole":
            return [np.frombuffer(x, "<u4") for x in self._whole(texts)]
        collecting = gc.isenabled()
        gc.disable()  # tokens come and go by the million, none in a cycle
        try:
            odd = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
            out = by_units([b"" if i in odd else t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)], _before_words, self._look)
            for i, ids in zip(sorted(odd), self._whole([texts[i] for i in sorted(odd)]), strict=True):
                out[i] = np.frombuffer(ids, "<u4")
            return out
        finally:
            if collecting:
                gc.enable()


def _before_words(buf: np.ndarray) -> np.ndarray:
    """Where both kinds of pre-tokenisers always part tokens, of all bytes but the last.

    Before a space that a word follows; between an ASCII letter and an ASCII sign other
    than the apostrophe, either way; before a newline that follows a letter, digit or sign;
    and, if that newline is alone, before an ASCII letter that follows it.
    """
    cut = np.zeros(len(buf) - 1, bool)
    np.logical_and(buf[:-1] == 0x20, _SOLID[buf[1:]], out=cut)
    kind = _KIND[buf]
    change = kind[:-1] * kind[1:]  # of neighbours
    line = buf == 0x0A
    new = line[1:] & (kind[:-1] > 0)  # a newline after something
    cut[1:] |= ((change == _LETTER * _SIGN) | new)[:-1]
    cut[2:] |= new[:-2] & (kind[2:-1] == _LETTER)
    return cut


def by_units(raw: list[bytes], cuts: Callable[[np.ndarray], np.ndarray], look: Callable[[list[bytes]], list[bytes]]) -> list[np.ndarray]:
    """Ids of each text from the ids of its units; equal units are found by Arrow's dictionary of their bytes.

    ``cuts`` tells of all bytes but the last whether a unit begins there; ``look`` gives the ids of distinct units.
    """
    joined = b"".join(raw)
    begins = np.cumsum([0, *map(len, raw)])
    if not joined:
        return [np.zeros(0, np.uint32) for _ in raw]
    buf = np.frombuffer(joined, np.uint8)
    cut = np.zeros(len(buf), bool)
    cut[:-1] = cuts(buf)
    cut[begins[:-1][begins[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(buf))
    kind, width = (pa.binary(), np.int32) if len(buf) < 2**31 else (pa.large_binary(), np.int64)
    units = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(joined)]).dictionary_encode()
    which = units.indices.to_numpy()
    found = look(units.dictionary.to_pylist())
    sizes = np.array([len(x) >> 2 for x in found])
    flat = np.frombuffer(b"".join(found), "<u4")
    tokens = sizes[which]
    stops = np.cumsum(tokens)
    offset = (np.cumsum(sizes) - sizes)[which] - (stops - tokens)
    ids = flat[np.repeat(offset, tokens) + np.arange(stops[-1])]
    bounds = np.concatenate([[0], stops])[np.searchsorted(starts, begins)]
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this worker's encoders and their memos, and give their memory back; operators that encode nothing call it before they work."""
    if not _encoders:
        return
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
