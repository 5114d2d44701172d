"""Pre-tokens of texts under two public vocabularies, and a worker's table of what each distinct one becomes.

Special strings are cut out first, as the tokenizers library does. Parts whose characters all lie in a plain range
are split here, by the vocabulary's own pattern; parts in any other script are normalised and split by the
library. Either way each distinct pre-token goes to the vocabulary's model once, and the ids are the library's.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from itertools import islice
from types import SimpleNamespace

from tokenizers import Tokenizer

# Latin letters, digits, ASCII signs and common typographic marks: classes and cases that no version disputes,
# already in composed form, with no white space besides space, tab and line ends.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ɏ–—‘’“-„•…€]*")
# Letters and digits of that range, and the patterns of the two vocabularies over it (fixed values).
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD_PATTERN = rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
BYTE_PATTERN = rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
# Byte-level vocabularies write each byte as a sign: a printable one as itself, the others as signs from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE_SIGN = chr(_BYTE_SIGNS[0x20])
# First characters, in no plain text, of pre-tokens that are already in signs and of special strings.
_IN_SIGNS, _SPECIAL = "\x00", "\x01"
#: Distinct pre-tokens that a worker remembers. Beyond that it keeps the half it met first: common ones come early.
CACHE = 400_000


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Pretokens(dict):
    """From each distinct pre-token that this worker met to ``value`` of the model's pieces for it."""

    def __init__(self, path: str, pattern: str, prepare: Callable[[str], str], value: Callable[[list], object]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.prepare, self.find, self.value = prepare, re.compile(pattern).findall, value
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t for t in json.load(f)["added_tokens"]}
        if any(t[flag] for t in added.values() for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special strings that take part in the splitting of their surroundings are not supported")
        self.special = {s: t["id"] for s, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a whole text, in order: keys of this table."""
        if self.cut is None or self.cut.search(text) is None:
            return self._part(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [_SPECIAL + part] if k % 2 else self._part(part)
        return out

    def _part(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.find(self.prepare(text))
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [_IN_SIGNS + signs for signs, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __missing__(self, pretoken: str):
        if len(self) >= CACHE:
            for old in list(islice(self, CACHE // 2, None)):
                del self[old]
        if pretoken[:1] == _SPECIAL:
            pieces = [SimpleNamespace(id=self.special[pretoken[1:]])]
        else:
            if pretoken[:1] == _IN_SIGNS:
                signs = pretoken[1:]
            elif pretoken.isascii() and pretoken.isprintable():
                signs = pretoken.replace(" ", _SPACE_SIGN)
            else:
                signs = pretoken.encode().decode("latin-1").translate(_BYTE_SIGNS)
            pieces = self.tokenizer.model.tokenize(signs)
        self[pretoken] = made = self.value(pieces)
        return made


def id_bytes(pieces: list) -> bytes:
    return little_endian([p.id for p in pieces])


_tables: dict[tuple, Pretokens] = {}


def pretoken_table(path: str, pattern: str, prepare: Callable[[str], str], value: Callable[[list], object]) -> Pretokens:
    """The worker's table for a vocabulary; it outlives a task, so later tasks find it filled."""
    key = (path, pattern, value.__name__)
    if key not in _tables:
        _tables[key] = Pretokens(path, pattern, prepare, value)
    return _tables[key]
