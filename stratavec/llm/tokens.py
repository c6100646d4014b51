"""Whole texts cut at places where no token can cross, so that each distinct piece is tokenized once and looked up after.

The caches live in the worker and are bounded in bytes; what they forget, and long pieces, are made again."""

from __future__ import annotations

import base64
import functools
import re
import weakref
from sys import getsizeof

#: Spaces between other signs, after which the pattern's matches always begin anew.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s\s|[^\S \n]|^\s|\s$")

#: Bytes of one cache, and of a piece (or what is made of it) above which it isn't remembered: texts without spaces are
#: one piece each, however long, and never come again.
CACHE_BYTES, LONG = 40 << 20, 512
#: Bytes of an entry besides its key and value: its place in the table, at the table's least load.
ENTRY = 120


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def pieces(text: str) -> list[str]:
    """The text in pieces between which the splitting pattern always has a boundary. Joined they are the text."""
    if not text:
        return []
    if _ODD.search(text):
        return _CUT.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *[x if x[0] == "\n" else " " + x for x in rest]]


_caches: list[weakref.ref] = []


def alone(*mine: Cached) -> None:
    """A task's first call: what other operators' tasks remembered in this worker goes."""
    for ref in list(_caches):
        cache = ref()
        if cache is None:
            _caches.remove(ref)
        elif cache and not any(cache is m for m in mine):
            cache.forget()


class Cached(dict):
    """What make(piece) gives, remembered while all that is remembered stays below most bytes."""

    def __init__(self, make, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.size = make, most, 0
        _caches.append(weakref.ref(self))

    def forget(self) -> None:
        self.clear()
        self.size = 0

    def __missing__(self, piece):
        value = self.make(piece)
        size = getsizeof(piece) + (sum(map(getsizeof, value)) if type(value) is tuple else getsizeof(value))
        if size > 2 * LONG:
            return value
        self.size += size + ENTRY
        if self.size > self.most:
            self.clear()
            self.size = size + ENTRY
        self[piece] = value
        return value


class WordEncoder:
    """Ids of a tokenizer file with lower-cased words, byte symbols and word-end suffix, as little-endian bytes.

    The library reads the file and encodes every word with letters beyond Latin or with the string of a special token,
    which gets that token's id as the library gives it. Other words of Latin letters, whose
    normalization is lower case alone, are merged by ranks instead, which is much faster: a merged symbol's id grows
    with its merge's place, and every symbol's own bytes encode to itself, from which follows that merging the adjacent
    two of least joint id gives the library's ids (the tests check both for the file)."""

    #: Stands for the word end; no UTF-8 text has this byte.
    END = b"\xff"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Specials are matched in the raw text and hold no white space, so each lies within one word.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search
        self.matches = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+").findall
        ranks = symbols(spec)
        ranks.setdefault(self.END, len(spec["model"]["vocab"]) + 10)
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.latin = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch

    def word(self, word: bytes) -> bytes:
        """The ids of a word without white space."""
        import array

        text = word.decode()
        if self.latin(text) and not self.special(text):
            return array.array("I", [i for m in self.matches(text.lower()) for i in self.merge(m.encode() + self.END)]).tobytes()
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


@functools.cache
def word_ids(path: str) -> Cached:
    """Ids of words by a tokenizer file; made once in a worker, whatever its tasks."""
    return Cached(WordEncoder(path).word, 56 << 20)


def symbols(spec: dict) -> dict[bytes, int]:
    """Symbols of a byte-level vocabulary with word ends as bytes, END for the suffix."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    out, suffix = {}, spec["model"]["end_of_word_suffix"]
    special = {t["content"] for t in spec["added_tokens"]}
    for symbol, i in spec["model"]["vocab"].items():
        if symbol not in special:
            body = symbol.removesuffix(suffix)
            out[bytes(signs[c] for c in body) + WordEncoder.END * (body != symbol)] = i
    return out
