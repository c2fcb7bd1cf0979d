"""Texts to pre-tokens, as a tokenizer file of the ``tokenizers`` library defines them.

For vocabularies that lower the case, treat white space as a gap and split the rest by a
pattern that never crosses a gap, so that a text is the sequence of its words and each
distinct word needs to be looked at once. ``Words`` checks the file for this. Texts of
plain characters are cut by ``str`` methods that were checked against the library
character by character; any other text goes through the library's own normalizer.
"""
from __future__ import annotations

import functools
import json
import re
import unicodedata

import pyarrow as pa
from tokenizers import Tokenizer

#: Words longer than this are worked out anew each time instead of being remembered.
LONG_WORD = 64
#: Most words that a worker process remembers.
REMEMBERED = 150_000
SPACES = "\t\n\x0b\x0c\r "
ODD_SPACES = "\x1c\x1d\x1e\x1f"          # gaps for str.split, but not for the library


class Words:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        if kinds != ["NFC", "Replace", "Lowercase"] or not plain or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-case word vocabulary")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        # as words they start with a blank, which no word of a text does: lowered text may look the same
        self.special = {" " + t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(sorted((re.escape(x[1:]) for x in self.special), key=len, reverse=True)))
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.spec = spec["model"]
        norm = self.library.normalizer.normalize_str
        chars = [chr(c) for c in [*range(0x300), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]]
        # characters that neither compose with others nor lower in a way of their own
        self.safe = frozenset(c for c in chars if (norm(c) == c.lower() and len(norm(c)) == 1 and not c.isspace() and norm(c) != " ")
                              or (c in SPACES and norm(c) == " "))
        letters = "".join(re.escape(c) for c in sorted(self.safe) if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in sorted(self.safe) if unicodedata.category(c)[0] == "N")
        #: The library's pattern (fixed), for words of safe characters.
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")
        # the library's letters for bytes: the printable ones stand for themselves, the rest follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.mapping = str.maketrans({chr(b): chr(c) for b, c in self.letters.items()})

    def split(self, text: str) -> list[str]:
        """Words of a text in order; special tokens are words of their own."""
        if not text:
            return []
        if "<|" in text and self.special_at.search(text):
            out, at = [], 0
            for m in self.special_at.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(" " + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def lowered(self, text: str) -> str | None:
        """A text whose words, as ``split`` gives them, stand between characters of ``SPACES``;
        None if special tokens are in it."""
        if "<|" in text and self.special_at.search(text):
            return None
        return text.lower() if self._is_safe(text) else self.library.normalizer.normalize_str(text)

    def _is_safe(self, text: str) -> bool:
        ascii_ = text.isascii()
        return (ascii_ and not any(c in text for c in ODD_SPACES)) or (not ascii_ and self.safe.issuperset(text))

    def _plain(self, text: str) -> list[str]:
        if self._is_safe(text):
            return text.lower().split()
        return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]

    def pieces_of_word(self, word: str) -> list[str]:
        """Pre-tokens of one word in the library's byte letters."""
        if self.is_plain(word):
            return [self.mapped(p) for p in self.parts_of_plain(word)]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def parts_of_plain(self, word: str) -> list[str]:
        """Pre-tokens of a plain word as they stand in it."""
        return [word] if word.isalpha() else self.parts.findall(word)

    def mapped(self, part: str) -> str:
        """A part of a plain word in the library's byte letters."""
        return part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.mapping)

    def is_plain(self, word: str) -> bool:
        """Whether its pre-tokens are substrings of it that, as words, are their own pre-token."""
        return self.safe.issuperset(word)

    def count(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))

    def ids(self, pre_token: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(pre_token)]


@functools.lru_cache(maxsize=4)
def words(path: str) -> Words:
    """One per worker process and file."""
    return Words(path)


class Memory(dict):
    """What is known of a word. When it is full only the words of the texts at hand stay,
    the frequent ones among them, so its size is bounded."""

    def room(self, now: set = frozenset(), most: int = REMEMBERED) -> "Memory":
        if len(self) > most:
            kept = [(x, self[x]) for x in now if x in self]
            self.clear()
            self.update(kept)
        return self


_held: dict[tuple[str, ...], Memory] = {}


def memory(*what: str) -> Memory:
    """The memory of a worker process. Workers serve one operator after the other: when another
    one asks, what the last one remembered is dropped, so a worker never holds two of them."""
    if what not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[what] = Memory()
    return _held[what]
