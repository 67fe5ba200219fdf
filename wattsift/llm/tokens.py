"""Byte-pair encoding of whole texts with the tokenizers library.

Both vocabularies cut a text at its spaces before any merge, so the ids of a
text are the ids of its space-separated words, joined; and both cut a word into
runs of letters, of digits and of other signs.  ``CachedEncoder`` cuts words of
ASCII and Latin letters by the same pattern, asks the library's model for each
distinct run once, and remembers the ids of words.  All that this rule does not
cover goes to the library whole: words with other signs, texts with white space
about which patterns differ, and texts with a special token's string.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from string import punctuation

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Remembered words per worker; beyond it the memory starts anew.
CACHE_WORDS = 500_000

#: With which the strings of special tokens begin.
_SPECIAL = "<|"
#: White space that the byte-level pattern may join across our cuts.
_UNEVEN = re.compile(r"\s(?:\s|\Z)|\A\s|[\x1c-\x1f\x85]")
#: Strings one of which is in every text that _UNEVEN finds; looking for them is much faster.
_SIGNS = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Letters beyond ASCII that are letters in every version of Unicode, in both cases.
_LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and c.lower() < "\u0250")
#: Words that are cut into runs here.
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
# How the vocabularies cut such words.
_WORD_RUNS = re.compile(f"[a-z{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-z0-9{_LETTERS}]+")
_BYTE_RUNS = re.compile(f" ?[A-Za-z{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ A-Za-z0-9{_LETTERS}]+")


def _byte_signs() -> str:
    """The sign that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(hidden)) for b in range(256))


_BYTE_SIGNS = _byte_signs()


def _lowered(text: str) -> str:
    """Lower case for a vocabulary that folds case itself, where every version of Unicode folds alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def first_free_id(path: str) -> int:
    """The first id behind a vocabulary: no text has it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class _Words(dict):
    """Ids of words; on the byte level one that begins with a line feed follows it, and any other follows a space."""

    def __init__(self, library, byte_level: bool):
        super().__init__()
        self.library, self.model, self.byte_level = library, library.model.tokenize, byte_level
        self.space = _BYTE_SIGNS[32] if byte_level else ""
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._learn(word)
        self[word] = ids
        return ids

    def _run(self, signs: str) -> bytes:
        return array("I", [t.id for t in self.model(signs)]).tobytes()

    def _learn(self, word: str) -> bytes:
        line = self.byte_level and word[:1] == "\n"
        rest = word[1:] if line else word
        letters = rest.rstrip(punctuation)
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
            if tail := rest[len(letters) :]:  # signs behind letters are one run
                if tail not in self.tails:
                    self.tails[tail] = self._run(tail)
                return self[word[: len(word) - len(tail)]] + self.tails[tail]
            signs = letters if self.byte_level else letters.lower()
            if not signs.isascii():
                signs = signs.encode().decode("latin-1").translate(_BYTE_SIGNS)
            return self.line + self._run(signs) if line else self._run(self.space + signs)
        if self.byte_level and not line:
            rest = " " + rest
        if not _PLAIN.fullmatch(rest, rest[:1] == " "):
            ids = self.whole(rest)
        else:
            runs = _BYTE_RUNS.findall(rest) if self.byte_level else _WORD_RUNS.findall(rest.lower())
            ids = b"".join(self._run(x.encode().decode("latin-1").translate(_BYTE_SIGNS)) for x in runs)
        return self.line + ids if line else ids

    def forget(self, most: int) -> None:
        """Of two generations the older one goes when the newer one is full."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()
            self.tails.clear()


class CachedEncoder:
    """``encode(texts)`` gives, for each text, its ids as little-endian uint32 bytes: those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, byte_level: bool, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.byte_level, self.cache_words = byte_level, cache_words
        self.words = _Words(Tokenizer.from_file(path), byte_level)

    def _uneven(self, text: str) -> bool:
        return not text or text[-1] in " \n" or text[0] in " \n" or (any(x in text for x in _SIGNS) and bool(_UNEVEN.search(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self._encode, texts))

    def _encode(self, text: str) -> bytes:
        words = self.words
        words.forget(self.cache_words)
        if _SPECIAL in text or (self.byte_level and self._uneven(text)):
            return words.whole(text)
        if self.byte_level:  # as if a line feed stood before the text
            return b"".join(map(words.__getitem__, ("\n" + text).replace("\n", " \n")[1:].split(" ")))[len(words.line) :]
        return b"".join(map(words.__getitem__, _lowered(text).replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool) -> CachedEncoder:
    """One encoder per worker process, shared by the tasks that run in it."""
    return CachedEncoder(path, byte_level)
