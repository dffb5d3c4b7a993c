"""Token ids of whole texts with a public word-level BPE vocabulary."""

from __future__ import annotations

import os
import re

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word with a character whose normal form, lower case or class isn't plain, or with a special token in it.
_EXOTIC = re.compile(rf"[^\x20-\x7e\n\t\r{_LETTER}]|<\|")
_EXOTIC_WORD = re.compile(rf"([^ \n\t\r]*(?:[^\x20-\x7e\n\t\r{_LETTER}]|<\|)[^ \n\t\r]*)")
#: What a text of letters, spaces, single dots and commas doesn't have.
_ODD = re.compile(rf"[^{_LETTER} \n.,]|[.,][.,]")
#: Units of a lower-case text without exotic words, as the vocabulary's own rule has them.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \n\t\ra-z0-9ß-öø-ÿ]+")
#: Exotic words whose ids a worker keeps.
CACHE_WORDS = 200_000


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers, equal to encoding the whole text at once.

    The vocabulary drops white space, never joins characters across it, and ends each word with a
    token of its own kind. A space after each word can therefore stand for the word's end, and the
    vocabulary is then one of plain byte strings whose ids are their merge ranks, which a byte-level
    encoder applies to text of Latin letters. Words with other characters go to the full tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        vocabulary = self._whole.get_vocab(with_added_tokens=False)
        self._bytes = Encoding(path, pat_str="[^ ]+ ", mergeable_ranks=_byte_ranks(vocabulary), special_tokens={})
        self._exotic: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not _EXOTIC.search(text):
            return self._plain(text)
        parts = _EXOTIC_WORD.split(text)
        return b"".join([self._word(part) if i & 1 else self._plain(part) for i, part in enumerate(parts)])

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            text = " ".join(_UNITS.findall(text.lower()))
        else:
            text = text.lower().replace("\n", " ").replace(",", " , ").replace(".", " . ")
        return self._bytes.encode_to_numpy(text + " ", disallowed_special=()).astype("<u4", copy=False).tobytes()

    def _word(self, word: str) -> bytes:
        if word not in self._exotic:
            if len(self._exotic) > CACHE_WORDS:
                self._exotic.clear()
            self._exotic[word] = np.array(self._whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self._exotic[word]


def _byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of the tokens that aren't special, a space for the end of a word.

    The vocabulary writes printable characters of Latin-1 as themselves and the other bytes, in
    order, as the characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {}
    for token, rank in vocabulary.items():
        stem = token.removesuffix("</w>")
        if not token.startswith("<|"):
            ranks[bytes(byte[c] for c in stem) + (b" " if stem != token else b"")] = rank
    return ranks


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
