"""Whole-text encoding with a tokenizers file.

A byte-pair model encodes each pre-token by itself, so every distinct
space-free word is encoded once and a text's ids are its words' ids joined.
Words made of ASCII and Latin-1 letters, digits and signs are cut into
pre-tokens here and given to the library's model; all other words
(apostrophes, other scripts, special-token strings) go to its full pipeline.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The normaliser and pre-tokenizer for which words can be encoded by themselves as below.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: No apostrophe (it opens contractions) and no "<" (it opens special tokens).
_PLAIN_WORD = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_PRE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Parts(dict):
    """Pre-token to little-endian ids."""

    def __init__(self, tokenizer, most: int):
        from tokenizers import pre_tokenizers

        self._model, self._most = tokenizer.model, most
        self._spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, part: str) -> bytes:
        spelled = part if part.isascii() else self._spell(part)[0][0]
        ids = np.array([t.id for t in self._model.tokenize(spelled)], dtype="<u4").tobytes()
        if len(self) < self._most:
            self[part] = ids
        return ids


class _Words(dict):
    """Space-free word to little-endian ids."""

    def __init__(self, tokenizer, most: int):
        self._tokenizer, self._most, self._parts = tokenizer, most, _Parts(tokenizer, most)

    def __missing__(self, word: str) -> bytes:
        if m := _LETTERS_SIGNS.fullmatch(word):
            letters, signs = m.groups()
            ids = self._parts[letters.lower()] + (self._parts[signs] if signs else b"")
        elif _PLAIN_WORD.fullmatch(word):
            ids = b"".join([self._parts[p] for p in _PRE_TOKEN.findall(word.lower())])
        else:
            ids = np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < self._most:
            self[word] = ids
        return ids


class TextEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Words are encoded by themselves if the file's normaliser and pre-tokenizer
    are the ones above, which never join characters across a space or a line
    feed and drop both; the tests compare it with the library on arbitrary
    texts. With any other file whole texts go to the library. ``most`` bounds
    the remembered words and the remembered pre-tokens of a worker (about 100
    MB each when full); the first ones, which hold the frequent ones, stay.
    """

    def __init__(self, tokenizer_path: str, end_id: int, most: int = 500_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        file = json.loads(tokenizer.to_str())
        self.by_words = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and file["model"]["type"] == "BPE"
        self._whole = tokenizer
        self._ids = _Words(tokenizer, most).__getitem__
        self._end = np.array([end_id], dtype="<u4").tobytes()

    def document(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text (null: empty), then the end id."""
        if not self.by_words:
            return np.array(self._whole.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes() + self._end
        return b"".join(map(self._ids, (text or "").replace("\n", " ").split(" "))) + self._end


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, end_id: int) -> TextEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return TextEncoder(tokenizer_path, end_id)
