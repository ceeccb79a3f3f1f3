"""Token counts of a public byte-level vocabulary, by pre-token with a cache of what was seen."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

#: Where the vocabulary files of public tokenizers lie; a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII text in the standard library's syntax.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
CACHE_WORDS = 500_000


class Tokenizer(dict):
    """Maps a pre-token to its number of tokens; merges never cross pre-tokens, so a text's count is their sum."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # the vocabulary's own engine counts only characters with the property White_Space as white space
        self.any = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank_end = regex.compile(r"\p{White_Space}+\Z")

    __hash__ = object.__hash__

    def __missing__(self, word: str) -> int:
        n = len(self.encoding.encode_ordinary(word))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def words(self, text: str) -> list[str]:
        return ASCII.findall(text) if text.isascii() else self.any.findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.words(text)))

    def cuts(self, word: str) -> list[tuple[int, int]]:
        """(tokens, characters) up to each place inside the word where a token ends with a character, the end included."""
        out, chars, pending = [], 0, b""
        for n, t in enumerate(self.encoding.encode_ordinary(word), start=1):
            pending += self.encoding.decode_single_token_bytes(t)
            try:
                chars += len(pending.decode("utf-8"))
            except UnicodeDecodeError:
                continue
            pending = b""
            out.append((n, chars))
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a worker process and file."""
    return Tokenizer(path)
