"""Whole texts to token ids with a public tokenizer file, as fast as repeated words allow."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

#: Words whose ids a worker keeps at most.
CACHE_WORDS = 500_000
#: The tokenizer's own split, for chunks of these letters only; all others go through the tokenizer as they are.
_SIMPLE = re.compile(r"[\x21-\x7Eß-öø-ÿ]+\Z")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: A word before one mark, in UTF-8: put together from two known chunks instead of being kept as a third.
_MARKS = tuple(bytes([b]) for b in b".,;:!?")
_MARKED = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?])\Z")


def _byte_letters() -> str:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else one from U+0100 on."""
    spare = iter(range(256, 512))
    return "".join(chr(b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else next(spare)) for b in range(256))


class _Words(dict):
    """Chunk of a text -> its ids as bytes, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1:] in _MARKS and (marked := _MARKED.match(chunk)):
            return self[marked[1]] + self[marked[2]]
        if chunk.islower() and chunk.isalpha():  # ASCII letters are their own byte letters
            return self.keep(chunk, self.model.tokenize(chunk.decode()))
        given = chunk.decode("utf-8", "replace")
        text = given.lower()
        if not _SIMPLE.match(text):  # lower case is left to the tokenizer, whose rule for a final sigma is another
            found = self.whole(given)
        elif len(parts := _SPLIT.findall(text)) > 1:
            found = b"".join([self[p.encode()] for p in parts])
        else:
            letters = text.encode().decode("latin-1").translate(self.letters)
            return self.keep(chunk, self.model.tokenize(letters))
        if len(self) < CACHE_WORDS:
            self[chunk] = found
        return found

    def keep(self, chunk: bytes, tokens: list) -> bytes:
        found = array("I", [t.id for t in tokens]).tobytes()
        if len(self) < CACHE_WORDS:
            self[chunk] = found
        return found


class WordTokenizer:
    """Ids of whole texts for a vocabulary that lower-cases, drops white space and never joins across it.

    Under those rules the ids of a text are those of its chunks between ASCII white space, one after the other, so each
    chunk is encoded once per worker, as long as the worker's bounded table has room. Names of special tokens in a text
    count as those tokens; a text that might hold one is encoded in one piece.
    """

    def __init__(self, path: str, end_id: int | None = None):
        self.path, self.end_id, self._words = path, end_id, None

    def __reduce__(self):
        return WordTokenizer, (self.path, self.end_id)

    def forget(self) -> None:
        """Let go of the table of words."""
        self._words = None

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, then the end id; null counts as empty."""
        if self._words is None:
            self._words = _Words(self.path)
        get = self._words.__getitem__
        end = b"" if self.end_id is None else array("I", [self.end_id]).tobytes()
        return [
            (self._words.whole(t) if "<|" in t else b"".join(map(get, t.encode("utf-8", "replace").lower().split()))) + end
            for t in (text or "" for text in texts)
        ]
