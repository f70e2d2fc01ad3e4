"""Token ids of whole texts by a word-level BPE tokenizer file, with a memory of chunks.

Texts are cut at ASCII white space, which this kind of tokenizer drops, so chunks are independent. Chunks of plain
Latin letters, digits and signs go straight to the merge model after the file's own normal form and pre-tokens, spelled
out here for that alphabet; all others go through the whole tokenizer. Ids of chunks and pre-tokens are remembered per
worker, in two ages: when the newer one is full it becomes the older one, and what is met again there moves back.
"""

from __future__ import annotations

import re
import sys
import types
from array import array

REMEMBERED = 300_000  # chunks of an age; two ages are kept per worker, about 100 MB
LONGEST_KEPT = 40  # bytes; longer chunks are encoded each time
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(rf"[!-~À-ÖØ-öø-ÿ]+")
#: The pre-token pattern of the tokenizer file, for lower-case text of the alphabet above.
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def worker_memory() -> dict:
    """A dictionary that lives as long as the worker process, whatever is sent to it."""
    return sys.modules.setdefault("skyloom_worker_memory", types.ModuleType("skyloom_worker_memory")).__dict__.setdefault("memory", {})


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest follows from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class ChunkEncoder(dict):
    """Little-endian ids (``dtype``) by chunk of bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, "".join(_byte_letters())
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def merged(self, letters: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def coded(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters only: one pre-token of plain letters
            low = chunk.lower()
            return self.merged(low.decode()) if low == chunk else self[low]
        if chunk[-1:] in (b".", b",") and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1:]]  # two pre-tokens, and the first may be known
        text = chunk.decode()
        if not _PLAIN.fullmatch(text) or self.special.search(text):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = [word.encode() for word in _PRE.findall(text.lower())]
        if len(words) > 1:  # a pre-token alone is one pre-token again
            return b"".join([self[word] for word in words])
        return self.merged(words[0].decode("latin-1").translate(self.letters))

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.coded(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> ChunkEncoder:
    known = worker_memory()
    if ("chunks", path) not in known:
        known["chunks", path] = ChunkEncoder(path)
    return known["chunks", path]
