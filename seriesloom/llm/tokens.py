"""Subword ids by the tokenizers library, with a per-worker cache of white-space chunks.

For a tokenizer that drops white space and looks at no context across it, the
ids of a text are the joined ids of its white-space chunks, so each worker
encodes a chunk once.  Chunks of plain lower-case letters and trailing
punctuation go straight to the library's BPE model; all others go through the
library's whole pipeline.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import codecs
import json
import re
import struct

from .common import word_blocks, worker_state

#: Letters that are lower case and stay as they are under NFC: a-z and the Latin-1 ones; then ASCII punctuation but the apostrophe.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)")
#: That punctuation.
MARKS = bytes(c for c in range(0x21, 0x7F) if PLAIN.fullmatch(bytes([c])) and not chr(c).isalpha())
#: Entries that a worker's cache holds at most; then it starts anew. The large one takes about 140 MB more.
CACHE_ENTRIES, LARGE_CACHE = 400_000, 900_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _drops_spaces(spec: dict) -> bool:
    """Whether chunks between ASCII white space can be encoded one by one."""
    norm = spec.get("normalizer") or {}
    pre = spec.get("pre_tokenizer") or {}
    steps = [n["type"] for n in norm.get("normalizers", [])]
    first, *rest = pre.get("pretokenizers") or [{}]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and [r["type"] for r in rest] == ["ByteLevel"]
        and not rest[0]["add_prefix_space"]
        and not any(a.get("lstrip") or a.get("rstrip") or re.search(r"\s", a["content"]) for a in spec.get("added_tokens", []))
        and spec.get("model", {}).get("dropout") is None
    )


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_chunk = _drops_spaces(json.load(f))
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.entries = entries
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        hidden = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.alphabet = "".join(hidden.get(b, chr(b)) for b in range(256))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, core: bytes) -> bytes:
        if (got := self.cache.get(core)) is None:
            word = codecs.charmap_decode(core, "strict", self.alphabet)[0]
            got = self.cache[core] = self._pack([t.id for t in self.model.tokenize(word)])
        return got

    def _learn(self, chunks: list[bytes]) -> None:
        """Puts chunks that are not there yet into the cache."""
        new = set(chunks).difference(self.cache)
        if len(self.cache) > self.entries and new:
            self.cache.clear()
            new = set(chunks)
        slow = []
        for c in new:
            core = c.rstrip(MARKS)
            if core.isalpha() and core.islower():  # a-z alone
                self.cache[c] = self._letters(core) + self._letters(c[len(core) :]) if len(core) < len(c) else self._letters(c)
            elif m := PLAIN.fullmatch(c):
                core, marks = m.groups()
                self.cache[c] = (self._letters(core) if core else b"") + (self._letters(marks) if marks else b"")
            else:
                slow.append(c)
        for i in range(0, len(slow), 1024):
            part = slow[i : i + 1024]
            for c, e in zip(part, self._batch([c.decode() for c in part]), strict=True):
                self.cache[c] = self._pack(e.ids)

    def _batch(self, texts: list[str]):
        f = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return f(texts, add_special_tokens=False)

    def pieces(self, chunks: list[bytes], lowered: bool = False) -> list[bytes]:
        """Ids of each chunk of a text split at ASCII white space; ``lowered``: A-Z is lower-cased already."""
        if not self.by_chunk:
            return [self._pack(e.ids) for e in self._batch([c.decode() for c in chunks])]
        if not lowered:
            chunks = [c if b"<|" in c else c.lower() for c in chunks]
        self._learn(chunks)
        return list(map(self.cache.__getitem__, chunks))

    def encode(self, text: bytes) -> bytes:
        if not self.by_chunk:
            return self._pack(self._batch([text.decode()])[0].ids)
        return b"".join([self._block(b) for b in word_blocks(text)])

    def _block(self, text: bytes) -> bytes:
        # lower-casing could make a special token's name out of other text
        chunks = text.split() if b"<|" in text else text.lower().split()
        self._learn(chunks)
        return b"".join(map(self.cache.__getitem__, chunks))


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    state = worker_state(("encoder", path))
    if "e" not in state:
        state["e"] = Encoder(path)
    state["e"].entries = entries
    return state["e"]
