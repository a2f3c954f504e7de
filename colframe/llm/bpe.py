"""Byte-level BPE ids of whole texts, through a cache of space-separated chunks.

Ids equal those of ``tokenizers`` with add_special_tokens=False. A space between two characters that aren't
white space always begins a new pre-token, so texts are cut there and each chunk is encoded once per worker.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Spaces at which cutting could change pre-tokens: those next to other white space.
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Chunks in this range have the same letter classes in every Unicode version.
_PLAIN = re.compile("[\x00-ɏ]*")
#: The pre-token pattern of byte-level BPE (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Cache(dict):
    """chunk -> ids as little-endian uint32 bytes; holds max_entries at most."""

    def __init__(self, encode, prefix: str, max_entries: int):
        super().__init__()
        self.encode, self.prefix, self.max_entries = encode, prefix, max_entries

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(self.prefix + chunk), "<u4").tobytes()
        if len(chunk) <= 40:
            if len(self) >= self.max_entries:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts with the tokenizer file at path (JSON); uses a file of ranks beside it where there is one."""

    def __init__(self, path: str, max_entries: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cache = _Cache(self._piece, " ", max_entries)

    def _piece(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        head = np.array(self._piece(first), "<u4").tobytes() if first else b""  # none: the text starts with a space
        return head + b"".join(map(self.cache.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes."""
        if not text:
            return b""
        if self.special_re is not None and any(s in text for s in self.special):
            out = []
            for part in self.special_re.split(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    out.append(self._plain(part))
            return b"".join(out)
        return self._plain(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives up this process's encoders; encoder() makes them anew."""
    _encoders.clear()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
