"""Byte-pair encoders over public vocabulary files.

The merge loop is tiktoken's compiled one. A vocabulary of the tokenizers library is brought to
its form: tokens become byte strings, ids ascend in merge order, and a word end is the byte FF,
which no UTF-8 text holds. Tests hold the ids against the library that each file belongs to.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import struct
import unicodedata

import regex
import tiktoken

#: The code points of the Unicode property White_Space, which the tokenizers' \s stands for.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space with the run of other characters after it: no token of a byte-level
#: pattern crosses the border between two such chunks, and none looks beyond one.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Characters that str.split() drops and White_Space does not hold.
SEPARATORS = re.compile("[\x1c-\x1f]")
NOT_SPACE = re.compile(f"[^{WHITE_SPACE}]+")


@functools.lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """The printable alphabet of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(8)
def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(4)
def byte_level(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level vocabulary (a .json of the tokenizers library, or ranks) with its special tokens."""
    if not path.endswith(".json"):
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tiktoken_ranks(path), special_tokens={})
    with open(path) as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_of_char()
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class WordEndBpe:
    """A lower-casing vocabulary with word ends, as in word_bpe_49k.json: text to little-endian unsigned 32-bit ids.

    White space always ends a word and is dropped, so ids are kept by chunk; the kept chunks are
    bounded by max_kept and thrown away together when that is reached.
    """

    END = b"\xff"

    def __init__(self, path: str, max_kept: int = 500_000):
        with open(path) as f:
            spec = json.load(f)
        alphabet = byte_of_char()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            stem = token.removesuffix("</w>")
            ranks[bytes(map(alphabet.__getitem__, stem)) + self.END * (stem != token)] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._merge = tiktoken.Encoding("word-end", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(words.replace(r"\s", r"\p{White_Space}")).findall
        self._kept: dict[str, bytes] = {}
        self._max_kept = max_kept

    def _plain(self, chunk: str) -> list[int]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            # Lower case is taken character by character; only the final sigma depends on its neighbours.
            chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        elif chunk.isalpha():
            return self._merge(chunk.lower().encode() + self.END)
        else:
            chunk = chunk.lower()
        out: list[int] = []
        for word in self._words(chunk):
            out += self._merge(word.encode() + self.END)
        return out

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk and self._split_special:
            ids: list[int] = []
            for part in self._split_special(chunk):
                ids += [self.special[part]] if part in self.special else self._plain(part)
        else:
            ids = self._plain(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        chunks = NOT_SPACE.findall(text) if SEPARATORS.search(text) else text.split()
        kept = self._kept
        try:
            return b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            pass
        if len(kept) > self._max_kept:
            kept.clear()
        out = []
        for chunk in chunks:
            ids = kept.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= 200:
                    kept[chunk] = ids
            out.append(ids)
        return b"".join(out)


@functools.lru_cache(2)
def word_end(path: str) -> WordEndBpe:
    return WordEndBpe(path)
