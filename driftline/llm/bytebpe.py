"""Reading a byte-level BPE file, and encoding with it word by word."""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import regex

#: How such files split a text before any merge (fixed value).
#: Parts of lines whose ids a worker keeps.
REMEMBERED = 700_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Vocabulary, merges and special strings of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.path = path
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.merges = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        first = len(self.ids) - len(pairs)
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(self.ids[a + b] != first + rank for (a, b), rank in self.merges.items()):
            raise ValueError(f"{path}: not a plain byte-level BPE file whose ids follow its merges")

    @property
    def special_split(self) -> regex.Pattern | None:
        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


@cache
def load(path: str) -> ByteBpe:
    """One copy for each Python worker."""
    return ByteBpe(path)


class Parts(dict):
    """Ids of parts of texts, each with the same lead (a space or nothing); emptied when full."""

    def __init__(self, owner: Encoder, lead: str, most: int):
        self.owner, self.lead, self.most = owner, lead, most

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        word = part.rstrip(".,")
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            # one piece of letters, and perhaps one of punctuation
            found = (self.get(word) if len(word) < len(part) else None) or array("I", self.owner.piece((self.lead + word).encode())).tobytes()
            if len(word) < len(part):
                found += self.owner.marks[part[len(word) :]]
        else:
            found = self.owner.encode_whole(self.lead + part)
        self[part] = found
        return found


class Marks(dict):
    """Ids of short runs of punctuation."""

    def __init__(self, owner: Encoder):
        self.owner = owner

    def __missing__(self, marks: str) -> bytes:
        found = self.owner.encode_whole(marks)
        if len(self) < 1000:
            self[marks] = found
        return found


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, the same as the tokenizers library gives.

    A space or line break that no other white space touches always starts a new piece of the
    split, and a line break is then a piece by itself. So a text is the concatenation of its
    lines' space-separated parts, each but the first with its space; the ids of parts are kept.
    Texts with runs of white space, or with rarer kinds of it, go through whole. What has letters beyond
    Latin is left to the tokenizers library itself, whose character classes decide there; the
    rest goes through tiktoken with the same vocabulary, words of letters only as one piece.
    """

    RARE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    LATIN = re.compile(r"[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*\Z")

    def __init__(self, path: str, most: int = REMEMBERED):
        import tiktoken

        bpe = load(path)
        self.path, self.library = path, None
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=bpe.ids, special_tokens=bpe.special)
        self.special = set(bpe.special)
        self.core = self.fast._core_bpe
        self.piece = self.core.encode_single_piece
        self.spaced, self.bare, self.marks = Parts(self, " ", most), Parts(self, "", most // 5), Marks(self)
        self.line_break = self.encode_whole("\n")

    def encode_whole(self, text: str) -> bytes:
        if text.isascii() or self.LATIN.match(text):
            return array("I", self.core.encode(text, self.special)).tobytes()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return b"".join([self.bare[first] if first else b"", *map(self.spaced.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.RARE.search(text):
            return self.encode_whole(text)
        return self.line_break.join(map(self.encode_line, text.split("\n")))


@cache
def encoder(path: str, most: int) -> Encoder:
    return Encoder(path, most)
