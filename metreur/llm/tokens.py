"""Token ids of whole texts by public tokenizers, for use inside tasks.

:class:`WordIds` serves tokenizer files that cut texts at white space, lower them and
mark word ends (``word_bpe_49k.json``). A text's ids are those of its pieces between white
space, one after the other, and pieces recur, so a worker keeps the ids of the first
``KEPT`` it meets. A new piece is encoded by the same merges in tiktoken, where the end of
a word is a character of its own that is merged first; pieces with letters beyond
Latin or with special tokens go to the tokenizer itself.

:class:`ByteIds` serves files of byte-level ranks (``*.tiktoken``).
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from metreur.llm.common import tokenizer_file

#: Pieces whose ids a worker keeps (some 150 bytes each).
KEPT = 500_000
#: Stands for the end of a word; pieces that hold it are left to the tokenizer itself.
_END = "\ue000"
_SHIFT = 1000
#: Where the fast way may differ: beyond Latin Extended-B, and special tokens.
_ODD = re.compile("[^\x00-\u024f]|<\\|")
_SPACE = re.compile("[ \t\n\r]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str, kept: int = KEPT):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        self.table: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        letters, suffix = _byte_letters(), said["model"]["end_of_word_suffix"]
        special = {t["content"] for t in said["added_tokens"]}
        end = _END.encode()
        ranks = {}
        for token, number in said["model"]["vocab"].items():
            if token not in special:
                ended = token.endswith(suffix)
                raw = bytes(letters[c] for c in (token[: -len(suffix)] if ended else token))
                ranks[raw + end * ended] = number + _SHIFT
        ranks |= {end[:2]: 0, end: 1}  # in place of letters that the fast way never sees
        pattern = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(pattern + "|\n")
        self._encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self._line = ranks[b"\n" + end]

    def encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without white space, by piece."""
        plain, found = pieces, {}
        if _ODD.search(" ".join(pieces)):
            plain = [p for p in pieces if not _ODD.search(p)]
            for p in {*pieces}.difference(plain):
                found[p] = array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
        if plain:
            # One text for all: a line end after each piece becomes a token of its own that tells where the piece ends.
            lines = "\n".join(plain) + "\n"
            if not lines.isascii():
                lines = unicodedata.normalize("NFC", lines)
            words = self._word.findall(lines.lower())
            every = np.array(self._encoding.encode_ordinary(_END.join(words) + _END), np.uint32)
            ids, at = (every - np.uint32(_SHIFT)).tobytes(), 0
            for p, stop in zip(plain, (4 * np.flatnonzero(every == self._line)).tolist(), strict=True):
                found[p] = ids[at:stop]
                at = stop + 4
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids (unsigned 32 bit) without special tokens around; null and empty have none."""
        if not text:
            return np.zeros(0, np.uint32)
        if "<|" in text:  # a special token may hold white space or reach past it
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        # str.split() also cuts at these four, which are no white space to the tokenizer.
        pieces = _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        found = list(map(self.table.get, pieces))
        if None in found:
            gone = [k for k, f in enumerate(found) if f is None]
            new = self.encoded(list({pieces[k] for k in gone}))
            for k in gone:
                found[k] = new[pieces[k]]
            if len(self.table) + len(new) <= self.kept:
                self.table.update(new)
        return np.frombuffer(b"".join(found), np.uint32)

    def count(self, text: str | None) -> int:
        return len(self.ids(text))


class ByteIds:
    """The pattern of these files never joins what stands on the two sides of a lone space, which belongs to what follows it."""

    def __init__(self, path: str, kept: int = 900_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.kept = kept
        self.table: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def _found(self, text: str) -> list[bytes]:
        """Ids of the text's pieces, in order; the whole text's where it is not cut."""
        first, *pieces = text.split(" ")
        found = list(map(self.table.get, pieces))
        # Spaces beside other white space are not lone: such a text is encoded whole. A piece in the table never is one.
        if not first or first[-1].isspace():
            return [self._encoded(text)]
        if None in found:
            gone = [k for k, f in enumerate(found) if f is None]
            fresh = list(dict.fromkeys([pieces[k] for k in gone]))
            if any(not p or p[0].isspace() or p[-1].isspace() for p in fresh):
                return [self._encoded(text)]
            # All in one go: a piece holds no space, so each begins with the only token that does.
            every = np.array(self.encoding.encode_ordinary(" " + " ".join(fresh)), np.uint32)
            raw, cuts = every.tobytes(), (4 * np.flatnonzero(self.opens[every])).tolist() + [4 * len(every)]
            new = {p: raw[a:b] for p, a, b in zip(fresh, cuts[:-1], cuts[1:], strict=True)}
            for k in gone:
                found[k] = new[pieces[k]]
            if len(self.table) + len(new) <= self.kept:
                self.table.update(new)
        return [self._encoded(first), *found]

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids (unsigned 32 bit); null and empty have none."""
        return np.frombuffer(b"".join(self._found(text)), np.uint32) if text else np.zeros(0, np.uint32)

    def count(self, text: str | None) -> int:
        """How many ids the text has."""
        return sum(map(len, self._found(text))) // 4 if text else 0


@lru_cache(maxsize=4)
def tokenizer(name: str) -> WordIds | ByteIds:
    """One per worker; ``name`` is a public tokenizer's file name or a path."""
    path = name if "/" in name else tokenizer_file(name)
    return ByteIds(path) if path.endswith(".tiktoken") else WordIds(path)
