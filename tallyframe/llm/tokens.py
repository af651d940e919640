"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

Pre-tokenization of the supported files never reaches over certain white space, so the ids of a text
are the ids of its pieces in order. Pieces are kept with their ids; a text for which the rule does not
hold (other white space next to the cut, strings of special tokens) is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np

#: Latin letters and marks that end a piece: a cut between them is one between pre-tokens of either kind of file. U+0130 is
#: none of them, since its lower case ends in a combining mark.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-\u012F\u0131-ɏ]+", r'[.,!?;:|$%&*#"]'
#: Pieces that keep the white space before them, and pieces without it.
LEADING = re.compile(rf"[ \n]?{_LETTERS}(?=[ \n]|{_MARKS}|\Z)|{_MARKS}+(?=[ \n]|\Z)|[ \n]*[^ \n]+|[ \n]+")
BARE = re.compile(rf"{_LETTERS}(?=[ \n]|{_MARKS}|\Z)|{_MARKS}+(?=[ \n]|\Z)|[^ \n]+")
#: Letters for which lower case is the same before and after normalization, in any context.
_NOT_LATIN = re.compile("[^\x00-\u012F\u0131-\u024F]")
_OTHER_SPACE = re.compile(r"[^\S \n]|<\|")


#: Pieces encoded by one call, and pieces put into one string.
AT_ONCE, TOGETHER = 4096, 256
#: Characters of the texts that are looked at together, if they are several.
CHARS = 100_000


class Whole(Exception):
    """The text must be encoded in one call."""


class Encoder:
    """encode(text): the ids as little-endian unsigned integers of `width` bytes, without special tokens added."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, norm = file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
        self.strict, self.pattern = True, None
        self.lower = "Lowercase" in (n.get("type") for n in norm.get("normalizers", ()))
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
            self.pattern = LEADING
        elif before.get("type") == "Sequence" and before["pretokenizers"][0].get("type") == "Split" and before["pretokenizers"][0].get("behavior") == "Removed" and r"[^\s" in json.dumps(before["pretokenizers"][0]).replace("\\\\", "\\"):
            self.strict, self.pattern = False, BARE
        self.bytes = None
        if self.strict and self.pattern is not None:  # tokens of such a file are strings of a letter a byte
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def raw(self, text: str) -> bytes:
        return array("H" if self.width == 2 else "I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, new: set[str]) -> None:
        """Adds the ids of pieces that are not known, by one call for those that were not met before."""
        known, older, fresh = self.pieces, self.older, []
        for p in new:
            if (ids := older.get(p)) is None:
                fresh.append(p)
            else:
                known[p] = ids
        if any("<|" in p for p in fresh) or self.strict and _OTHER_SPACE.search("".join(fresh)):
            raise Whole
        kind = "H" if self.width == 2 else "I"
        if self.bytes is not None:
            cut = [p for p in fresh if p[0] in " \n" and p[-1] not in " \n"]  # in any order, white space that is a cut is between them
            fresh = [p for p in fresh if p[0] not in " \n" or p[-1] in " \n"]
            for at in range(0, len(cut), TOGETHER):
                some = cut[at : at + TOGETHER]
                if (got := self.together(some)) is None:
                    fresh += some
                else:
                    known.update(zip(some, got))
                    self.held += sum(map(len, some))
        for at in range(0, len(fresh), AT_ONCE):  # the library's results are large
            some = fresh[at : at + AT_ONCE]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[piece] = array(kind, got.ids).tobytes()
                self.held += len(piece)

    def together(self, some: list[str]) -> list[bytes] | None:
        """The ids of each piece, encoded as one string and divided by the bytes of the tokens; None if a token is not of one piece."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
        ends, want = np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in some])
        last = np.searchsorted(ends, want)
        if not len(ids) or ends[-1] != want[-1] or (ends[last] != want).any():
            return None
        data, cuts = ids.astype(f"<u{self.width}").tobytes(), [0, *((last + 1) * self.width).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def divided(self, text: str) -> list[str]:
        if self.lower and not _NOT_LATIN.search(text) and "<|" not in text:
            text = text.lower()  # the file lowers it anyhow, and there are fewer pieces then
        return self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        return self.encode_some([text])[0]

    def encode_some(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces that are new in any of them are encoded together."""
        if self.pattern is None:
            return [self.raw(t) for t in texts]
        if len(self.pieces) > self.most or self.held > 40 * self.most:  # what was not used since the last time goes
            self.older, self.pieces, self.held = self.pieces, {}, 0
        new, found = set(), []
        for pieces in map(self.divided, texts):
            got = list(map(self.pieces.get, pieces))
            places = list(compress(range(len(got)), map(is_, got, repeat(None)))) if None in got else []
            missing = [pieces[i] for i in places]
            new.update(missing)
            found.append((got, places, missing))
        if new:
            try:
                self.learn(new)
            except Whole:
                return [self.raw(texts[0])] if len(texts) == 1 else [self.encode(t) for t in texts]
        for got, places, missing in found:
            for i, p in zip(places, missing):
                got[i] = self.pieces[p]
        return [b"".join(got) for got, _, _ in found]

    def encode_each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, of some texts at a time."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= CHARS:
                yield from self.encode_some(some)
                some, chars = [], 0
        if some:
            yield from self.encode_some(some)


@lru_cache(maxsize=4)
def encoder(path: str, most: int = 500_000) -> Encoder:
    """One encoder a worker and file; most: pieces kept, some 150 bytes each."""
    return Encoder(path, most)
