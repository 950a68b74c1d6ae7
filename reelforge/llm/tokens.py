"""Token ids of a public byte-level BPE vocabulary, with a word cache.

The vocabulary splits a text into pre-tokens and encodes each one by itself,
so the ids of a text are the ids of its pre-tokens in a row.  A worker splits
with the same pattern, encodes every new pre-token once with ``tokenizers``
and keeps a bounded cache.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens whose ids a worker keeps; frequent ones come early and stay.
CACHE_PIECES = 400_000
#: White space as the vocabulary's own splitter has it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
           .replace(r"\S", f"[^{SPACE}]"))


def _latin(pattern: str) -> str:
    """The Latin-1 characters that match, as one class: a table look-up, where
    categories are tested one after the other."""
    return "[" + "".join(f"\\x{i:02x}" for i in range(256) if re.fullmatch(pattern, chr(i))) + "]"


LETTER, OTHER, BLANK = _latin(r"[^\W\d_]"), _latin(r"[^\s\w]|_"), _latin(r"\s")
#: The same pattern for Python's faster ``re``; right for Latin-1 texts without ODD characters.  Words, the most
#: frequent, are tried first: no other alternative begins like them.
LATIN = re.compile(f" ?{LETTER}+|'s|'t|'re|'ve|'m|'ll|'d| ?{OTHER}+| ?[0-9]+|{BLANK}+(?!\\S)|{BLANK}+").findall
ODD = "\x1c\x1d\x1e\x1f²³¹¼½¾".encode("latin-1")


def plain_latin(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, ODD)) == len(raw)


class Encoder:
    """Ids of pre-tokens are kept in one flat array; a pre-token is a number
    that gives its place there, so a text is a gather, not a loop over ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # New pre-tokens are encoded as they are, without being split again.
        self.whole = Tokenizer.from_file(path)
        self.whole.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.any_split = regex.compile(PATTERN).findall
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = regex.compile("|".join(map(regex.escape, special))).search if special else (lambda _: None)
        # A kept piece is a number: its ids are flat[begin:begin + size].
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0  # ids of the kept pieces
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of a byte-level token is one byte
            self.id_bytes[i] = len(token)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, begins) of new pre-tokens, encoded as one split text."""
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        encoded = self.whole.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        flat = np.array(encoded.ids, np.uint32)
        ends = np.cumsum(self.id_bytes[flat])
        sizes = np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces))
        return flat, np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes)) + 1])

    def split(self, text: str) -> list[str]:
        return LATIN(text) if plain_latin(text) else self.any_split(text)

    def _put(self, pieces: list[str]) -> int:
        """Ids of new pieces after those of the kept ones; how many may stay."""
        flat, begin = self._ids(pieces)
        kept, end = len(self.number), self.used + len(flat)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(end, len(self.flat)), np.uint32)])
        if kept + len(pieces) > len(self.begin):
            more = np.zeros(max(kept + len(pieces), len(self.begin)), np.int64)
            self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        self.flat[self.used:end] = flat
        self.begin[kept:kept + len(pieces)] = self.used + begin[:-1]
        self.size[kept:kept + len(pieces)] = np.diff(begin)
        return min(len(pieces), CACHE_PIECES - kept)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text, as ``tokenizers`` gives them without
        added special tokens (a special token's string in a text is its id)."""
        special = [self.special(t) is not None for t in texts]
        pieces = [[] if x else self.split(t) for t, x in zip(texts, special)]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = list(chain.from_iterable(pieces))
        known, kept = self.number, len(self.number)
        at = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        wanted = [flat[i] for i in missing]
        new = list(dict.fromkeys(wanted))
        stay = self._put(new)
        number = dict(zip(new, range(kept, kept + len(new))))
        at[missing] = np.fromiter(map(number.__getitem__, wanted), np.int64, len(wanted))
        begin, size = self.begin[at], self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        if stay > 0:  # the others were for this call only
            known.update(zip(new[:stay], range(kept, kept + stay)))
            self.used = int(self.begin[kept + stay - 1] + self.size[kept + stay - 1])
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if x else ids[a:b]
                for t, x, a, b in zip(texts, special, cuts[:-1], cuts[1:])]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
