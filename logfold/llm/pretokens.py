"""Byte-level BPE by pre-tokens: text is cut by the vocabulary's pattern, and each distinct piece is encoded once.

The library itself encodes the pieces. Strings of special tokens are cut out first and become their ids, as
the library does by default.
"""

import os
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

# The pattern that byte-level vocabularies cut text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts without numerals other than digits and without separators that only Python calls white space.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
# Bytes of pieces and their ids that a task keeps, about.
CACHED_BYTES, ENTRY_BYTES = 24 << 20, 200

# Byte-level vocabularies write bytes as characters: printable ones as they are, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_plain, _any = re.compile(PLAIN), regex.compile(PATTERN)
_known: dict[str, bool] = {}


def _is_plain(c: str) -> bool:
    """True if both patterns see the character alike."""
    if c not in _known:
        if len(_known) > 100_000:
            _known.clear()
        kind = unicodedata.category(c)
        _known[c] = kind not in ("Nl", "No", "Cn", "Co") and not "\x1c" <= c <= "\x1f" and c != "\x85"
    return _known[c]


class Splitter:
    """Cuts text into pre-tokens and special tokens; needs no vocabulary in memory."""

    def __init__(self, special: list[str]):
        cut = "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))
        self._special = re.compile(f"({cut})") if cut else None

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order; together they are the text."""
        pattern = _plain if all(map(_is_plain, set(text))) else _any
        if self._special is None or not self._special.search(text):
            return pattern.findall(text)
        out = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else pattern.findall(part)
        return out


def special_tokens(path: str) -> list[str]:
    """The strings that the library looks for in texts before all else."""
    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


class Pieces:
    """A vocabulary file of the tokenizers library, with byte-level pre-tokens."""

    def __init__(self, path: str):
        # A task has one core; threads of the library would also keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = Splitter(list(self.special))
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._ids: dict[str, bytes] = {}
        self._held = 0

    def _encoded(self, pieces: list[str]):
        """Ids of each piece, by the model alone: pieces need no cutting any more."""
        run = self.tokenizer.model.tokenize
        for p in pieces:
            if p in self.special:
                yield [self.special[p]]
            else:
                yield [t.id for t in run(p.encode().decode("latin-1").translate(_BYTES))]

    def counts(self, pieces: list[str]) -> list[int]:
        """How many tokens each piece gives."""
        return [len(ids) for ids in self._encoded(pieces)]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian integers of ``type``."""
        if self._held > CACHED_BYTES:
            self._ids.clear()
            self._held = 0
        known = self._ids
        new = list(set(pieces).difference(known))
        for piece, found in zip(new, self._encoded(new)):
            known[piece] = np.array(found, self.type).tobytes()
            self._held += ENTRY_BYTES + 2 * len(piece)
        return [known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``type``."""
        return [b"".join(self.ids_of(self.split(t))) for t in texts]

    def decoder(self):
        """A function from ids to text. Bytes that are no UTF-8 become replacement characters, as in the library."""
        byte_of = {c: b for b, c in _BYTES.items()}
        table: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            known = token not in self.special and all(c in byte_of for c in token)
            table[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        return lambda ids: b"".join([table[i] for i in ids]).decode("utf-8", "replace")
