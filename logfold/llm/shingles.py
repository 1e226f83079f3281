"""Sets of five-word shingles and their MinHash signatures, over many texts at once.

Words are what white space separates, with A-Z in lower case. A shingle is a 64-bit hash of its
words' 64-bit hashes; a text of fewer than five words has one shingle, its whole sequence.
"""

import numpy as np

SHINGLE = 5
SYMBOLS, SYMBOL_BITS = 36, 16
CHUNK = 4

_random = np.random.Generator(np.random.PCG64(20240229))
_odd = lambda n: _random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _BASE, _PLACES = _odd(256), _odd(1)[0], _odd(SHINGLE)
_FLIP, _TIMES = _odd(SYMBOLS), _odd(SYMBOLS)
_powers = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    in_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(in_word.astype(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    of_text = np.searchsorted(starts, begin)
    if not len(starts):
        return np.zeros(0, np.uint64), of_text
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = _BYTE[data[in_word]] * _powers_to(int(lengths.max()))[place]
    return _mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), of_text


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted, distinct shingles of every text."""
    words, begin = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += words[k:k + len(rolled)] * _PLACES[k]
    rolled = _mix(rolled)
    sets = []
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a:b - SHINGLE + 1]))
        elif b > a:
            sets.append(_mix(np.add.reduce(words[a:b] * _PLACES[:b - a], keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS symbols per set: low bits of the smallest hash. Empty sets get zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        lengths = np.array([len(sets[i]) for i in full])
        first = np.cumsum(lengths) - lengths
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], first)
            out[full, k] = (least & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint16)
    return out


def index_keys(signs: np.ndarray) -> np.ndarray:
    """For every signature a key per chunk and open symbol: (chunk, open symbol, the other three), without loss."""
    keys = []
    wide = signs.astype(np.int64)
    for chunk in range(SYMBOLS // CHUNK):
        for open_at in range(CHUNK):
            key = np.full(len(signs), chunk * CHUNK + open_at, np.int64)
            for k in range(CHUNK):
                if k != open_at:
                    key = (key << SYMBOL_BITS) | wide[:, chunk * CHUNK + k]
            keys.append(key)
    return np.stack(keys, axis=1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """True if the sets share at least so many per cent of their union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
