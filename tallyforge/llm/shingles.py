"""Word shingles of whole texts as sets of 64-bit hashes, PartEnum signatures of such sets, and the exact
comparison of two texts.

Words are cut on the bytes of Arrow columns and told apart by Arrow's dictionaries, which compare bytes.
Each distinct word is hashed by keyed BLAKE2, so no pair of words is made to collide by its letters; a
shingle's hash mixes those of its words. `similar_texts` uses no hash at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations, count

import numpy as np
import pyarrow as pa

U = np.uint64
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, np.int64).astype(U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KEY = b"word shingles"
#: Words whose hashes a process remembers.
REMEMBERED_WORDS = 250_000
_known: dict[bytes, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near values end far apart."""
    h = (h ^ h >> U(33)) * U(0xFF51AFD7ED558CCD)
    h = (h ^ h >> U(33)) * U(0xC4CEB9FE1A85EC53)
    return h ^ h >> U(33)


def _words(column: pa.Array) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """The words of all texts, one after another, as a dictionary array of bytes, and the place of each
    text's first word (one more at the end). Words are runs of other than ASCII white space, A-Z in
    lower case."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if n else None
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return None, np.zeros(n + 1, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    first[cuts] = word[cuts]
    starts = np.flatnonzero(first)
    letters = np.cumsum(word, dtype=np.int32)
    offsets = np.append(letters[starts] - 1, letters[-1]).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])])
    return array.dictionary_encode(), np.searchsorted(starts, ends)


def _hashes(words: pa.DictionaryArray) -> np.ndarray:
    _, ends, letters = words.dictionary.buffers()
    ends, letters = np.frombuffer(ends, np.int32, len(words.dictionary) + 1).tolist(), letters.to_pybytes() if letters else b""
    texts = [letters[a:b] for a, b in zip(ends, ends[1:])]
    made = list(map(_known.get, texts))
    if None in made:
        for k, w in enumerate(texts):
            if made[k] is None:
                made[k] = int.from_bytes(blake2b(w, digest_size=8, key=_KEY).digest(), "little")
                if len(_known) < REMEMBERED_WORDS and len(w) <= 64:
                    _known[w] = made[k]
    return np.array(made, U)[words.indices.to_numpy(zero_copy_only=False)] if made else np.zeros(0, U)


def forget() -> None:
    """Drops the words met so far, so that an idle worker does not hold them."""
    _known.clear()


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted hashes; fewer words than `size` are one shingle,
    none (or null) an empty set."""
    n = len(column)
    found, bounds = _words(column)
    if found is None:
        return [np.zeros(0, U)] * n
    words = _hashes(found)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    runs = len(words) - size + 1
    mixed = np.zeros(0, U)
    if runs > 0:
        mixed = words[:runs] * _PLACES[0]
        for k in range(1, size):
            mixed = mixed + words[k : k + runs] * _PLACES[k]
        mixed = mix(mixed)
    out = []
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        if b - a >= size:
            s = np.sort(mixed[a : b - size + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif b > a and valid[k]:
            out.append(mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + U((b - a) * 2 + 1)))
        else:
            out.append(np.zeros(0, U))
    return out


def similar_texts(a: str, b: str, size: int, percent: int) -> bool:
    """100 |a and b| >= percent |a or b| for the shingle sets of two texts, by the words themselves:
    words are numbered by Arrow's dictionary, and runs of words by sorting pairs of shorter runs."""
    found, bounds = _words(pa.array([a, b], pa.string()))
    counts = np.diff(bounds)
    if found is None or not counts.all():
        return False
    words = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if counts.min() < size:
        return len(set(counts)) == 1 and bool((words[: counts[0]] == words[counts[0] :]).all())
    runs, length = words, 1
    while length < size:
        more = min(length, size - length)
        other = runs if more == length else words if more == 1 else _runs(words, more)
        ahead = other[length : length + len(words) - length - more + 1]
        pairs = runs[: len(ahead)] << 32 | ahead
        runs, length = np.unique(pairs, return_inverse=True)[1], length + more
    left, right = np.unique(runs[: counts[0] - size + 1]), np.unique(runs[counts[0] :])
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    runs = words
    for k in range(1, length):
        ahead = words[k:]
        runs = np.unique(runs[: len(ahead)] << 32 | ahead, return_inverse=True)[1]
    return runs


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """127 bits of a set, as two signed numbers, of which the first is even."""
    both = [mix(mix(s + U(c)).sum(keepdims=True) + U(len(s))).view(np.int64)[0] for c in (0x1234567, 0x89ABCDE)]
    return int(both[0]) & ~1, int(both[1])


@dataclass(frozen=True)
class Band:
    """Sizes lo..hi of the smaller set of a pair, and up to `most` of the larger."""

    number: int
    lo: int
    hi: int
    most: int
    apart: int  # elements in which two similar sets of the band differ at most
    parts: int  # of the domain on the first level


#: Parts of each part on the second level, and how many of them may differ: signatures are made of all
#: subsets of SECOND - DIFFER of them. Three parts, one of which may differ, give half as many more
#: signatures than single parts of one level would, each of a third more elements.
SECOND, DIFFER = 3, 1
SUBSETS = tuple(combinations(range(SECOND), SECOND - DIFFER))


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40, ratio: float = 1.4) -> tuple[Band, ...]:
    """Bands for a Jaccard similarity of percent/100 or more. Sets of sizes s <= t are similar only if
    100 s >= percent t, and differ in (s + t)(100 - percent) / (100 + percent) elements at most."""
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * ratio) - 1)
        most = hi * 100 // percent
        apart = (hi + most) * (100 - percent) // (100 + percent)
        out.append(Band(len(out), lo, hi, most, apart, _parts(lo, apart)))
        lo = hi + 1
    return tuple(out)


def _solid(n: int, parts: int) -> float:
    """Share of the first level's parts of which more than DIFFER second-level parts hold some of n elements."""
    some = 1 - math.exp(-n / (parts * SECOND))
    return sum(math.comb(SECOND, k) * some**k * (1 - some) ** (SECOND - k) for k in range(DIFFER + 1, SECOND + 1))


def _parts(n: int, apart: int) -> int:
    """First-level parts, so many that the solid ones among them are enough (see `signatures`): the least
    of some fifty numbers for which what n elements are expected to fill, less two standard deviations,
    suffices. Where none gives that (small sets), the number that comes nearest; further partitions
    serve the rest."""
    least = apart // (DIFFER + 1) + 1

    def spare(parts: int) -> float:
        p = _solid(n, parts)
        return (parts * p - least) / math.sqrt(parts * p * (1 - p) + 1e-9)

    tried = sorted({least * (50 + k) // 50 for k in range(51)})
    return next((p for p in tried if spare(p) >= 2), max(tried, key=spare))


#: Bits of a signature. Different ones that agree in them make a bucket that needn't be, no more; six bytes
#: keep those rare up to some 10^13 signatures.
BUCKET_BITS = 48
#: Partitions of two levels that a set goes through before those of one level, which end for certain.
TWO_LEVEL = 12


def _partition(own: np.ndarray, mixed: np.ndarray, parts: int, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted elements and their hashes: the parts that hold any, and for each its smaller parts'
    hashes and whether they hold any."""
    small = ((own >> U(32)) * U(parts * second) >> U(32)).astype(np.int64)
    begins = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(small[1:] != small[:-1]) + 1])
    at = small[begins]
    part = at // second
    fresh = np.append(True, part[1:] != part[:-1])
    index = np.cumsum(fresh) - 1
    sums = np.zeros((int(index[-1]) + 1, second), U)
    held = np.zeros(sums.shape, bool)
    sums[index, at - part * second] = np.add.reduceat(mixed, begins)
    held[index, at - part * second] = True
    return part[fresh], sums, held


def signatures(s: np.ndarray, percent: int, family: int = 0) -> np.ndarray:
    """PartEnum signatures of a set, for each band that it can have a partner in.

    The domain falls into parts, each part into SECOND smaller ones. For each part, every subset of
    SECOND - DIFFER of the smaller ones gives a signature: the hash of the set's elements in them, if
    there are any. Call a part solid for a set if more than DIFFER of its smaller parts hold elements;
    then none of its subsets is empty. If two sets differ in `apart` elements at most, and one has more
    than apart / (DIFFER + 1) solid parts, then in one of these they differ in at most DIFFER smaller
    parts, and the subset of the others gives both the same signature.
    A set that has too few solid parts under a partition also gets the signatures of the next one, and
    so on until it has enough: two similar sets therefore share a signature under the first partition
    that suffices for either. After TWO_LEVEL such partitions (few sets get there) come partitions of
    one level, with ever more parts, which suffice once more than `apart` parts hold elements.
    Sets whose band allows no difference are similar only if equal, and equal sets are one node: they
    get none. Signatures are even and of BUCKET_BITS bits. `family` chooses independent partitions.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, U)
    salted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for band in bands(percent):
        if band.lo > n:
            break
        if n > band.most or not band.apart:
            continue
        for turn in count():
            seed = family * 1000 + turn
            if seed not in salted:
                own = s if seed == 0 else np.sort(mix(s + U(0xA0761D6478BD642F * (seed + 1) & (2**64 - 1))))
                salted[seed] = own, mix(own ^ U(0x5851F42D4C957F2D))
            if turn < TWO_LEVEL:
                parts, second, subsets, differ = band.parts, SECOND, SUBSETS, DIFFER
            else:
                parts, second, subsets, differ = min((2 * band.apart + 2) << (turn - TWO_LEVEL), 1 << 30), 1, ((0,),), 0
            first, sums, held = _partition(*salted[seed], parts, second)
            for k, subset in enumerate(subsets):
                whole = first.astype(U) * _PLACES[8] + U(int(_PLACES[9]) * (k + len(subsets) * (seed * 64 + band.number)) & (2**64 - 1))
                some = held[:, subset[0]]
                for j in subset:
                    whole += sums[:, j] * _PLACES[10 + j]
                    some = some | held[:, j]
                out.append(mix(mix(whole[some])))
            if int((held.sum(axis=1) > differ).sum()) * (differ + 1) > band.apart:
                break
    return np.concatenate(out) & U(2**BUCKET_BITS - 2) if out else np.zeros(0, U)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a and b| >= percent |a or b|, exactly."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit for each class of elements, set if their number is odd; about two bits an element."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Elements in which two sets differ at least: each odd difference of a class needs one."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
