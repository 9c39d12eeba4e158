"""Exact byte-pair encoding for piece models: model file, merges, and encoding by backtracking.

The encoder never runs the merges over a whole text. An Aho-Corasick automaton finds the longest
piece at every position; the encoder takes it if the piece and its left neighbour survive when the
two are merged anew (`compatible`), else a shorter one, else it gives the position up in a bitfield
and goes back one piece. A sequence whose neighbours are all compatible is the one that the merges
would give, so the result is exact.

Texts are cut before that where no piece can span the cut: before a word mark that follows another
character, at characters that are in no piece, and before marks that never follow a letter in a piece.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(blob: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = blob[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(blob: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(blob):
        key, at = _varint(blob, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(blob, at)
        else:
            if kind == 2:
                size, at = _varint(blob, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = blob[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE piece model with identity normalisation, a leading word mark and byte fallback.

    Other kinds of model raise ValueError: the cuts and the decoder rest on these properties.
    """

    #: Entries kept of words and of pairs of pieces; at the limit the memo starts anew, results stay.
    WORDS, PAIRS = 250_000, 1_000_000

    def __init__(self, blob: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) or USER_DEFINED in kinds:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and all white space kept")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if kinds.count(BYTE) != 256:
            raise ValueError("the model has no byte fallback")
        self.chars = {c for p in self.ids for c in p}
        if not all(c in self.ids for c in self.chars) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with characters or word marks that the cuts do not allow for")
        self.longest_piece = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self._pairs: dict[int, bool] = {}
        #: The longest piece that is a proper prefix of each piece, or -1.
        self.shorter = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self._alone: dict[int, bool] = {}
        self._runs: dict[int, tuple[int, ...]] = {}
        self._words = _Words(self)
        self.cut = self._cuts()
        # A byte over 127 becomes a lone surrogate until the bytes of its character are together.
        self._decoded = [
            "" if k in (CONTROL,) else " ⁇ " if k == UNKNOWN else p.replace(MARK, " ")
            for p, k in zip(self.pieces, kinds)
        ]
        for b, i in enumerate(self.byte_ids):
            self._decoded[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self._high = set(self.byte_ids[128:])

    def _cuts(self) -> re.Pattern:
        """Matches stretches between which no piece can span."""
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        never = "".join(sorted({a for p in self.ids for a, b in zip(p, p[1:]) if b in marks and re.match(r"[^\W\d_]", a)}))
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in self.chars))
        word = rf"\W\d_{re.escape(never)}"  # within [^...]: letters that no piece has right before one of the marks
        other = rf"[^ {alone}]"
        letters, rest = f"[^{word}]", f"(?![^{word}]){other}"
        own = re.escape("".join(sorted(marks)))
        return re.compile(rf"[{alone}]| *(?:{rest})*{letters}*(?:(?![{own}]){rest}(?:{rest})*{letters}*)*")

    # Merges

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of a text of known characters by the merges themselves: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (k := self.ids.get(w := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, w))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, w = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != w:
                continue
            parts[i], parts[j] = w, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return tuple(self.ids[p] for p in parts if p is not None)

    def compatible(self, a: int, b: int) -> bool:
        """True if the two pieces, merged anew, stay as they are."""
        key = a << 20 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= self.PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == (a, b)
        return found

    def alone(self, a: int) -> bool:
        """True if the merges can make the piece from its own text."""
        found = self._alone.get(a)
        if found is None:
            found = self._alone[a] = self.merge(self.pieces[a]) == (a,)
        return found

    # Encoding

    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n word marks that no word follows closely; their pieces tie, so merges give them."""
        found = self._runs.get(n)
        if found is None:
            if len(self._runs) > 10_000:
                self._runs.clear()
            found = self._runs[n] = self.merge(MARK * n)
        return found

    def backtrack(self, word: str) -> list[int]:
        """Ids of a stretch of known characters with one word mark at most, at its start."""
        n = len(word)
        sizes, known, shorter = self.sizes, self._pairs.get, self.shorter
        longest = [0] * n
        for end, i in self.automaton.iter(word):
            longest[end - sizes[i] + 1] = i  # ends come in order: the last is the longest
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            end = at + sizes[piece]
            if failed[end >> 3] >> (end & 7) & 1:
                fits = False
            elif last < 0:
                fits = self.alone(piece)
            else:
                fits = known(last << 20 | piece)
                if fits is None:
                    fits = self.compatible(last, piece)
            if fits:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, longest[end]
                continue
            piece = shorter[piece]
            while piece < 0:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= sizes[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a match of `cut`."""
        rest = text.lstrip(" ")
        marks = len(text) - len(rest)
        if self.chars.issuperset(rest):
            return tuple(self._marked(marks, rest))
        out: list[int] = []
        known = ""
        for c in rest:
            if c in self.chars:
                known += c
                continue
            out += self._marked(marks, known)
            out += [self.byte_ids[b] for b in c.encode()]
            marks, known = 0, ""
        return tuple(out + self._marked(marks, known))

    def _marked(self, marks: int, known: str) -> list[int]:
        if not known:
            return list(self.run(marks)) if marks else []
        if not marks:
            return self.backtrack(known)
        out = self.backtrack(MARK + known)
        if marks > 1:  # runs of marks have the lowest scores: the word takes its mark first
            if out[0] == self.ids[MARK]:
                return [*self.run(marks), *out[1:]]
            return [*self.run(marks - 1), *out]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without begin or end ids; null and empty texts have none."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return list(chain.from_iterable(map(self.stretch, self.cut.findall(" " + text))))
        return list(chain.from_iterable(map(self._words.__getitem__, text.split(" "))))

    def forget(self) -> None:
        """Drops the words met so far, so that an idle worker does not hold them."""
        self._words.clear()
        self._words.parts.clear()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids. Bytes that are no UTF-8 become U+FFFD, one for each byte."""
        text = "".join(map(self._decoded.__getitem__, ids))
        if text[:1] == " ":
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            text = _join_bytes(text)
        return text


_BYTES = re.compile("[\udc80-\udcff]+")


def _join_bytes(text: str) -> str:
    def joined(m: re.Match) -> str:
        raw, out = bytes(ord(c) - 0xDC00 for c in m[0]), []
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]
        return "".join(out)

    return _BYTES.sub(joined, text)


class _Words(dict):
    """Words met so far, each after one space, and their ids."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.parts: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        model, parts = self.model, self.parts
        if len(self) >= model.WORDS:
            self.clear()
        if len(parts) >= model.WORDS:
            parts.clear()
        stretches = model.cut.findall(" " + word)
        if len(stretches) == 2:  # the last is empty
            ids = model.stretch(stretches[0])
        else:
            ids = ()
            for s in stretches:
                own = parts.get(s)
                if own is None:
                    own = model.stretch(s)
                    if len(s) <= 64:
                        parts[s] = own
                ids += own
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def load_model(blob: bytes) -> PieceModel:
    """The model of a file's bytes, once for each Python worker."""
    return PieceModel(blob)
