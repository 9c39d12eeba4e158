"""Token counts by a compiled finite-state transducer whose chunk maps compose in a prefix scan.

A state of the transducer is what the pieces still to come can depend on: the longest stretch at the
end of the text that begins some piece and, for every place in it at which a piece could begin, the
last piece before that place and the number of tokens up to it, relative to the present. A transition
on a character is annotated with the tokens that it emits: the change of the count, which is negative
where pieces merge. States and transitions are compiled when they are first met.

Every text is cut into chunks of equal length, whatever they hold, and all chunks of many texts run
side by side. Word starts and unknown characters lead from any state to the same one: from the first
such place on, a chunk's exit and count don't depend on its entry, and only its head before that place
is still to be run once the entry is known. A chunk without such a place is a map of states: entry to
(exit, emitted tokens). Maps compose - entry to (the second's exit, the sum of both) - and composition
is associative, so a stretch of such chunks is scanned as a tree, neighbours first. A map holds the
entries that were asked of it so far: its first one is guessed, by running the end of the chunk before
it from the start state, because states mostly come together within a few characters; where the exit
of a neighbour is another state, the map is extended by running its chunks from there. A guess decides
what is computed in parallel, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .bpe import MARK, PieceModel, load_model
from .texts import map_texts

#: Classes of characters: a word mark after something else, one after a mark, unknown characters by
#: the bytes that they fall back to; known characters follow.
FIRST_MARK, NEXT_MARK, UNKNOWN, KNOWN = 0, 1, 2, 6
DEAD, START = 0, 1
#: Characters before a chunk that its entry is guessed from.
WARM = 24


@dataclass
class StateMap:
    """(exit, emitted tokens) by entry, for the entries met so far, of a chunk or of two maps in a row."""

    chunk: int = -1
    pair: tuple[StateMap, StateMap] | None = None
    known: dict[int, tuple[int, int]] = field(default_factory=dict)

    def get(self, entry: int, missing: dict[tuple[int, int], StateMap]) -> tuple[int, int] | None:
        """The entry's value; if a chunk has to run for it, None, and that chunk's map is in missing."""
        found = self.known.get(entry)
        if found is None and self.pair is None:
            missing[self.chunk, entry] = self
        elif found is None:
            first = self.pair[0].get(entry, missing)
            second = first and self.pair[1].get(first[0], missing)
            if second:
                found = self.known[entry] = (second[0], first[1] + second[1])
        return found


class _Full(Exception):
    """The table has no room for another state."""


class Transducer:
    CHUNK = 256
    #: Bytes of the transition table, and states, beyond which it is compiled anew, in the middle of a text
    #: if need be. Results don't depend on them.
    TABLE, STATES = 128_000_000, 220_000
    #: Characters that are run through the table at once, and the fewest that this comes down to where
    #: ever new ones fill it; twice as many are tried after each time that they fitted.
    GROUP, LEAST = 4_000_000, 2_048

    def __init__(self, model: PieceModel):
        self.model = model
        self.prefixes = {p[:k] for p in model.ids for k in range(1, len(p) + 1)}
        grown = [len(model.run(r)) for r in range(4 * model.longest_piece + 1)]
        steps = [b - a for a, b in zip(grown, grown[1:])]
        self.period = next(p for p in range(1, len(steps)) if steps[p:] == steps[:-p])
        self.group = self.GROUP
        self._forget()

    def _forget(self) -> None:
        """Begins with no characters and no states."""
        self.chars: list[str] = []
        self.class_of = np.full(0x110000, -1, np.int32)
        self._begin(96)

    def _begin(self, width: int) -> None:
        self.width = width
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((max(64, min(1024, self.TABLE // (4 * width))), width), -1, np.int32)
        self._state(("dead",))
        self._state(("", ((0, -1, 0),)))

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = len(self.states)
            rows = len(self.table) if found < len(self.table) else found + found // 4
            if (4 * rows * self.width > self.TABLE or found >= self.STATES) and found > 1 and self.group > self.LEAST:
                raise _Full
            if rows > len(self.table):
                self.table = np.concatenate([self.table, np.full((rows - found, self.width), -1, np.int32)])
            self.ids[key] = found
            self.states.append(key)
        return found

    # Transitions

    def _marks(self, r: int) -> tuple[tuple, int]:
        """The state after r word marks in a row, and the tokens that the last of them emits."""
        if r > 2 * self.period:
            r = self.period + (r - self.period - 1) % self.period + 1
        now, before = len(self.model.run(r)), len(self.model.run(r - 1))
        return ("marks", r, (MARK, ((1, -1, before - now), (0, self.model.ids[MARK], 0)))), now - before

    def _on_char(self, chain: tuple, c: str) -> tuple[tuple, int]:
        stem, places = chain
        model, ids = self.model, self.model.ids
        kept, found = [], None
        for size, last, delta in places:
            text = stem[len(stem) - size :] + c
            piece = ids.get(text)
            if piece is not None and found is None and (model.alone(piece) if last < 0 else model.compatible(last, piece)):
                found = (piece, delta + 1)
            if text in self.prefixes:
                kept.append((size + 1, last, delta))
        piece, emitted = found
        longest = kept[0][0] if kept else 0
        text = stem + c
        return (text[len(text) - longest :], (*[(s, last, d - emitted) for s, last, d in kept], (0, piece, 0))), emitted

    def _compile(self, state: int, kind: int) -> int:
        key = self.states[state]
        if kind == FIRST_MARK:
            to, emitted = self._marks(1)
        elif kind < KNOWN and kind != NEXT_MARK:
            to, emitted = self.states[START], kind - UNKNOWN + 1
        elif state == DEAD:
            to, emitted = key, 0
        elif kind == NEXT_MARK:
            to, emitted = self._marks(key[1] + 1) if key[0] == "marks" else self._marks(1)
        else:
            to, emitted = self._on_char(key[2] if key[0] == "marks" else key, self.chars[kind - KNOWN])
        value = self._state(to) << 8 | emitted + 128
        self.table[state, kind] = value
        return value

    # Runs

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.class_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]):
                c = chr(code)
                if c in self.model.chars:
                    self.class_of[code] = KNOWN + len(self.chars)
                    self.chars.append(c)
                else:
                    self.class_of[code] = UNKNOWN + len(c.encode()) - 1
            out = self.class_of[codes]
            if KNOWN + len(self.chars) > self.width:
                self._begin(-(-5 * (KNOWN + len(self.chars)) // 64) * 16)
        return out

    def _step(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        values = self.table.ravel().take(states * self.width + kinds)
        missing = np.flatnonzero(values < 0)
        if len(missing):
            pairs, back = np.unique(states[missing].astype(np.int64) << 32 | kinds[missing], return_inverse=True)
            made = []
            for p in pairs.tolist():
                value = int(self.table[p >> 32, p & 0xFFFFFFFF])
                made.append(value if value >= 0 else self._compile(p >> 32, p & 0xFFFFFFFF))
            values[missing] = np.array(made, np.int32)[back]
        return values

    def _run(self, kinds: np.ndarray, at: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exits and emitted tokens of the stretches kinds[at : at + length], side by side from states."""
        order = np.argsort(-lengths, kind="stable")
        at, states, total = at[order], states[order], np.zeros(len(order), np.int64)
        live = len(order) - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), "right")
        for t, m in enumerate(live.tolist()):
            values = self._step(states[:m], kinds[at[:m] + t])
            states[:m] = values >> 8
            total[:m] += (values & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return states[back], total[back]

    def _scan(self, stretches: list[list[int]], kinds: np.ndarray, at: np.ndarray, lengths: np.ndarray, entries: list[int]) -> list[tuple[int, int]]:
        """(exit, emitted tokens) of each stretch of whole chunks from its entry."""
        inner = np.array([c for s in stretches for c in s[1:]], np.int64)
        warm = np.minimum(WARM, lengths[inner - 1])
        guesses = self._run(kinds, at[inner] - warm, warm, np.full(len(inner), START, np.int32))[0].tolist()
        given = iter(guesses)
        levels = [[StateMap(chunk=c) for c in s] for s in stretches]
        first = [(m, e if k == 0 else next(given)) for maps, e in zip(levels, entries) for k, m in enumerate(maps)]
        self._extend(first, kinds, at, lengths)
        while any(len(maps) > 1 for maps in levels):
            levels = [[StateMap(pair=(a, b)) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1 :] for maps in levels]
            self._extend([(m, e) for maps in levels for m in maps if m.pair for e in list(m.pair[0].known)], kinds, at, lengths)
        return [maps[0].known[e] for maps, e in zip(levels, entries)]

    def _extend(self, asked: list[tuple[StateMap, int]], kinds: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
        """Adds entries to maps; the chunks that this takes run side by side, in as few turns as can be."""
        while asked:
            missing: dict[tuple[int, int], StateMap] = {}
            asked = [(m, e) for m, e in asked if m.get(e, missing) is None]
            if missing:
                chunks = np.array([c for c, _ in missing], np.int64)
                exits, counts = self._run(kinds, at[chunks], lengths[chunks], np.array([e for _, e in missing], np.int32))
                for (key, m), found in zip(missing.items(), zip(exits.tolist(), counts.tolist())):
                    m.known[key[1]] = found

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none.

        Texts go through the table in groups. A group that fills it is cut in half and begun anew on an
        empty one; a text that is cut goes on from the state it was left in."""
        counts = [0] * len(texts)
        todo = [(k, " " + t.replace(MARK, " ")) for k, t in enumerate(texts) if t][::-1]
        cut: tuple[tuple, bool] | None = None  # state of the first text's rest, and whether a space is before it
        while todo:
            own: list[tuple[int, str]] = []
            left = self.group
            while todo and left:
                k, stream = todo.pop()
                own.append((k, stream[:left]))
                if len(stream) > left:
                    todo.append((k, stream[left:]))
                left -= len(own[-1][1])
            rest = bool(todo) and todo[-1][0] == own[-1][0]
            try:
                totals, state = self._grouped([part for _, part in own], cut)
            except _Full:
                if rest:
                    k, stream = todo.pop()
                    own[-1] = (k, own[-1][1] + stream)
                todo += own[::-1]
                self.group = max(self.LEAST, min(self.group, sum(len(part) for _, part in own)) // 2)
                self._forget()
                continue
            for (k, _), n in zip(own, totals):
                counts[k] += n
            cut = (state, own[-1][1][-1] == " ") if rest else None
            self.group = min(self.GROUP, 2 * self.group)
        return counts

    def _grouped(self, parts: list[str], cut: tuple[tuple, bool] | None) -> tuple[list[int], tuple]:
        """Tokens that each part emits, and the state after the last one. The first part goes on from `cut`
        if that is given; all others begin texts."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(part) for part in parts])
        begins = np.cumsum(sizes) - sizes
        space = codes == 32
        after = np.concatenate([[False], space[:-1]])
        after[begins] = False
        after[0] = bool(cut and cut[1])
        kinds = self.classes(codes)
        kinds = np.where(space, np.where(after, NEXT_MARK, FIRST_MARK), kinds)

        many = -(-sizes // self.CHUNK)
        text = np.repeat(np.arange(len(parts)), many)
        place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = begins[text] + place * self.CHUNK
        lengths = np.minimum(self.CHUNK, begins[text] + sizes[text] - at)
        resets = np.append(np.flatnonzero((kinds < KNOWN) & (kinds != NEXT_MARK)), len(kinds))
        heads = np.minimum(resets[np.searchsorted(resets, at)] - at, lengths)
        # From the first place that any state leads to the same one from, the entry doesn't matter.
        exits, total = self._run(kinds, at + heads, lengths - heads, np.full(len(at), DEAD, np.int32))
        whole = heads == lengths
        entries = np.append(self._state(cut[0]) if cut else START, exits[:-1]).astype(np.int32)
        last = int(exits[-1])
        if whole.any():
            begin = whole & ~np.append(False, whole[:-1])
            number = np.cumsum(begin)
            stretches = [s.tolist() for s in np.split(np.flatnonzero(whole), np.flatnonzero(np.diff(number[whole])) + 1)]
            found = self._scan(stretches, kinds, at, lengths, [int(entries[s[0]]) for s in stretches])
            for s, (out, n) in zip(stretches, found):
                total[s[-1]] += n
                if s[-1] + 1 < len(entries):
                    entries[s[-1] + 1] = out
                else:
                    last = out
        rest = np.flatnonzero(~whole & (heads > 0))
        total[rest] += self._run(kinds, at[rest], heads[rest], entries[rest])[1]
        return np.bincount(text, total, len(parts)).astype(np.int64).tolist(), self.states[last]


@lru_cache(maxsize=2)
def compiled(blob: bytes) -> Transducer:
    return Transducer(load_model(blob))


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, without begin and end ids.

    Null is as empty: no bytes, no tokens, not over the limit. Repeated rows stay rows; an empty table
    gives an empty table; columns but the two named are not read. The model file is read on the
    driver and broadcast.
    """
    blob = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def work(slices) -> Iterator[dict]:
        machine = compiled(blob.value)
        for _, texts in slices:
            counts = machine.counts(texts)
            yield {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

    return map_texts(df, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", work)
