"""Encoding of texts into the pieces of a merge-type vocabulary, by backtracking.

Merging starts from single characters and joins the two neighbours whose union is the best piece, the left one
among equals, until no union is a piece. Whatever the scores are, a row of pieces is that result exactly if each
piece stands for itself and each two neighbours, merged anew from their characters, come out apart. So no
merging of whole texts is needed:

1. An Aho-Corasick automaton over the pieces that stand for themselves, spelt from right to left, finds the
   longest match at every position of all new chunks of a block, in many stretches of them at once.
2. Every chunk takes the longest match if it stays apart from the piece before. That is found by re-merging the
   characters of the two, for all chunks at once and every distinct pair once.
3. Otherwise the next shorter piece is tried, and where none is left the piece before is given back. A bit marks
   each position that can't be continued, so that it is never tried again: what comes before a position is the
   same whenever it is reached.

Chunks start at white space, which no piece holds behind another character, or at line ends, which no piece holds.
Characters that no piece holds become the pieces of their UTF-8 bytes; nothing merges with them.

The vocabulary is a parameter: a public ``sentencepiece`` model of kind BPE with byte fallback, a space before the
text, and no other change of it. It must be readable at the same path on every executor.

Cases: null texts count as empty and have no ids; bytes that are no UTF-8 count as U+FFFD. Equal rows give equal
rows. Texts are encoded whole. Null keys, repeated keys and extra columns are allowed. An empty table gives an
empty table. Decoding takes null and empty lists as the empty text, and null ids as absent.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from banterscope.llm.blocks import kept, mix, text_blocks

_SPACE = "▁"
# What a model's numbers for kinds of pieces mean.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2

# Chunks remembered by one worker, in two generations, and pairs known to stay apart or not. A memory bound
# only: what is forgotten is worked out again.
REMEMBERED_CHUNKS = 1 << 17
REMEMBERED_PAIRS = 1 << 20
# So few chunks are stepped through one by one; same pieces either way.
FEW_CHUNKS = 32
# Characters that the automaton reads in one stretch, besides those that a piece may reach over its end.
STRETCH = 128


class Numbers:
    """Values by keys of 64 bits that aren't negative, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (8 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1), np.full(size, -1)
        spots, left = self._spots(keys), np.arange(len(keys))
        while len(left):  # the first to come has the place, the others take the next one
            free = left[self.keys[spots[left]] < 0]
            own = free[np.unique(spots[free], return_index=True)[1]]
            self.keys[spots[own]], self.values[spots[own]] = keys[own], values[own]
            left = np.setdiff1d(left, own, assume_unique=True)
            spots[left] = (spots[left] + 1) & (size - 1)

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.int64).view(np.uint64)) & self.mask).astype(np.int64)

    def get(self, want: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that are absent."""
        spots = self._spots(want)
        there = self.keys[spots]
        out = np.where(there == want, self.values[spots], -1)
        rest = np.flatnonzero((there != want) & (there >= 0))
        while len(rest):
            spots[rest] = (spots[rest] + 1) & int(self.mask)
            there = self.keys[spots[rest]]
            hit = there == want[rest]
            out[rest[hit]] = self.values[spots[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class Pieces:
    """A vocabulary, its unions of pieces as arrays, and what has been encoded so far."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix and rules.escape_whitespaces
        if model.trainer_spec.model_type != _BPE or not model.trainer_spec.byte_fallback or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with byte fallback and plain white space is needed")
        kinds = np.array([p.type for p in model.pieces])
        if not np.isin(kinds, (_NORMAL, _UNKNOWN, _CONTROL, _BYTE)).all():
            raise ValueError("pieces of users and unused pieces are not supported")
        self.strings = [p.piece for p in model.pieces]
        self.size = len(self.strings)
        self.ids = {self.strings[i]: i for i in np.flatnonzero(kinds == _NORMAL).tolist()}
        self.lengths = np.array([len(s) for s in self.strings])
        alphabet = set("".join(self.ids))
        if not alphabet <= self.ids.keys():
            raise ValueError("a character of a piece is no piece")
        # The best score first; equal scores are one rank.
        scores = np.array([p.score for p in model.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1]
        self.ranks = self.rank.tolist()
        self.none = self.size
        joins = [(self.ids[s[:k]], self.ids[s[k:]], i) for s, i in self.ids.items() for k in range(1, len(s)) if s[:k] in self.ids and s[k:] in self.ids]
        left, right, out = np.array(joins, np.int64).reshape(-1, 3).T
        self.unions = Numbers(left * self.size + right, out)
        self._spell()
        self.itself = np.ones(self.size, bool)
        own = np.array(sorted(self.ids.values()))
        for part in np.array_split(own, 1 + len(own) // 8192):
            self.itself[part] = self._merged(self.letters[part])[1] == 1
        usable = [(s, i) for s, i in self.ids.items() if self.itself[i]]
        self._grow(alphabet, usable)
        known = dict(usable)
        # One entry more stands for a character that no piece holds; -1, for no piece, reads it too.
        self.shorter = np.full(self.size + 1, -1)
        for s, i in usable:
            self.shorter[i] = next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1)
        self.lengths = np.append(self.lengths, 1)
        self.length_list, self.shorter_list = self.lengths.tolist(), self.shorter.tolist()
        self._cut(alphabet)
        self._surfaces(kinds)
        self.pair_code = np.full(REMEMBERED_PAIRS, -1)
        self.pair_good = np.zeros(REMEMBERED_PAIRS, bool)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _grow(self, alphabet: set[str], usable: list[tuple[str, int]]) -> None:
        """The automaton over the pieces from right to left: where a state and a letter lead, where a state falls
        back to, and the longest piece that a state has read."""
        number = {c: k for k, c in enumerate(sorted(alphabet))}
        self.letter = np.full(0x110000, -1)
        self.letter[[ord(c) for c in number]] = list(number.values())
        steps: list[dict[int, int]] = [{}]
        ends = [self.size]
        for s, i in usable:
            state = 0
            for c in reversed(s):
                if (then := steps[state].get(number[c])) is None:
                    then = steps[state][number[c]] = len(steps)
                    steps.append({})
                    ends.append(-1)
                state = then
            ends[state] = i
        falls, queue = [0] * len(steps), [0]
        for state in queue:  # the queue grows meanwhile
            for letter, then in steps[state].items():
                back = falls[state]
                while back and letter not in steps[back]:
                    back = falls[back]
                falls[then] = steps[back].get(letter, 0) if state else 0
                ends[then] = ends[falls[then]] if ends[then] < 0 else ends[then]
                queue.append(then)
        self.letters_known = len(number)
        told = [(state * len(number) + letter, then) for state, row in enumerate(steps) for letter, then in row.items()]
        self.steps = Numbers(*np.array(told, np.int64).reshape(-1, 2).T)
        self.falls, self.ends = np.array(falls), np.array(ends)

    def _spell(self) -> None:
        """Every piece as the row of the pieces of its characters, filled up with -1."""
        self.wide = max(map(len, self.ids), default=1)
        self.letters = np.full((self.size, self.wide), -1, np.int64)
        for s, i in self.ids.items():
            self.letters[i, : len(s)] = [self.ids[c] for c in s]

    def _cut(self, alphabet: set[str]) -> None:
        """Where chunks start. ``apart`` is a character that no piece holds."""
        self.apart = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in alphabet)
        if any(_SPACE in s.lstrip(_SPACE) for s in self.ids):
            self.chunks = re.compile(".+", re.DOTALL)
        elif "\n" in alphabet:
            self.chunks = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        else:
            self.chunks = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n+[^{_SPACE}\n]*")

    def _surfaces(self, kinds: np.ndarray) -> None:
        """What each id stands for when decoded, as bytes; the ids of the 256 bytes."""
        surface = [s.replace(_SPACE, " ").encode("utf-8") for s in self.strings]
        self.spaced = np.array([s.startswith(_SPACE) for s in self.strings]) & (kinds == _NORMAL)
        self.byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds != _NORMAL).tolist():
            if kinds[i] == _BYTE:
                value = int(self.strings[i][3:-1], 16)
                self.byte[value], surface[i] = i, bytes([value])
            else:
                surface[i] = " ⁇ ".encode() if kinds[i] == _UNKNOWN else b""
        self.surface = pa.array(surface, pa.binary())
        self.visible = np.array([len(x) > 0 for x in surface])

    def _union(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece that two pieces make together; -1 if none."""
        out = np.full(x.shape, -1)
        real = (x >= 0) & (y >= 0)
        out[real] = self.unions.get(x[real] * self.size + y[real])
        return out

    def _merged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters of each row merged to the end: the rows, and how many pieces each has.

        One merge in every row at a time: the union of the best rank, the leftmost among equals.
        """
        rows = rows.copy()
        live = np.arange(len(rows))
        while len(live):
            own = rows[live]
            made = self._union(own[:, :-1], own[:, 1:])
            rank = np.where(made >= 0, self.rank[made], self.none)
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(own), np.int64)
            on = rank[np.arange(len(own)), at] < self.none if rank.shape[1] else np.zeros(len(own), bool)
            live, own, at = live[on], own[on], at[on]
            here = np.arange(len(own))
            own[here, at] = made[on][here, at]
            # What stands behind the merged pair moves up by one.
            beyond = np.arange(own.shape[1])[None, :] > at[:, None]
            moved = np.concatenate([own[:, 1:], np.full((len(own), 1), -1)], 1)
            rows[live] = np.where(beyond, moved, own)
        return rows, (rows >= 0).sum(1)

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces come out as they are if their characters are merged together."""
        codes = left * self.size + right
        spots = (mix(codes.view(np.uint64)) & np.uint64(REMEMBERED_PAIRS - 1)).astype(np.int64)
        good = self.pair_good[spots]
        new = np.flatnonzero(self.pair_code[spots] != codes)
        if len(new):
            own, places = np.unique(codes[new], return_inverse=True)
            told = np.concatenate([self._remerged(part // self.size, part % self.size) for part in np.array_split(own, 1 + len(own) // 8192)])
            good[new] = told[places]
            self.pair_code[spots[new]], self.pair_good[spots[new]] = codes[new], good[new]
        return good

    def _remerged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Re-merges the characters of each pair, many pairs at a time."""
        rows = np.full((len(a), self.wide * 2), -1, np.int64)
        rows[:, : self.wide] = self.letters[a]
        spots = self.lengths[a][:, None] + np.arange(self.wide)[None, :]
        inside = self.letters[b] >= 0
        rows[np.nonzero(inside)[0], spots[inside]] = self.letters[b][inside]
        merged, count = self._merged(rows[:, : int((self.lengths[a] + self.lengths[b]).max(initial=2))])
        return (count == 2) & (merged[:, 0] == a) & (merged[:, 1] == b)

    def _longest(self, points: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each position; ``size`` where no piece holds the character."""
        over = self.wide - 1
        rows = -(-len(points) // STRETCH)
        letters = np.full(rows * STRETCH + over, -1)
        letters[: len(points)] = self.letter[points]
        spread = np.lib.stride_tricks.as_strided(letters, (rows, STRETCH + over), (STRETCH * letters.itemsize, letters.itemsize))
        longest = np.empty((STRETCH, rows), np.int64)
        state = np.zeros(rows, np.int64)
        for column in range(STRETCH + over - 1, -1, -1):
            letter = spread[:, column]
            live = np.flatnonzero(letter >= 0)
            at, then = state[live], np.zeros(rows, np.int64)
            while len(live):
                found = self.steps.get(at * self.letters_known + letter[live])
                on = found >= 0
                then[live[on]] = found[on]
                live, at = live[~on & (at > 0)], self.falls[at[~on & (at > 0)]]
            state = then
            if column < STRETCH:
                longest[column] = self.ends[state]
        return longest.T.reshape(-1)[: len(points)]

    def backtrack(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, where each starts in the joined chunks, and the first piece of each chunk (and the total).

        All chunks take a step at a time: a piece is taken, or a shorter one is tried, or the position is marked
        and the piece before it is given back. The piece at the end of a chunk is its border.
        """
        joined = self.apart.join(chunks) + self.apart
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        longest = self._longest(points)
        stops = np.cumsum([len(c) + 1 for c in chunks]) - 1
        at = np.concatenate([[0], stops[:-1] + 1])
        failed = np.zeros(len(points) + 1, bool)
        taken, before = np.full(len(points), -1), np.full(len(points) + 1, -1)
        piece = longest[at]
        while len(at) > FEW_CHUNKS:
            left, none = before[at], piece < 0
            end = at + self.lengths[piece]
            good = ~none & ~failed[end]
            known = np.flatnonzero(good & (left >= 0) & (piece < self.size))
            known = known[taken[left[known]] < self.size]
            good[known] = self.stay_apart(taken[left[known]], piece[known])
            # A piece is taken.
            taken[at[good]], before[end[good]] = piece[good], at[good]
            # A position can't be continued: the piece before it goes.
            failed[at[none]] = True
            back = left[none]
            piece = np.where(good, longest[np.minimum(end, len(points) - 1)], self.shorter[piece])
            piece[none] = self.shorter[taken[back]]
            taken[back] = -1
            at = np.where(good, end, at)
            at[none] = back
            live = at < stops
            at, piece, stops = at[live], piece[live], stops[live]
        for start, stop, first in zip(at.tolist(), stops.tolist(), piece.tolist()):
            self._finish(start, stop, first, longest, failed, taken, before)
        starts = np.flatnonzero(taken >= 0)
        return taken[starts], points[starts], np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(c) + 1 for c in chunks])]))

    def _finish(self, at: int, stop: int, piece: int, longest: np.ndarray, failed: np.ndarray, taken: np.ndarray, before: np.ndarray) -> None:
        """The same steps for one chunk, to its end."""
        size, lengths, shorter = self.size, self.length_list, self.shorter_list
        last = int(taken[before[at]]) if before[at] >= 0 else -1
        while at < stop:
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end] and (last < 0 or last == size or piece == size or self._stays(last, piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                taken[at], before[end] = piece, at
                at, last, piece = end, piece, int(longest[end]) if end < stop else -1
            else:
                failed[at] = True
                at = int(before[at])
                piece, taken[at] = shorter[taken[at]], -1
                last = int(taken[before[at]]) if before[at] >= 0 else -1

    def _stays(self, left: int, right: int) -> bool:
        """``stay_apart`` of one pair, re-merged piece by piece."""
        code = left * self.size + right
        good = self.pairs.get(code)
        if good is None:
            ids, rank, none = self.ids, self.ranks, self.none
            parts = list(self.strings[left] + self.strings[right])
            while True:
                made = [ids.get(x + y, -1) for x, y in zip(parts, parts[1:])]
                best, at = min(((rank[m], k) for k, m in enumerate(made) if m >= 0), default=(none, 0))
                if best == none:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs = {}
            good = self.pairs[code] = parts == [self.strings[left], self.strings[right]]
        return good

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks and remembers their ids."""
        pieces, points, firsts = self.backtrack(chunks)
        # The ids of what no piece holds are those of its bytes.
        lone = np.flatnonzero(pieces == self.size)
        raw = [chr(c).encode("utf-8") for c in points[lone].tolist()]
        counts = np.ones(len(pieces), np.int64)
        counts[lone] = [len(r) for r in raw]
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        ids = np.repeat(pieces, counts).astype(np.int32)
        ids[np.repeat(pieces == self.size, counts)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        flat, cuts = ids.tobytes(), (4 * ends[firsts]).tolist()
        self.known.update(zip(chunks, (flat[a:b] for a, b in zip(cuts, cuts[1:])), strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit numbers."""
        split = [self.chunks.findall(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        used: set[str] = set().union(*split)
        if len(self.known) > REMEMBERED_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = used.difference(known)
        for chunk in new.intersection(older):
            known[chunk] = older[chunk]
        if fresh := list(new.difference(older)):
            self._learn(fresh)
        get = known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text that each list of ids stands for, without the space that was put before it."""
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype(np.int64), ids.offsets.to_numpy()
        if ((values < 0) | (values >= self.size)).any():
            raise ValueError("an id is not in the vocabulary")
        surfaces = pa.ListArray.from_arrays(ids.offsets, self.surface.take(pa.array(values)))
        # What each list shows first decides whether a space goes.
        shows = np.flatnonzero(self.visible[values])
        first = np.searchsorted(shows, offsets[:-1])
        first = np.where(first < len(shows), shows[np.minimum(first, len(shows) - 1)], len(values)) if len(shows) else np.full(len(offsets) - 1, len(values))
        cut = np.zeros(len(first), np.int64)
        some = first < offsets[1:]
        cut[some] = self.spaced[values[first[some]]]
        return [_decoded(raw[k:]) for raw, k in zip(pc.binary_join(surfaces, b"").to_pylist(), cut.tolist(), strict=True)]


def _decoded(raw: bytes) -> str:
    """UTF-8 text in which every byte that belongs to no character becomes one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape"))


def loaded(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key, ids array<int>`` for every row of ``docs``; with ``decoded`` also the text the ids stand for.

    No shuffle: every partition is encoded where it is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(vocabulary)
        for batch in batches:
            for rows, texts in text_blocks(batch, text):
                ids = pieces.encode(t.decode("utf-8", "replace") for t in texts)
                columns = [rows.column(key), _lists(ids)]
                if decoded:
                    columns.append(pa.array(pieces.decode(columns[1]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded string`` of lists of ids."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(vocabulary)
        for batch in batches:
            lists = _lists([np.array([i for i in x or [] if i is not None], np.int32).tobytes() for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(pieces.decode(lists), pa.string())], [key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded string")
