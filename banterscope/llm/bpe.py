"""Byte-pair encoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is right exactly if every token encodes to
itself and every adjacent pair would be left apart by the merges; both are checked for all pairs of a block
at once (numpy). Only words that fail are merged step by step.

The vocabulary file is a parameter: a public ``tokenizers`` JSON file of kind BPE with word ends, NFC, lower
case and white space removed. It must be readable at the same path on every executor.

Null texts count as empty and have no tokens. Equal rows give equal rows. Texts are encoded whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from banterscope.llm.blocks import kept, text_blocks

# White space and word pattern as the vocabulary's own settings define them.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+"
_END = "</w>"

_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")

# Chunks remembered by one worker, in two generations. A memory bound only: a forgotten chunk is encoded again.
REMEMBERED_CHUNKS = 1 << 17


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """A vocabulary, its merges as arrays, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.size = 1 + max(*self.vocab.values(), *self.special.values())
        self.strings = [""] * self.size
        for text, i in {**self.vocab, **self.special}.items():
            self.strings[i] = text
        n = len(model["merges"])
        self.none = n  # ranks below are merges
        self.made = np.full(self.size, -1, np.int64)  # the rank at which a token is made; -1: never
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        keys, ranks = np.empty(n, np.int64), np.arange(n)
        self.results = np.empty(n, np.int64)
        for at, (a, b) in enumerate(model["merges"]):
            x, y = self.vocab[a], self.vocab[b]
            out = self.vocab[a + b]
            keys[at], self.results[at] = x * self.size + y, out
            if self.made[out] < 0:
                self.made[out], self.left[out], self.right[out] = at, x, y
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks[order]
        # A token stands for itself if its halves do and nothing merges across them before they meet.
        made = np.flatnonzero(self.made >= 0)
        apart = self.apart(self.left[made], self.right[made], self.made[made])
        self.itself = np.ones(self.size, bool)
        good = dict(zip(made.tolist(), apart.tolist(), strict=True))
        for t in made[np.argsort(self.made[made])].tolist():
            self.itself[t] = good[t] and self.itself[self.left[t]] and self.itself[self.right[t]]
        self._grow_tree()
        self.words = regex.compile(_WORDS)
        self.white = regex.compile(f"[{_WHITE}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    def _meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank at which two tokens merge; beyond all ranks if they don't."""
        want = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges that make ``x`` and ``y`` never merge across their border first.

        Walks back in time: the later made of the two is split at the border again and again. What stands on
        both sides must not merge before the step that ended it; at equal rank the left one goes first.
        """
        x, y = x.copy(), y.copy()
        until = np.full(len(x), self.none) if limit is None else limit.copy()
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            clash = self._meet(a, b) < until[live]
            good[live[clash]] = False
            left, right = self.made[a], self.made[b]
            on = ~clash & ((left >= 0) | (right >= 0))
            undo_left = left > right
            # Where the right token is undone, a meeting of equal rank to its left would have gone first.
            until[live] = np.where(undo_left, left, right + 1)
            x[live], y[live] = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            live = live[on]
        return good

    def _grow_tree(self) -> None:
        """The vocabulary as a prefix tree: sorted keys of node and symbol, the node each leads to, its token.

        A symbol is a byte, plus 256 where the word ends.
        """
        byte = {c: b for b, c in enumerate(_byte_letters())}
        steps: dict[int, int] = {}
        ends = {0: -1}
        for text, token in self.vocab.items():
            body = text.removesuffix(_END)
            symbols = [byte[c] for c in body]
            symbols[-1] += 256 * (body != text)
            node = 0
            for s in symbols:
                node = steps.setdefault(node * 512 + s, len(steps) + 1)
            ends[node] = token
        keys = np.fromiter(steps, np.int64)
        nodes = np.fromiter(steps.values(), np.int64)
        order = np.argsort(keys)
        self.tree_keys, self.tree_nodes = keys[order], nodes[order]
        self.node_token = np.full(len(steps) + 1, -1, np.int64)
        self.node_token[list(ends)] = list(ends.values())
        first = self._step(np.zeros(512, np.int64), np.arange(512))
        if (first < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.symbol_token = self.node_token[first]

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        want = node * 512 + symbol
        at = np.minimum(np.searchsorted(self.tree_keys, want), len(self.tree_keys) - 1)
        return np.where(self.tree_keys[at] == want, self.tree_nodes[at], -1)

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: tokens and the word of each."""
        word, at = np.arange(len(starts)), starts.copy()
        ends, node = ends.copy(), np.zeros(len(starts), np.int64)
        best, best_at = np.full(len(starts), -1), starts.copy()
        tokens, words = [], []
        while len(word):
            inside = at < ends
            child = np.where(inside, self._step(node, symbols[np.where(inside, at, 0)]), -1)
            on = child >= 0
            node, at = np.where(on, child, 0), at + on
            token = np.where(on, self.node_token[child], -1)
            hit = token >= 0
            best, best_at = np.where(hit, token, best), np.where(hit, at, best_at)
            stop = ~on
            tokens.append(best[stop])
            words.append(word[stop])
            at = np.where(stop, best_at, at)
            live = at < ends
            live |= on  # a longer token may still be under way at the word's end
            word, at, ends, node, best, best_at = (x[live] for x in (word, at, ends, node, best, best_at))
        flat, owner = np.concatenate(tokens), np.concatenate(words)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def merge(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """The merges one by one, lowest rank first and leftmost among equals, in words of like length at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(np.ceil(np.log2(sizes))):
            group = np.flatnonzero(np.ceil(np.log2(sizes)) == size)
            wide = int(2**size)
            rows = max(1, (1 << 20) // wide)
            for part in (group[i : i + rows] for i in range(0, len(group), rows)):
                tokens = np.full((len(part), wide), -1, np.int64)
                for row, w in enumerate(part):
                    tokens[row, : sizes[w]] = self.symbol_token[words[w]]
                self._merge_rows(tokens)
                for row, w in enumerate(part):
                    out[w] = tokens[row][tokens[row] >= 0]
        return out

    def _merge_rows(self, tokens: np.ndarray) -> None:
        """One merge in every row at a time; a merged neighbour is left as -1."""
        n, wide = tokens.shape
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        ends = (tokens >= 0).sum(1)
        ranks = np.full((n, wide), self.none)
        real = tokens[:, 1:] >= 0
        ranks[:, :-1][real] = self._meet(tokens[:, :-1][real], tokens[:, 1:][real])
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(1)
            rank = ranks[live, at]
            on = rank < self.none
            live, at, rank = live[on], at[on], rank[on]
            gone = after[live, at]
            tokens[live, at], tokens[live, gone] = self.results[rank], -1
            ranks[live, gone] = self.none
            then = after[live, gone]
            after[live, at] = then
            ranks[live, at] = self.none
            more = then < ends[live]
            r, i, j = live[more], at[more], then[more]
            before[r, j] = i
            ranks[r, i] = self._meet(tokens[r, i], tokens[r, j])
            j = before[live, at]
            r, i, j = live[j >= 0], at[j >= 0], j[j >= 0]
            ranks[r, j] = self._meet(tokens[r, j], tokens[r, i])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Distinct words: proposals, one check over all adjacent pairs, exact merges for the rest."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(w) for w in raw])
        starts = np.concatenate([[0], ends[:-1]])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        flat, word = self.propose(symbols, starts, ends)
        fails = np.zeros(len(words), bool)
        fails[word[~self.itself[flat]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        fails[word[inside[~self.apart(flat[inside], flat[inside + 1])]]] = True
        lasts = 4 * np.searchsorted(word, np.arange(len(words) + 1))
        held, cuts = flat.astype(np.int32).tobytes(), lasts.tolist()
        tokens = [held[a:b] for a, b in zip(cuts, cuts[1:])]
        failing = np.flatnonzero(fails).tolist()
        for at, ids in zip(failing, self.merge([symbols[starts[w] : ends[w]] for w in failing]), strict=True):
            tokens[at] = ids.astype(np.int32).tobytes()
        return tokens

    def _chunks(self, text: str) -> list[str | int]:
        """What stands between white space, and the numbers of marks that stand in a text literally.

        No word reaches over white space, so that each chunk is encoded by itself.
        """
        out: list[str | int] = []
        for part in self.marks.split(text) if self.marks and "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()
            # str.split also splits at four control characters that are not white space here.
            out += part.split() if _CONTROLS.isdisjoint(part) else self.white.split(part)
        return out

    def _learn(self, chunks: list[str]) -> None:
        words = [self.words.findall(c) for c in chunks]
        new = list({w for ws in words for w in ws})
        ids = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        for chunk, ws in zip(chunks, words, strict=True):
            self.known[chunk] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Token ids of each text as bytes of 32-bit numbers."""
        split = [self._chunks(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > REMEMBERED_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = used.difference(known)
        for chunk in new.intersection(older):
            known[chunk] = older[chunk]
        self._learn([c for c in new.difference(older) if c.__class__ is str])
        for i in self.special.values():
            known[i] = np.int32(i).tobytes()
        get = known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings joined by one space, as a vocabulary without a decoder gives them."""
        offsets = ids.offsets
        strings = kept(("strings", id(self)), lambda: pa.array(self.strings)).take(ids.values)
        return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def loaded(path: str) -> Bpe:
    return kept(("bpe", path), lambda: Bpe(path))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key, ids array<int>`` for every row of ``docs``; with ``decoded`` also the ids decoded again.

    No shuffle: every partition is encoded where it is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for rows, texts in text_blocks(batch, text):
                ids = _lists(bpe.encode(t.decode("utf-8", "replace") for t in texts))
                columns = [rows.column(key), ids] + ([bpe.decode(ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded string`` of token ids; null and empty lists give the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            lists = batch.column(ids)
            lists = _lists([np.asarray(x or [], np.int32).tobytes() for x in lists.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key), bpe.decode(lists)], [key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded string")
