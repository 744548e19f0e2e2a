"""Byte-level BPE by speculation: propose tokens greedily, verify, and merge only what fails.

A BPE encoding is right exactly when every token encodes to itself and no
adjacent pair of tokens would have merged across its border. So each new word
gets the longest vocabulary entry at every place as a proposal, all adjacent
pairs of all new words are tested at once with array operations, and only words
with a failing pair are merged step by step.

Merges happen in the order of their rank, at equal rank from left to right.
For a pair (a, b) the only symbols that can meet at the border are those on
the right spine of a's merge tree and on the left spine of b's. The test walks
both spines from the tokens down, undoing the later merge first. A border merge
spoils the pair if its time lies before the next merge on either side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from runlens.llm.session import give_back, portions

#: Fixed value: how a byte-level pre-tokenizer splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of parts of texts a worker remembers; longer parts than the second are forgotten at
#: once. Both bound memory, not the result.
REMEMBERED_BYTES = 64 << 20
REMEMBERED_LENGTH = 64
#: What a remembered part costs besides its characters.
_ENTRY_BYTES = 200
#: Characters of text, and bytes of words, that arrays are made for at once.
GROUP_CHARS = 2 << 20
GROUP_BYTES = 1 << 20
#: Tokens on either side of a failing border that are merged anew at first.
MEND_RADIUS = 4
#: Stretches longer than this are merged by a heap, one by one.
LONG_STRETCH = 512

_NEVER = np.int64(1) << 40
_NEVER_MERGED = int(_NEVER)
# A space before a visible character always starts a word; splitting there is cheap.
_GAP = re.compile(r" (?=\S)")
_RUN = re.compile(r" \s|\s\Z")


def byte_of_character() -> dict[str, int]:
    """Vocabulary files write each byte as a printable character: printable Latin-1
    bytes as themselves, the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Lookup:
    """Array lookups by integer key: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask, self._missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, missing, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self._keys[slot] < 0
            taken, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[taken >= 0]
            self._keys[slot[first]], self._values[slot[first]] = keys[left[first]], values[left[first]]
            on = np.ones(len(left), bool)
            on[first] = False
            slot, left = (slot[on] + 1) & self._mask, left[on]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, found = self._values[slot], self._keys[slot]
        other = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = self._missing
        while len(other):
            slot[other] = (slot[other] + 1) & self._mask
            found = self._keys[slot[other]]
            same = found == keys[other]
            out[other[same]] = self._values[slot[other[same]]]
            other = other[~same & (found >= 0)]
        return out


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose words do not depend on each other, none much longer than a group if there are spaces in it."""
    at = 0
    while len(text) - at > GROUP_CHARS:
        gap = _GAP.search(text, at + GROUP_CHARS // 2)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class _Runs:
    """Runs of ids, one after the other."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        self.starts = np.cumsum(lengths) - lengths

    def of(self, numbers: np.ndarray) -> _Runs:
        """The runs of these numbers, in this order."""
        lengths = self.lengths[numbers]
        at = np.repeat(self.starts[numbers] - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        return _Runs(self.ids[at], lengths)

    def and_more(self, runs: _Runs) -> _Runs:
        return _Runs(np.append(self.ids, runs.ids), np.append(self.lengths, runs.lengths))


_NO_RUNS = _Runs(np.zeros(0, "<u4"), np.zeros(0, np.int64))


class _Memory(dict):
    """Numbers of parts whose ids are known; a part that is new gets the next one and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, int] = {}
        self.bytes = 0
        self.runs = _NO_RUNS

    def __missing__(self, part: str) -> int:
        return self.new.setdefault(part, len(self) + len(self.new))

    def settle(self, runs: _Runs, counts: np.ndarray, limit: int) -> None:
        """Remember the new parts that are short; where that is more than ``limit`` bytes, only parts that came up more than once.

        ``runs`` are the ids of known and new parts, ``counts`` how often each has just come up.
        """
        known = len(self)
        names = [*self.new]
        self.new = {}
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        kept = np.flatnonzero(sizes <= REMEMBERED_LENGTH)
        cost = int((sizes[kept] + _ENTRY_BYTES).sum())
        if self.bytes + cost > limit:
            kept = kept[counts[known + kept] > 1]
            cost = int((sizes[kept] + _ENTRY_BYTES).sum())
            used = [(name, i) for name, i in self.items() if counts[i] > 1]
            self.clear()
            self.update((name, n) for n, (name, _) in enumerate(used))
            self.runs = self.runs.of(np.array([i for _, i in used], np.int64))
            self.bytes = sum(len(name) + _ENTRY_BYTES for name in self)
        if self.bytes + cost <= limit:
            self.update(zip([names[i] for i in kept.tolist()], range(len(self), len(self) + len(kept))))
            self.runs = self.runs.and_more(runs.of(known + kept))
            self.bytes += cost


class BytePairs:
    """A byte-level vocabulary with its merges, and encoding by speculation."""

    def __init__(self, vocab: dict[str, int], merges: Sequence, added: Sequence[dict] = ()):
        to_byte = byte_of_character()
        ids = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
        size = max([*ids.values(), *(a["id"] for a in added)]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = token
        self.added = {a["content"]: a["id"] for a in added}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self._base = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self._made = np.zeros(len(merges), np.int64)
        pairs = np.zeros(len(merges), np.int64)
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            pairs[rank], self._made[rank] = (i << 32) | j, k
            self.rank[k], self.left[k], self.right[k] = rank, i, j
        self._ranks = _Lookup(pairs, np.arange(len(pairs)), int(_NEVER))
        self._rank_of = dict(zip(pairs.tolist(), range(len(pairs))))

        # Tokens that do not encode to themselves are never proposed.
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], at_top=False)
        for k in made[np.argsort(self.rank[made])]:
            sound[k] &= sound[self.left[k]] and sound[self.right[k]]
        self._grow_trie({token: i for token, i in ids.items() if sound[i]})

        self._sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self._words = regex.compile(WORDS)
        self._memory = _Memory()

    @classmethod
    def load(cls, path: str) -> BytePairs:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        return cls(model["model"]["vocab"], model["model"]["merges"], model.get("added_tokens", ()))

    # -- verification ------------------------------------------------------

    def _pair_rank(self, a: int, b: int) -> int:
        return self._rank_of.get(a << 32 | b, _NEVER_MERGED)

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._ranks((a.astype(np.int64) << 32) | b)

    def compatible(self, a: np.ndarray, b: np.ndarray, at_top: bool = True) -> np.ndarray:
        """For each adjacent pair of tokens: would BPE leave the border between them alone?

        ``at_top`` off leaves out the whole tokens themselves, to ask whether
        the two halves of a merge get that far.
        """
        good = np.ones(len(a), bool)
        row = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        before_x, before_y = np.full(len(a), _NEVER - 1), np.full(len(a), _NEVER - 1)
        test = at_top
        while len(row):
            if test:
                rank = self._rank_of_pair(x, y)
                good[row[(rank < before_x) & (rank <= before_y)]] = False
            test = True
            rank_x, rank_y = self.rank[x], self.rank[y]
            undo_x = rank_x > rank_y
            go = good[row] & ((rank_x >= 0) | (rank_y >= 0))
            before_x = np.where(undo_x, rank_x, before_x)[go]
            before_y = np.where(undo_x, before_y, rank_y)[go]
            x, y, row = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go], row[go]
        return good

    # -- encoding ----------------------------------------------------------

    def _grow_trie(self, tokens: dict[bytes, int]) -> None:
        """Nodes are numbered; edges go by (node, byte); a node may end a token."""
        node_of, edges = {b"": 0}, {}
        for token in tokens:
            node = 0
            for end in range(1, len(token) + 1):
                below = node_of.setdefault(token[:end], len(node_of))
                edges[node << 8 | token[end - 1]] = below
                node = below
        self._token_at = np.full(len(node_of), -1, np.int64)
        for token, i in tokens.items():
            self._token_at[node_of[token]] = i
        self._edges = _Lookup(np.array([*edges], np.int64), np.array([*edges.values()], np.int64), -1)

    def _propose(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right, for all words side by side: tokens, and how many a word has."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        text = np.append(np.frombuffer(b"".join(words), np.uint8), 0).astype(np.int64)
        word = np.flatnonzero(np.diff(np.append(0, ends)))
        at, stop = np.append(0, ends[:-1])[word], ends[word]
        node, token, after = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), at.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            below = np.where(at < stop, self._edges(node << 8 | text[at]), -1)
            ended = below < 0
            # A walk that cannot go on yields its last whole token and starts anew behind it.
            found.append((word[ended], token[ended]))
            at = np.where(ended, after, at + 1)
            node = np.where(ended, 0, below)
            whole = self._token_at[node]
            token, after = np.where(whole >= 0, whole, token), np.where(whole >= 0, at, after)
            on = (at < stop) | ~ended
            word, at, stop, node, token, after = (x[on] for x in (word, at, stop, node, token, after))
        owner = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.int64)
        flat = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def merge(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """The encoding of each word by its merges: short ones side by side, each long one by a heap."""
        runs = self._merged(words)
        return [runs.ids[a : a + n] for a, n in zip(runs.starts.tolist(), runs.lengths.tolist())]

    def _merged(self, words: Sequence[bytes]) -> _Runs:
        long = [i for i, word in enumerate(words) if len(word) > LONG_STRETCH]
        if not long:
            return self._merge_short(words)
        short = [i for i, word in enumerate(words) if len(word) <= LONG_STRETCH]
        runs = self._merge_short([words[i] for i in short])
        merged = [self._merge_long(words[i]) for i in long]
        runs = runs.and_more(_Runs(np.concatenate(merged), np.array([len(m) for m in merged], np.int64)))
        order = np.zeros(len(words), np.int64)
        order[short + long] = np.arange(len(words))
        return runs.of(order)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Merges in the order of rank, then place, off a heap that is told of every border as it comes up."""
        symbol = self._base[np.frombuffer(word, np.uint8)]
        ranks = self._rank_of_pair(symbol[:-1], symbol[1:])
        heap = [(rank, at) for at, rank in enumerate(ranks.tolist()) if rank < _NEVER]
        heapify(heap)
        symbols, made, pair_rank = symbol.tolist(), self._made, self._pair_rank
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        while heap:
            rank, at = heappop(heap)
            end = after[at] if symbols[at] >= 0 else -1
            if end < 0 or pair_rank(symbols[at], symbols[end]) != rank:
                continue
            symbols[at], symbols[end] = int(made[rank]), -1
            after[at] = follow = after[end]
            if follow >= 0:
                before[follow] = at
                if (new := pair_rank(symbols[at], symbols[follow])) < _NEVER:
                    heappush(heap, (new, at))
            last = before[at]
            if last >= 0 and (new := pair_rank(symbols[last], symbols[at])) < _NEVER:
                heappush(heap, (new, last))
        return np.array([s for s in symbols if s >= 0], "<u4")

    def _merge_short(self, words: Sequence[bytes]) -> _Runs:
        """All words side by side.

        One round applies, in every word, its merge of smallest rank from left
        to right; words without one are done and leave.
        """
        of_word, how_many, symbols = [], [], []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self._base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = self._border_ranks(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            best = np.minimum.reduceat(rank, starts)
            done = best == _NEVER
            if done.any():
                on = np.repeat(~done, sizes)
                of_word.append(word[starts[done]])
                how_many.append(sizes[done])
                symbols.append(symbol[~on])
                symbol, word, rank = symbol[on], word[on], rank[on]
                best, sizes = best[~done], sizes[~done]
                if not len(symbol):
                    break
            hit = rank == np.repeat(best, sizes)
            if (hit[1:] & hit[:-1]).any():
                # Of hits in a row (the same symbol repeated) every other one is applied.
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
                hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self._made[rank[at]]
            stay = np.ones(len(hit), bool)
            stay[at + 1] = False
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            # A merge moves what follows it one place to the left.
            changed = at - np.arange(len(at))
            looked = np.zeros(len(symbol), bool)
            looked[changed] = True
            looked[np.maximum(changed - 1, 0)] = True
            fresh = np.flatnonzero(looked)
            rank[fresh] = self._border_ranks(symbol, word, fresh)
        if not symbols:
            return _Runs(np.zeros(0, "<u4"), np.zeros(len(words), np.int64))
        found = _Runs(np.concatenate(symbols).astype("<u4"), np.concatenate(how_many))
        number = np.full(len(words), -1, np.int64)
        number[np.concatenate(of_word)] = np.arange(len(found.lengths))
        if (number < 0).any():  # words of no bytes
            number[number < 0] = len(found.lengths)
            found = _Runs(found.ids, np.append(found.lengths, 0))
        return found.of(number)

    def _border_ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the merge of each symbol at ``at`` with the next one of its word."""
        after = np.minimum(at + 1, len(symbol) - 1)
        inside = (at + 1 < len(symbol)) & (word[after] == word[at])
        return np.where(inside, self._rank_of_pair(symbol[at], symbol[after]), _NEVER)

    def encode_words(self, words: Sequence[bytes]) -> _Runs:
        groups, held = [[]], 0
        for word in words:
            if held + len(word) > GROUP_BYTES and groups[-1]:
                groups.append([])
                held = 0
            groups[-1].append(word)
            held += len(word)
        done = [self._encode_group(group) for group in groups]
        return done[0] if len(done) == 1 else _Runs(np.concatenate([d.ids for d in done]), np.concatenate([d.lengths for d in done]))

    def _encode_group(self, words: list[bytes]) -> _Runs:
        """Propose, verify, and merge stretches around failing borders until all borders hold.

        A sequence in which all borders hold is the encoding, however it was
        found. Stretches that were not long enough are doubled.
        """
        tokens, lengths = self._propose(words)
        owner, text, radius = np.repeat(np.arange(len(words)), lengths), b"", MEND_RADIUS
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        while len(bad := inner[~self._borders_hold(tokens, inner)]):
            text = text or b"".join(words)
            # Of sorted borders the stretches are sorted too; those that touch are one.
            low = np.maximum(bad - radius, np.searchsorted(owner, owner[bad]))
            high = np.minimum(bad + 2 + radius, np.searchsorted(owner, owner[bad], side="right"))
            apart = low[1:] >= high[:-1]
            low, high = low[np.append(True, apart)], high[np.append(apart, True)]
            place = np.append(0, np.cumsum(self._sizes[tokens]))
            fresh = self._merged([text[a:b] for a, b in zip(place[low].tolist(), place[high].tolist())])
            gone = np.zeros(len(tokens) + 1, np.int64)
            gone[low] += 1
            gone[high] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            at = np.repeat(low - (np.cumsum(high - low) - (high - low)), fresh.lengths)
            of = np.repeat(owner[low], fresh.lengths)
            tokens, owner = np.insert(tokens[stay], at, fresh.ids), np.insert(owner[stay], at, of)
            # Only borders in and around the new stretches may have changed.
            first = low + np.cumsum(fresh.lengths - (high - low)) - (fresh.lengths - (high - low))
            near = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(near, np.maximum(first - 1, 0), 1)
            np.add.at(near, first + fresh.lengths, -1)
            inner = np.flatnonzero((np.cumsum(near)[:-2] > 0) & (owner[1:] == owner[:-1]))
            radius *= 2
        return _Runs(tokens.astype("<u4"), np.bincount(owner, minlength=len(words)))

    def _borders_hold(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        pairs, which = np.unique((tokens[at] << 32) | tokens[at + 1], return_inverse=True)
        return self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]

    def _encoded(self, words: list[str]) -> _Runs:
        """The ids of different words. A word behind a space is what a part without one stands for."""
        memory = self._memory
        known = np.fromiter((memory.get(w[1:], -1) if w[0] == " " and w[1:2] > "\1" else -1 for w in words), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        known[new] = len(memory.runs.lengths) + np.arange(len(new))
        return memory.runs.and_more(self.encode_words([words[i].encode() for i in new.tolist()])).of(known)

    def _learn(self, parts: Sequence[str]) -> _Runs:
        """The ids of all parts."""
        # Parts that start visibly and hold no space are split into words all at once: a word
        # that starts with a space starts a part there, and only there.
        usual, others = [], []
        for i, part in enumerate(parts):
            (usual if part[:1] > " " and " " not in part and not part[0].isspace() else others).append(i)
        words = self._words.findall(" " + " ".join([parts[i] for i in usual])) if usual else []
        starts = [i for i, word in enumerate(words) if word[0] == " "]
        sizes = np.diff([*starts, len(words)]).tolist()
        added = {}
        for i in others:
            part, split = parts[i], []
            if part[:1] == "\1" and part[1:] in self.added:
                added[len(sizes)] = self.added[part[1:]]
            else:
                split = self._words.findall(part[1:] if part[:1] == "\0" else f" {part}")
            words += split
            sizes.append(len(split))
        numbers: dict[str, int] = {}
        which = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        flat = self._encoded([*numbers]).of(which)
        ends = np.append(0, np.cumsum(flat.lengths))[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        lengths, ids = np.diff(ends), flat.ids
        if added:
            # Added tokens are an id of their own where their part stands.
            at = np.array([*added], np.int64)
            ids = np.insert(ids, ends[at], np.array([*added.values()], "<u4"))
            lengths[at] = 1
        order = np.zeros(len(parts), np.int64)
        order[usual + others] = np.arange(len(parts))
        return _Runs(ids, lengths).of(order)

    def _parts(self, text: str) -> list[str]:
        """The text in parts whose words do not depend on each other.

        A part that starts with NUL is what follows the NUL; one that starts
        with U+0001 and goes on as an added token is that token; any other
        stands for itself after a space.
        """
        first, *rest = text.split(" ") if _RUN.search(text) is None else _GAP.split(text)
        if "\0" in text or "\1" in text:
            rest = [f"\0 {r}" if r[:1] in "\0\1" else r for r in rest]
        return [f"\0{first}", *rest]

    def encode(self, texts: Sequence[str | None], remembered: int | None = None) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers; null as empty.

        ``remembered`` bytes of parts are kept for later texts, :data:`REMEMBERED_BYTES` if not given.
        """
        limit = REMEMBERED_BYTES if remembered is None else remembered
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for piece in _pieces(text or ""):
                if held + len(piece) > GROUP_CHARS and group:
                    self._encode_pieces(group, out, limit)
                    group, held = [], 0
                group.append((i, piece))
                held += len(piece)
        self._encode_pieces(group, out, limit)
        return [o[0] if len(o) == 1 else b"".join(o) for o in out]

    def _encode_pieces(self, group: list[tuple[int, str]], out: list[list[bytes]], limit: int) -> None:
        memory = self._memory
        parts = [self._with_added(p) if any(content in p for content in self.added) else self._parts(p) for _, p in group]
        counts = [len(p) for p in parts]
        numbers = np.fromiter(map(memory.__getitem__, chain.from_iterable(parts)), np.int64, sum(counts))
        runs = memory.runs.and_more(self._learn([*memory.new])) if memory.new else memory.runs
        found = runs.of(numbers)
        ends = 4 * np.append(0, np.cumsum(found.lengths))[np.append(0, np.cumsum(counts))]
        packed = found.ids.tobytes()
        for (i, _), start, end in zip(group, ends.tolist(), ends[1:].tolist()):
            out[i].append(packed[start:end])
        if memory.new:
            memory.settle(runs, np.bincount(numbers, minlength=len(runs.lengths)), limit)

    def _with_added(self, text: str) -> list[str]:
        out, at = [], 0
        for found in self._added.finditer(text):
            out += self._parts(text[at : found.start()])
            out.append(f"\1{found.group()}")
            at = found.end()
        return out + self._parts(text[at:])

    def forget(self) -> None:
        self._memory = _Memory()

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: bytes | None) -> str:
        table = self.bytes_of
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join([table[i] for i in numbers]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairs:
    """One per worker process and file."""
    return BytePairs.load(path)


def _per_batch(convert: Callable[[list], pa.Array], column: str, out: str, done: Callable[[], None] | None = None, rows: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, rows) if rows else batches:
            at = batch.schema.get_field_index(column)
            columns = [convert(c.to_pylist()) if i == at else c for i, c in enumerate(batch.columns)]
            names = [out if i == at else n for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if done:
            done()

    return run


def _replaced(df: DataFrame, column: str, out: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(out, kind) if f.name == column else f for f in df.schema.fields])


def encode(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    ids: str = "ids",
    rows: int | None = None,
    remembered: int | None = None,
) -> DataFrame:
    """``key`` and ``ids``: the whole text's token ids, packed as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every
    executor. Added tokens count as themselves wherever their string stands in
    a text; nothing is added, cut or padded. A null or empty text has no ids;
    rows that repeat and null keys stay as they are; other columns are left out.
    Where workers share an executor with much else, they can take so many ``rows``
    at once and keep so many ``remembered`` bytes of parts; both cost time.
    """

    def convert(texts: list) -> pa.Array:
        return pa.array(vocabulary(tokenizer).encode(texts, remembered), pa.binary())

    def done() -> None:
        # The worker goes on to other tasks, maybe of other operators.
        vocabulary(tokenizer).forget()
        give_back()

    texts = df.select(F.col(key), F.col(text))
    return texts.mapInArrow(_per_batch(convert, text, ids, done, rows), _replaced(texts, text, ids, T.BinaryType()))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with ``ids`` (packed as by :func:`encode`) turned into ``text``.

    Null ids decode to the empty text; bytes that are no UTF-8 to U+FFFD. The
    other columns stay; one called ``text`` already is refused.
    """
    if text.lower() in (c.lower() for c in df.columns if c != ids):
        raise ValueError(f"there is a column '{text}' already")

    def convert(packed: list) -> pa.Array:
        find = vocabulary(tokenizer).decode
        return pa.array([find(p) for p in packed], pa.string())

    return df.mapInArrow(_per_batch(convert, ids, text), _replaced(df, ids, text, T.StringType()))
