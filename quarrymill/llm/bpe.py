"""Byte-pair merging of many words at once, on NumPy arrays.

`Merger` holds a table of pairs: (left id, right id) -> (merged id, rank). `merge` takes words as one
flat array of symbol ids and applies, to each word, the pair of the lowest rank (the leftmost of equals)
until none is left: what an agenda ordered by (rank, position) does word by word. A candidate may be
skipped by a keyed hash; a pair at a position that is skipped once is never applied there.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(2**62)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... (sizes[i] of them) of every i, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begin - before, sizes) + np.arange(int(sizes.sum()))


class Merger:
    #: Longer words are merged one by one with a heap, in n log n steps.
    LONG = 256

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], drop: float = 0.0):
        """pairs: (left, right) -> (merged, rank); ids below 2**31, ranks below 2**31. drop: share of candidates skipped."""
        keys = np.fromiter(((a << 32) | b for a, b in pairs), dtype=np.int64, count=len(pairs))
        made = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        # behind the last pair stands one that no symbols make
        self.keys, self.merged, self.rank = np.append(keys[order], -1), np.append(made[order, 0], 0), np.append(made[order, 1], NONE)
        # slot -> place of its first key; where other keys have the same slot, a miss is looked up among all keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slot = self._slot(self.keys[:-1])
        first, place, many = np.unique(slot, return_index=True, return_counts=True)
        self.slots = np.full(1 << (64 - int(self.shift)), len(keys), np.int32)
        self.slots[first] = place
        self.shared = np.zeros(len(self.slots), bool)
        self.shared[first[many > 1]] = True
        self.limit = np.uint64(min(int(drop * 2.0**64), 2**64 - 1))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _M1) >> self.shift).view(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        slot = self._slot(key)
        at = self.slots[slot]
        miss = self.keys[at] != key
        at[miss] = len(self.keys) - 1
        again = np.flatnonzero(miss & self.shared[slot])
        if len(again):
            found = np.searchsorted(self.keys[:-1], key[again])
            ok = self.keys[found] == key[again]
            at[again[ok]] = found[ok]
        return self.rank[at], self.merged[at]

    def _salt(self, word_key: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """What the hash of a candidate takes from its word and its place, the same for all pairs there."""
        return mix(word_key ^ offset.astype(np.uint64)) if self.limit else np.zeros(len(offset), np.uint64)

    def _candidates(self, left: np.ndarray, right: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE as the rank of one that is no merge or is skipped."""
        rank, merged = self._look_up(left, right)
        if self.limit:
            pair = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
            rank[mix(salt ^ pair) < self.limit] = NONE
        return rank, merged

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, word_keys: np.ndarray | None = None) -> list[np.ndarray]:
        """Ids of each word after merging. symbols: all words in a row; lengths: theirs, each at least 1."""
        ids, sizes = self.merge_flat(symbols, lengths, word_keys)
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def merge_flat(self, symbols: np.ndarray, lengths: np.ndarray, word_keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        n_words = len(lengths)
        keys = np.zeros(n_words, np.uint64) if word_keys is None else word_keys
        sizes = np.zeros(n_words, np.int64)
        done_words: list[np.ndarray] = []
        done_ids: list[np.ndarray] = []
        starts = np.cumsum(lengths) - lengths
        for w in np.flatnonzero(lengths > self.LONG):
            one = self._merge_one(symbols[starts[w] : starts[w] + lengths[w]], keys[w])
            sizes[w] = len(one)
            done_words.append(np.array([w]))
            done_ids.append(one)
        which = np.flatnonzero(lengths <= self.LONG)
        if len(which):
            self._merge_short(symbols, lengths, keys, which, sizes, done_words, done_ids)
        if not done_words:
            return np.zeros(0, np.int64), sizes
        words, ids = np.concatenate(done_words), np.concatenate(done_ids)
        have = sizes[words]
        begin = np.zeros(n_words, np.int64)
        begin[words] = np.cumsum(have) - have
        return ids[spread(begin, sizes)], sizes

    def _merge_short(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, which: np.ndarray, sizes: np.ndarray, done_words: list[np.ndarray], done_ids: list[np.ndarray]) -> None:
        """Merges the words `which`, all at once: in each round the best candidate of every word that has one.

        Symbols keep their places and know their neighbours, so a round changes a few numbers for each word. What is
        merged away, and words that are done, are taken out when they are the larger part.
        """
        sym = (symbols if len(which) == len(lengths) else symbols[np.repeat(lengths <= self.LONG, lengths)]).astype(np.int64)
        size = lengths[which].astype(np.int64)
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(which)), size)
        place = np.arange(len(sym))
        salt = self._salt(keys[which][word], place - start[word])
        after, before = place + 1, place - 1
        after[start + size - 1] = -1
        before[start] = -1
        # of each symbol and the one after it: rank in the high bits, place in the low ones, so the least is the leftmost of the lowest rank
        order, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)

        def judge(at: np.ndarray) -> None:
            rank, into[at] = self._candidates(sym[at], sym[after[at]], salt[at])
            order[at] = np.where(rank < NONE, (rank << 31) | at, NONE)

        judge(np.flatnonzero(after >= 0))
        while True:
            best = np.minimum.reduceat(order, start)
            going = best < NONE
            n = int(np.count_nonzero(going))
            if n <= len(which) // 2:
                alive = sym >= 0
                done = alive & ~going[word]
                done_words.append(which[~going])
                done_ids.append(sym[done])
                sizes[which] = np.bincount(word[alive], minlength=len(which))
                if not n:
                    return
                stay = alive & going[word]
                moved = np.cumsum(stay) - 1
                after, before = after[stay], before[stay]
                after, before = np.where(after < 0, -1, moved[after]), np.where(before < 0, -1, moved[before])
                sym, salt, into, order = sym[stay], salt[stay], into[stay], order[stay]
                order = np.where(order < NONE, (order >> 31 << 31) | np.arange(len(order)), NONE)
                word = (np.cumsum(going) - 1)[word[stay]]
                which = which[going]
                start = np.searchsorted(word, np.arange(n))
                best = np.minimum.reduceat(order, start)
            elif n < len(which):
                best = best[going]
            at = best & ((1 << 31) - 1)
            right = after[at]
            beyond = after[right]
            sym[at], sym[right] = into[at], -1
            order[at] = order[right] = NONE
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            left = before[at]
            near = np.concatenate([at[inside], left[left >= 0]])
            if len(near):
                judge(near)

    def _merge_one(self, symbols: np.ndarray, word_key: np.uint64) -> np.ndarray:
        """The same for one long word: a heap of (rank, place) over a linked list."""
        sym = symbols.astype(np.int64)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, version = [True] * n, [0] * n
        salt = self._salt(np.full(n, word_key), np.arange(n))
        rank, into = self._candidates(sym[:-1], sym[1:], salt[:-1])
        ids = sym.tolist()
        heap = [(int(r), i, 0, 0, int(m)) for i, (r, m) in enumerate(zip(rank, into, strict=True)) if r < NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r, m = self._candidates(np.array([ids[i]]), np.array([ids[j]]), salt[i : i + 1])
                if r[0] < NONE:
                    heapq.heappush(heap, (int(r[0]), i, version[i], version[j], int(m[0])))

        while heap:
            _, i, vi, vj, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or version[i] != vi or j >= n or version[j] != vj:
                continue
            ids[i] = made
            alive[j] = False
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([ids[i] for i in range(n) if alive[i]], dtype=np.int64)


def lowest_first(pairs: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(left, right, merged) in order of rank -> the table of a Merger."""
    return {(a, b): (m, rank) for rank, (a, b, m) in enumerate(pairs)}
