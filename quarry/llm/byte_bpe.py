"""Byte-level BPE vocabularies: their tables, pre-tokens and certain cuts.

A byte pair that stands inside no token of the vocabulary can be inside no
merge result either, so a token boundary lies between its two bytes wherever
it occurs: a certain cut. Texts first fall into fragments at white space after
anything else, where the pre-tokenizer's pattern begins anew without looking
back, so that nothing outside a fragment can change it. (Most of these places
are cuts of the table too, but not all: the first bytes of white space beyond
ASCII also stand inside tokens.) Within a pre-token, every certain cut of the
table splits it into pieces whose merges are independent. Before the pre-tokens are known, other pairs of the table are
no safe places: the pattern looks ahead past runs of white space and takes a
run of marks as a whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from quarry.llm.common import vocabulary

#: White space as the pre-tokenizer's pattern knows it (Unicode White_Space).
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A blank beside other white space.
_ODD = re.compile(rf"[{WS}] | [{WS}]")
#: A fragment in general: white space, then all up to the next white space.
_FRAGMENT = re.compile(rf"[{WS}]*[^{WS}]+|[{WS}]+")
_PRETOKEN = regex.compile(PATTERN)
#: Fragments that a worker keeps, and the longest of them.
CACHE, KEPT_CHARS = 600_000, 48
#: Words whose scores a worker keeps.
SCORES = 300_000
NONE = np.iinfo(np.int32).max
#: Sequences of more symbols are merged by a heap.
LONG = 4096


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def utf8(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes in one array, and how many each has."""
    size = [len(p) if p.isascii() else len(p.encode()) for p in pieces]
    return np.frombuffer("".join(pieces).encode(), dtype=np.uint8), np.array(size, dtype=np.int64)


class _Known(dict):
    """Values of fragments, of which older ones come from old when they are
    asked for; one that isn't held there either is noted as new, with None."""

    old: dict
    new: list[str]

    def __missing__(self, fragment: str) -> object:
        value = self.old.get(fragment)
        if value is None:
            self.new.append(fragment)
        self[fragment] = value
        return value


class FragmentTable:
    """What is known of fragments, for lists of texts; what isn't known yet is
    learned together. fixed: values that hold without learning."""

    def __init__(self, fixed: dict, cache: int = CACHE):
        self.fixed, self.cache = fixed, cache
        self.empty()

    def empty(self) -> None:
        self._begin({})

    def _begin(self, old: dict) -> None:
        self.known = _Known(self.fixed)
        self.known.old = old

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, fragments: list[str]) -> list:
        raise NotImplementedError

    def resolve(self, batch: list[str | None]) -> list[list]:
        known = self.known
        known.new = new = []
        look = known.__getitem__
        lists = [self.split(text) if text else [] for text in batch]
        out = [list(map(look, parts)) for parts in lists]  # with None for what is new
        if new:
            try:
                learned = dict(zip(new, self.learn(new), strict=True))
            except BaseException:
                self.empty()
                raise
            known.update(learned)
            out = [[learned[p] if value is None else value for p, value in zip(parts, found)] for parts, found in zip(lists, out)]
        for p in new:
            if len(p) > KEPT_CHARS:
                del known[p]
        if 2 * len(known) >= self.cache:  # those that are asked for again stay, the others go with the next turn
            known.old = {}
            self._begin(known)
        return out


_TABLE: dict[tuple, FragmentTable] = {}


def table_of(key: tuple, make: Callable[[], FragmentTable]) -> FragmentTable:
    """The worker's table for key. It holds one at a time, so those of earlier
    stages don't add up in workers that go on."""
    if key not in _TABLE:
        release()
        _TABLE[key] = make()
    pa.default_memory_pool().release_unused()  # what the batches of earlier tasks have taken
    return _TABLE[key]


def release() -> None:
    """Gives back what the worker holds for other stages."""
    _TABLE.clear()
    pa.default_memory_pool().release_unused()


class ByteBPE:
    """Tables of one vocabulary file. special: strings that are one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        model = spec["model"]
        raw = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*raw.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in raw.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(self.size)]
        self.byte_id = np.array([raw.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        # merges: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(back[c] for c in left), bytes(back[c] for c in right)
            self.merges[raw[a], raw[b]] = (rank, raw[a + b])
        #: cut[a, b]: the byte pair ab stands inside no token.
        self.cut = np.ones((256, 256), dtype=bool)
        for token in raw:
            for a, b in zip(token, token[1:]):
                self.cut[a, b] = False
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def sections(self, text: str) -> list[str]:
        """The text, cut around special strings (which stand at odd places)."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return self.split_special.split(text)

    def fragments(self, text: str) -> list[str]:
        """The text, cut before white space that follows anything else. Joined
        they are the text; each is encoded by itself."""
        if _ODD.search(text) is None:
            first, *rest = text.split(" ")
            rest = [" " + x for x in rest]
            return [first, *rest] if first else rest
        return _FRAGMENT.findall(text)

    def split(self, text: str) -> list[str]:
        """A whole text's fragments, special strings by themselves."""
        sections = self.sections(text)
        if len(sections) == 1:
            return self.fragments(text)
        return [p for i, s in enumerate(sections) for p in ([s] if i % 2 else self.fragments(s))]

    def ragged(self, fragments: list[str], cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All fragments' pre-tokens in one array: bytes, each byte's sequence,
        each sequence's fragment, and where sequences start. A sequence is a
        pre-token, or with cuts what certain cuts leave of one."""
        pieces: list[str] = []
        count = []
        find = _PRETOKEN.findall
        for fragment in fragments:
            found = find(fragment)
            pieces += found
            count.append(len(found))
        flat, size = utf8(pieces)
        starts = np.cumsum(size) - size
        fragment_of = np.repeat(np.arange(len(fragments)), np.array(count, dtype=np.int64))
        if cuts and len(flat) > 1:
            head = np.zeros(len(flat), dtype=bool)
            head[starts] = True
            pretoken = np.cumsum(head) - 1
            head[1:] |= self.cut[flat[:-1], flat[1:]]
            starts = np.flatnonzero(head)
            fragment_of = fragment_of[pretoken[starts]]
            size = np.diff(np.r_[starts, len(flat)])
        return flat, np.repeat(np.arange(len(starts)), size), fragment_of, starts


class RankMerger:
    """Applies merges to many sequences at once: in each round every sequence
    merges its lowest-rank pair, wherever it stands; those without a pair stay
    as they are."""

    def __init__(self, size: int, merges: dict[tuple[int, int], tuple[int, int]]):
        """size: ids are below it; merges: (left, right) -> (rank, merged)."""
        self.merges, self.size = merges, np.int64(size)
        bits = 20
        while (1 << bits) < 8 * max(1, len(merges)):
            bits += 1
        # an open-addressing table: one gather finds nearly every pair
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, NONE, dtype=np.int32)
        self.made = np.zeros(1 << bits, dtype=np.int32)
        self.steps = 1
        for (a, b), (rank, made) in merges.items():
            key, step = a * size + b, 1
            slot = int(self._slot(np.array([key], dtype=np.int64))[0])
            while self.keys[slot] >= 0:
                slot, step = (slot + 1) & int(self.mask), step + 1
            self.keys[slot], self.rank[slot], self.made[slot] = key, rank, made
            self.steps = max(self.steps, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NONE where there is none), and what they merge to."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        for _ in range(self.steps - 1):
            miss = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & self.mask
        return np.where(self.keys[slot] == keys, self.rank[slot], NONE), self.made[slot]

    def merge(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, each id's sequence), in order, of symbols and their sequences
        (ascending). Very long sequences, which would need a round for nearly
        each of their merges, go through a heap one by one."""
        size = np.bincount(of) if len(of) else of
        long = np.flatnonzero(size > LONG)
        if not len(long):
            return self._rounds(symbols, of)
        inside = np.isin(of, long)
        ids, owner = self._rounds(symbols[~inside], of[~inside])
        found = [(k, self._heap(symbols[of == k].tolist())) for k in long.tolist()]
        ids = np.concatenate([ids, *[np.array(x, dtype=np.int64) for _, x in found]])
        owner = np.concatenate([owner, *[np.full(len(x), k) for k, x in found]])
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def _heap(self, ids: list[int]) -> list[int]:
        """One sequence's merges, by a heap of pairs over linked places."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merges[a, b][1], -1, after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (m := merges.get((ids[k], ids[i]))):
                heapq.heappush(heap, (m[0], k, ids[k], ids[i]))
        return [x for x in ids if x >= 0]

    def _rounds(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, of, done_ids, done_of = symbols.astype(np.int32), of.astype(np.int32), [], []
        # of the pair that begins at each symbol; kept over the rounds, as merges change only their neighbours'
        rank, made = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
        at = np.flatnonzero(of[:-1] == of[1:])
        rank[at], made[at] = self._ranks(symbols[at], symbols[at + 1])
        while len(symbols) > 1:
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[heads, len(symbols)])
            lowest = np.minimum.reduceat(rank, heads)
            if (lowest == NONE).any():  # finished sequences leave the array
                live = np.repeat(lowest != NONE, size)
                done_ids.append(symbols[~live])
                done_of.append(of[~live])
                symbols, of, rank, made = symbols[live], of[live], rank[live], made[live]
                if not len(symbols):
                    break
                size, lowest = size[lowest != NONE], lowest[lowest != NONE]
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # of overlapping hits (aa in aaa) every second counts, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            if len(run) < len(at):
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbols[at] = made[at]
            stays = np.ones(len(symbols), dtype=bool)
            stays[at + 1] = False
            symbols, of, rank, made = symbols[stays], of[stays], rank[stays], made[stays]
            at -= np.arange(len(at))  # where the merged symbols stand now
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = NONE
            at = at[at + 1 < len(symbols)]
            at = at[of[at] == of[at + 1]]
            rank[at], made[at] = self._ranks(symbols[at], symbols[at + 1])
        ids, of = np.concatenate([*done_ids, symbols]), np.concatenate([*done_of, of])
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]


@lru_cache(maxsize=4)
def load(name: str) -> ByteBPE:
    return ByteBPE(vocabulary(name))


@lru_cache(maxsize=4)
def merger(name: str) -> RankMerger:
    bpe = load(name)
    return RankMerger(bpe.size, bpe.merges)
