"""Byte-pair encoding and decoding by speculate and verify.

Words are proposed greedily (the longest vocabulary entry at each place).  A proposal is right exactly when
each of its tokens is what merging its own bytes gives and no merge can happen across any adjacent pair
before the merges inside the two tokens have used up the symbols at the border.  All distinct adjacent pairs
of a batch are tested together with numpy; only words with a failing pair are merged exactly, with a heap.

Nulls and empty texts encode to no ids; ids decode to text with malformed bytes replaced.  Texts of any length
are processed whole; repeated rows are independent; extra columns are carried through.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words kept between batches in each Python worker; the table is emptied when it is full.
CACHE_WORDS = 300_000
#: Longer words are merged with a heap.
SHORT = 48
#: Longer words are proposed for by themselves, from all of their places at once.
LONG = 1024
_NEVER = 1 << 60
_ID = (1 << 24) - 1


def _byte_chars() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: character to byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Table:
    """Integers by integer key (from 0), many at once: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits, self.missing = max(4, len(keys).bit_length() + 2), missing
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held, out = self.keys[slot], self.values[slot]
        other = held != keys
        odd = np.nonzero(other & (held >= 0))
        out[other] = self.missing
        while len(odd[0]):
            slot[odd] = (slot[odd] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[odd]]
            hit = held == keys[odd]
            out[tuple(o[hit] for o in odd)] = self.values[slot[odd]][hit]
            more = ~hit & (held >= 0)
            odd = tuple(o[more] for o in odd)
        return out


class Bpe:
    """Tables of one vocabulary file (the `tokenizers` JSON layout) and the encoding of single words."""

    most_words = CACHE_WORDS

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * self.size
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {} if self.suffix else self.mid
        for token, k in vocab.items():
            last = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(chars[c] for c in (token[: -len(self.suffix)] if last else token))
            (self.end if last else self.mid)[raw] = k
            self.token_bytes[k] = raw
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.merges: dict[int, int] = {}  # of a pair: the rank, then 24 bits of the new id
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x * self.size + y] = r << 24 | z
            self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.fromiter(self.merges.values(), np.int64, len(keys))[order] >> 24
        self.pairs = Table(keys, np.fromiter(self.merges.values(), np.int64, len(keys)), _NEVER)
        self.base_mid = np.array([self.mid[bytes([b])] for b in range(256)])
        self.base_end = np.array([self.end[bytes([b])] for b in range(256)])
        self._grow_trie()
        self._mark_reachable()
        self.forget()

    def _grow_trie(self) -> None:
        """Prefixes of the entries: `child` of (node << 8 | byte), -1 for none; nodes from `inner` on have no children."""
        raws = [*self.mid, *self.end]
        stems = {raw[:k] for raw in raws for k in range(len(raw))}
        node = {p: k for k, p in enumerate(stems)}
        self.inner, self.root = len(stems), node[b""]
        for raw in raws:
            node.setdefault(raw, len(node))
        steps = [(node[p[:-1]] << 8 | p[-1], k) for p, k in node.items() if p]
        self.child = Table(np.array([a for a, _ in steps], np.int64), np.array([k for _, k in steps], np.int32), -1)
        self.at_mid, self.at_end = np.full(len(node), -1, np.int32), np.full(len(node), -1, np.int32)
        for table, to in ((self.mid, self.at_mid), (self.end, self.at_end)):
            for raw, k in table.items():
                to[node[raw]] = k

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair, as in `merges`; _NEVER for none."""
        return self.pairs.get(a.astype(np.int64) * self.size + b)

    def _mark_reachable(self) -> None:
        """A token can be produced if its two parts can, and the border between them stays open until its merge."""
        self.reachable = np.zeros(self.size, bool)
        made = np.flatnonzero(self.rank >= 0)
        self.reachable[[*self.mid.values(), *self.end.values()]] = True
        made = made[np.argsort(self.rank[made])]
        holds = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t, good in zip(made.tolist(), holds.tolist(), strict=True):
            self.reachable[t] = good and self.reachable[self.left[t]] and self.reachable[self.right[t]]

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge joins a's end with b's start sooner than merges inside a or b do (or than `before`).

        Undoes the merges of both tokens, latest first, and looks at each pair of symbols that was at the border.
        At equal ranks the merge further left happens first, so the right token's merge is undone first.
        """
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        until = np.full(len(x), _NEVER) if before is None else before.astype(np.int64) * 2 + 1
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            key = x[live] * self.size + y[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == key
            # time of a merge: 2 * rank; a part of the right token goes at 2 * rank + 1, of the left one at 2 * rank
            bad = hit & (2 * self.pair_rank[at] < until[live])
            if before is not None:  # the pair's own merge is the one asked for
                bad &= ~(hit & (self.pair_rank[at] == before[live]) & (x[live] == a[live]) & (y[live] == b[live]))
            good[live[bad]] = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, rx, ry = live[go], rx[go], ry[go]
            of_left = rx > ry
            until[live] = np.where(of_left, 2 * rx, 2 * ry + 1)
            x[live] = np.where(of_left, self.right[x[live]], x[live])
            y[live] = np.where(of_left, y[live], self.left[y[live]])
        return good

    def _longest(self, raw: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest entry that starts at each place and ends by its end: id and length."""
        node = np.full(len(first), self.root, np.int32)
        best, step, act, depth = np.full(len(first), -1, np.int32), np.zeros(len(first), np.int64), np.arange(len(first)), 0
        while len(act):
            to = self.child.get(node[act].astype(np.int64) << 8 | raw[first[act] + depth])
            act, to, depth = act[to >= 0], to[to >= 0], depth + 1
            node[act] = to
            last = first[act] + depth == ends[act]
            found = np.where(last, self.at_end[to], self.at_mid[to])
            hit = act[found >= 0]
            best[hit], step[hit] = found[found >= 0], depth
            act = act[~last & (to < self.inner)]
        return best, step

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: flat ids by word, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        at, of, ids = ends - sizes, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in np.flatnonzero(sizes > LONG).tolist():
            places = np.arange(at[k], ends[k])
            best, step = self._longest(raw, places, np.full(len(places), ends[k]))
            walk, step, j = [], step.tolist(), 0
            while j < len(step):
                walk.append(j)
                j += step[j]
            of.append(np.full(len(walk), k))
            ids.append(best[walk])
        live = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        while len(live):
            best, step = self._longest(raw, at[live], ends[live])
            of.append(live)
            ids.append(best)
            at[live] += step
            live = live[at[live] < ends[live]]
        of = np.concatenate(of)
        return np.concatenate(ids)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, then furthest left."""
        ids = self.base_mid[np.frombuffer(word, np.uint8)].tolist()
        if not ids:
            return []
        ids[-1] = int(self.base_end[word[-1]])
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, size = self.merges.get, self.size
        best = [get(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while best and (m := min(best)) != _NEVER:
            k = best.index(m)
            ids[k] = z = m & _ID
            del ids[k + 1], best[k]
            if k:
                best[k - 1] = get(ids[k - 1] * size + z, _NEVER)
            if k < len(best):
                best[k] = get(z * size + ids[k + 1], _NEVER)
        return ids

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact merging of many words, those of one length together: every round merges one pair of each.

        Gives ids, where each word's begin and how many they are.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts, sizes, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0

        def finish(rows: np.ndarray, ids: np.ndarray) -> None:
            nonlocal at
            starts[rows], sizes[rows] = at + np.arange(len(rows)) * ids.shape[1], ids.shape[1]
            parts.append(ids.astype(np.int32).ravel())
            at += ids.size

        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > SHORT or len(rows) < 4 or n < 2:
                for k in rows.tolist():
                    finish(np.array([k]), np.array([self.merge(words[k])], np.int32))
                continue
            raw = np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8).reshape(-1, n)
            ids = self.base_mid[raw]
            ids[:, -1] = self.base_end[raw[:, -1]]
            best = self._look_up(ids[:, :-1], ids[:, 1:])
            while True:
                if not best.shape[1]:
                    finish(rows, ids)
                    break
                k = best.argmin(axis=1)
                found = best[np.arange(len(k)), k]
                live = found != _NEVER
                if not live.all():
                    finish(rows[~live], ids[~live])
                    rows, ids, best, k, found = rows[live], ids[live], best[live], k[live], found[live]
                    if not len(rows):
                        break
                z, each, width = found & _ID, np.arange(len(k)), ids.shape[1]
                columns = np.arange(width - 1)
                ids = np.take_along_axis(ids, columns + (columns > k[:, None]), 1)
                ids[each, k] = z
                best = np.take_along_axis(best, columns[:-1] + (columns[:-1] >= k[:, None]), 1)
                r = each[k > 0]
                best[r, k[r] - 1] = self._look_up(ids[r, k[r] - 1], z[r])
                r = each[k < width - 2]
                best[r, k[r]] = self._look_up(z[r], ids[r, k[r] + 1])
        return np.concatenate(parts), starts, sizes

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs; pairs that are gone are passed over."""
        merges, size, n = self.merges, self.size, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get(ids[k] * size + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k, p, q = heapq.heappop(heap)
            j = after[k]
            if ids[k] != p or j < 0 or ids[j] != q:
                continue
            z = m & _ID
            ids[k], ids[j] = z, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if (m := merges.get(z * size + ids[after[j]])) is not None:
                    heapq.heappush(heap, (m, k, z, ids[after[j]]))
            if (i := before[k]) >= 0 and (m := merges.get(ids[i] * size + z)) is not None:
                heapq.heappush(heap, (m, i, ids[i], z))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids of the words in one array, where each word's begin, how many they are, and how many proposals failed."""
        flat, sizes = self.propose(words)
        of = np.repeat(np.arange(len(words)), sizes)
        bad = ~self.reachable[flat]
        if len(flat) > 1:
            inner = of[1:] == of[:-1]
            keys, back = np.unique(flat[:-1][inner].astype(np.int64) * self.size + flat[1:][inner], return_inverse=True)
            bad[1:][inner] |= ~self.compatible(keys // self.size, keys % self.size)[back]
        failed = np.unique(of[bad])
        starts = np.cumsum(sizes) - sizes
        merged, first, sizes[failed] = self.merge_many([words[k] for k in failed.tolist()])
        starts[failed] = len(flat) + first
        return np.concatenate([flat, merged]), starts, sizes, len(failed)

    def forget(self) -> None:
        self.known = Runs()

    def code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in one array, where each word's begin and how many they are."""
        return self.encode_words([w.encode() for w in words])[:3]

    def encode_split(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of documents given as words, and how many each has."""
        if len(self.known.numbers) > self.most_words:
            self.forget()
        flat, ends = self.known.look_up(list(chain.from_iterable(docs)), self.code)
        return flat, np.diff(ends[np.cumsum([0, *map(len, docs)])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; ids that the vocabulary hasn't give nothing, malformed bytes the replacement character."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Numbers(dict):
    """Numbers strings as they are first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Runs:
    """Strings with the ids they are coded to."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: list[str], code: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and the bounds between them. code: gives ids, starts and sizes of new words."""
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            ids, starts, sizes = code(self.numbers.new)
            self.numbers.new = []
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        n = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.starts[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class ByteLevel(Bpe):
    """Byte-level vocabulary that keeps every byte; special strings in a text become their own ids."""

    #: The vocabulary's split pattern.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        super().__init__(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        find, special = self.WORDS.findall, self.special
        if not any(s in t for t in texts if t for s in special):
            return self.encode_split([find(t) if t else [] for t in texts])
        parts, of = [], []
        for k, t in enumerate(texts):
            for p in self.cut.split(t or ""):
                parts.append(p)
                of.append(k)
        flat, counts = self.encode_split([[] if p in special else find(p) for p in parts])
        out, sizes, upto = [], np.zeros(len(texts), np.int64), np.concatenate([[0], np.cumsum(counts)])
        for j, p in enumerate(parts):
            piece = np.array([special[p]], np.int32) if p in special else flat[upto[j] : upto[j + 1]]
            out.append(piece)
            sizes[of[j]] += len(piece)
        return (np.concatenate(out) if out else flat), sizes


class WordLevel(Bpe):
    """Vocabulary with word ends: composes, lower-cases and drops white space before splitting."""

    #: The vocabulary's split pattern.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Texts of these characters need no composing, lower-case one by one, and have no other white space than ASCII's;
    #: any other text goes through the library itself.
    PLAIN = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x12F), (0x132, 0x17F), (0x2010, 0x2027), (0x20AC, 0x20AC))

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path
        self.odd = np.ones(65536, bool)
        for a, b in self.PLAIN:
            self.odd[a : b + 1] = False

    @functools.cached_property
    def library(self):  # noqa: ANN201
        """The library's own tokenizer, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def plain(self, text: str) -> bool:
        return not (self.odd[np.frombuffer(text.encode("utf-16-le"), np.uint16)].any() or any(s in text for s in self.special))

    def forget(self) -> None:
        super().forget()
        self.parts = Runs()

    def code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words here are what white space parts; each is split further by the pattern."""
        find = self.WORDS.findall
        split = [[w] if w.isalpha() else find(w) for w in words]
        if len(self.parts.numbers) > self.most_words:
            self.parts = Runs()
        flat, ends = self.parts.look_up(list(chain.from_iterable(split)), super().code)
        bounds = ends[np.cumsum([0, *map(len, split)])]
        return flat, bounds[:-1], np.diff(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain = [True] * len(texts) if self.plain("".join(t for t in texts if t)) else [not t or self.plain(t) for t in texts]
        flat, sizes = self.encode_split([t.lower().split() if t and p else [] for t, p in zip(texts, plain, strict=True)])
        if all(plain):
            return flat, sizes
        upto, out = np.concatenate([[0], np.cumsum(sizes)]), []
        for k, p in enumerate(plain):
            piece = flat[upto[k] : upto[k + 1]] if p else np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.int32)
            out.append(piece)
            sizes[k] = len(piece)
        return np.concatenate(out), sizes


_LOADED: dict[tuple[type, str], Bpe] = {}


def load(kind: type, path: str):
    """The vocabulary's tables, made once in each Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def tidy() -> None:
    """Gives freed memory back to the system: idle Python workers stay, and their memory counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextlib.contextmanager
def loaded(kind: type, path: str, words: int = CACHE_WORDS) -> Iterator[Bpe]:
    """The vocabulary's tables for one task; the words that it has seen, so many at a time, are forgotten after it.

    Coding makes no cycles, but many small lists beside large tables, which the collector would go through in vain.
    """
    bpe, collects = load(kind, path), gc.isenabled()
    bpe.most_words = words
    gc.disable()
    try:
        yield bpe
    finally:
        if collects:
            gc.enable()
        bpe.forget()
        tidy()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about so many bytes of the column (one row at least)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, upto = 0, np.cumsum(sizes)
        while at < b.num_rows:
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + most_bytes, "right")))
            yield b.slice(at, end - at)
            at = end


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that the frame doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", kind: type = ByteLevel, decoded: str | None = None) -> DataFrame:
    """Adds the ids of the whole text as an array of int; null and empty texts have none.

    decoded: if given, also adds under this name what `decode` makes of the ids, in the same Python process.
    Columns of these names in the input are replaced; all others are carried.
    """
    df = df.drop(out, *[decoded] * bool(decoded))
    more = [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(kind, path) as bpe:
            for b in slices(batches, text):
                flat, sizes = bpe.encode(b.column(text).to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                columns = [*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    columns.append(pa.array([bpe.decode(flat[s:e]) for s, e in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", kind: type = ByteLevel) -> DataFrame:
    """Adds the text of the ids, special tokens included; null or empty ids give an empty text, unknown ids nothing.

    A column of the name `out` in the input is replaced; all others are carried.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(kind, path) as bpe:
            for b in batches:
                lists = b.column(ids)
                texts = [bpe.decode(np.array(x.values.fill_null(-1)) if x.is_valid else np.zeros(0, np.int64)) for x in lists]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return df.mapInArrow(run, schema)
