"""Batch encoder for a byte-level BPE with word ends, giving the tokenizer library's ids.

Texts are cut into the tokenizer's own units (runs of letters, single digits, runs of other characters,
contractions) with array operations over UTF-8 bytes; each distinct unit is merged once, all units of a batch
together, and kept for later batches. Texts with characters outside ASCII and the Latin-1 letters, with control
characters, or with the opening of a special token go to the library itself, whole.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import lower_ascii, span_hashes, text_chunks

NONE = np.int32(2**31 - 1)
#: Units longer than this many bytes are encoded by the library.
LONGEST = 48
#: Distinct units that a worker keeps between batches; beyond it the store starts anew.
KEPT_UNITS = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PairTable:
    """Rank of an adjacent pair of symbols; a two-level hash table in arrays."""

    def __init__(self, pairs: np.ndarray, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        keys = pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.levels = []
        rng = np.random.default_rng(7)
        while len(keys):
            k = rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            slot = keys * k >> self.shift
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((k, held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = None
        for k, held, rank in self.levels:
            slot = key * k >> self.shift
            found = np.where(held[slot] == key, rank[slot], NONE)
            out = found if out is None else np.minimum(out, found)
        return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.table = PairTable(np.array([[vocab[a], vocab[b]] for a, b in merges]))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int32)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _keep(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(sizes)] = sizes
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(sizes)), strict=True))

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit of UTF-8 bytes, concatenated, and their number for each unit."""
        n = len(starts)
        counts, order = np.zeros(n, np.int64), np.argsort(sizes, kind="stable")
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < n:
            width = int(sizes[order[min(a + 1023, n - 1)]])
            width = max(width, int(sizes[order[a]]))
            b = int(np.searchsorted(sizes[order], width, side="right"))
            b = min(b, a + 32768)
            pick = order[a:b]
            a = b
            if width > LONGEST:
                for i in pick.tolist():
                    ids = np.array(self.library.encode(bytes(data[starts[i] : starts[i] + sizes[i]]).decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                    counts[i] = len(ids)
                    rows.append((np.array([i]), ids[None, :], counts[i : i + 1]))
                continue
            have, cols = sizes[pick], np.arange(width)
            raw = data[np.minimum(starts[pick][:, None] + cols, len(data) - 1)]
            s = np.where(cols == (have - 1)[:, None], self.last[raw], self.inner[raw])
            r = np.full((len(pick), max(width, 1)), NONE)
            if width > 1:
                r[:, :-1] = np.where(cols[1:] < have[:, None], self.table(s[:, :-1], s[:, 1:]), NONE)
            left, have = pick, have.copy()
            while len(left):
                j = r.argmin(1)
                line = np.arange(len(left))
                rank = r[line, j]
                done = rank == NONE
                if done.any():
                    rows.append((left[done], s[done], have[done]))
                    counts[left[done]] = have[done]
                    go = ~done
                    left, s, r, have, j, rank = left[go], s[go], r[go], have[go], j[go], rank[go]
                    line = np.arange(len(left))
                    if not len(left):
                        break
                s[line, j] = self.merged[rank]
                move = np.minimum(cols + (cols > j[:, None]), width - 1)
                s, r = np.take_along_axis(s, move, 1), np.take_along_axis(r, move, 1)
                have -= 1
                right = np.minimum(j + 1, width - 1)
                r[line, j] = np.where(j + 1 < have, self.table(s[line, j], s[line, right]), NONE)
                before = np.maximum(j - 1, 0)
                fresh = self.table(s[line, before], s[line, j])
                r[line, before] = np.where(j > 0, fresh, r[line, before])
                r[line, have - 1] = NONE
        offsets = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for i, s, have in rows:
            keep = np.arange(s.shape[1]) < have[:, None]
            flat[(offsets[i][:, None] + np.arange(s.shape[1]))[keep]] = s[keep]
        return flat, counts

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, unit starts and ends, and which documents need the library."""
        low = lower_ascii(data)
        n = len(low)
        lead = low == 0xC3
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1] & (low[1:] >= 0x80) & (low[1:] <= 0xBF)
        capital = tail & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        low[capital] += 0x20
        sign = tail & ((low == 0x97) | (low == 0xB7))
        odd = ((low >= 0x80) & ~lead & ~tail) | (low == 127) | ((low < 32) & (low != 9) & (low != 10) & (low != 13))
        odd[:-1] |= (low[:-1] == 60) & (low[1:] == 124)
        kind = np.full(n, 3, np.int8)
        kind[(low >= 97) & (low <= 122)] = 1
        kind[lead | tail] = 1
        kind[sign] = 3
        kind[:-1][sign[1:]] = 3
        kind[(low >= 48) & (low <= 57)] = 2
        kind[(low == 32) | (low == 9) | (low == 10) | (low == 13)] = 0
        begin = np.ones(n + 1, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin[offsets] = True
        fixed = np.zeros(n + 1, bool)
        fixed[offsets] = True
        for i in np.flatnonzero((low[:-2] == 39) & (kind[1:-1] == 1) & begin[: n - 2]).tolist() if n > 2 else []:
            word = bytes(low[i + 1 : i + 3])
            size = 2 if word[:1] in (b"s", b"t", b"m", b"d") else 3 if word in (b"re", b"ve", b"ll") else 0
            if size and not fixed[i + 1 : i + size].any():
                begin[i + 1 : i + size] = False
                begin[i + size] = True
        if n > 1 and low[n - 2] == 39 and bytes(low[n - 1 :]) in (b"s", b"t", b"m", b"d") and begin[n - 2] and not fixed[n - 1]:
            begin[n - 1] = False
        edges = np.flatnonzero(begin)
        starts = edges[:-1]
        solid = kind[starts] != 0
        strange = np.add.reduceat(np.concatenate([odd, [False]]).astype(np.int64), offsets[:-1]) > 0 if len(offsets) > 1 else np.zeros(0, bool)
        strange &= np.diff(offsets) > 0
        return low, starts[solid], edges[1:][solid], strange

    def encode_column(self, column: pa.Array):
        """The ids of each row of an Arrow string column; null is an empty text."""
        for row, data, offsets in text_chunks(column):
            if len(data) == 0:
                yield from repeat(np.zeros(0, self.dtype), len(offsets) - 1)
                continue
            low, starts, ends, strange = self.units(data, offsets)
            bounds = np.searchsorted(starts, offsets)
            each, hashes = pd.factorize(span_hashes(low, starts, ends))
            first = np.zeros(len(hashes), np.int64)
            first[each[::-1]] = np.arange(len(each) - 1, -1, -1)
            if len(self.known) + len(hashes) > KEPT_UNITS:
                self._clear()
            names = hashes.tolist()
            place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
            fresh = np.flatnonzero(place < 0)
            if len(fresh):
                ids, counts = self.merge(low, starts[first[fresh]], (ends - starts)[first[fresh]])
                n = len(self.known)
                self._keep(hashes[fresh].tolist(), ids, counts)
                place[fresh] = np.arange(n, n + len(fresh))
            unit = place[each]
            sizes = self.size[unit]
            ends_at = np.cumsum(sizes)
            flat = self.flat[np.repeat(self.at[unit] - (ends_at - sizes), sizes) + np.arange(int(ends_at[-1]) if len(ends_at) else 0)]
            cut = np.concatenate([[0], ends_at])[bounds]
            for i in range(len(offsets) - 1):
                if strange[i]:
                    text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
                else:
                    yield flat[cut[i] : cut[i + 1]]


@cache
def load(path: str) -> WordBpe:
    """One encoder for each worker process and path."""
    return WordBpe(path)
