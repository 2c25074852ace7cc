"""Frames of tokens in a bucket of files, on Arrow tables: what duplicate_tokens() runs inside its tasks."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of a frame's two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FRAMES = "bucket long, at long, h1 long, h2 long, k long, path string, pos long, first long, last long, o1 long, o2 long"
COPIES = "path_a string, from_a long, to_a long, path_b string, from_b long, to_b long, tokens long"
_PLACE = ("pos", "first", "last", "o1", "o2")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _sums(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of `width` values."""
    power, back = (np.cumprod(np.full(len(h), x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    return _mixed((s[width:] - s[:-width]) * back[: len(s) - width])


class Frames:
    """Every frame of `width` tokens in some lines (path, line_no, line), by file and place, and the number of its text among the distinct ones."""

    def __init__(self, lines: pa.Table, token: str, width: int):
        lines = lines.sort_by([(c, "ascending") for c in ("path", "line_no", "line")])
        find = re.compile(token, re.ASCII).findall
        words = [find(x) for x in lines.column("line").to_pylist()]
        paths = lines.column("path").combine_chunks().dictionary_encode()
        self.paths, sizes = paths.dictionary, np.fromiter(map(len, words), np.int64, len(words))
        full = np.flatnonzero(sizes)
        file_of = paths.indices.to_numpy(zero_copy_only=False)[full]
        begins = np.searchsorted(file_of, file_of)  # the first line of each line's file
        owner = np.repeat(np.arange(len(full)), sizes[full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])])
        files, order = file_of[owner], (np.arange(len(full)) - begins)[owner]
        number = lines.column("line_no").to_numpy()[full][owner]
        n = max(len(owner) - width + 1, 0)
        start = np.flatnonzero(files[:n] == files[width - 1 :]) if n else np.zeros(0, np.int64)
        end = start + width - 1
        self.file, self.pos = files[start], start - starts[begins[owner[start]]] + 1
        self.first, self.last, self.o1, self.o2 = number[start], number[end], order[start], order[end]
        if not len(start):
            self.h1 = self.h2 = np.zeros(0, np.uint64)
            self.which = self.least = self.count = np.zeros(0, np.int64)
            return
        flat = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        digests = b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in flat.dictionary.to_pylist())
        each = np.frombuffer(digests, np.uint64).reshape(-1, 2)[flat.indices.to_numpy(zero_copy_only=False)]
        with np.errstate(over="ignore"):
            h1, h2 = (_sums(each[:, i], width, b)[start] for i, b in enumerate(BASES))
        by = np.lexsort((h2, h1))  # stable: of equal frames the first by path and place comes first
        new = np.append(True, (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1]))
        self.which = np.empty(len(by), np.int64)
        self.which[by] = np.cumsum(new) - 1
        self.least, self.count = by[new], np.diff(np.append(np.flatnonzero(new), len(by)))
        self.h1, self.h2 = h1[self.least], h2[self.least]


def distinct(token: str, width: int):
    """The distinct frames of a bucket: number, hashes, count and first place."""

    def make(key: tuple, lines: pa.Table) -> pa.Table:
        x = Frames(lines, token, width)
        place = {c: getattr(x, c)[x.least] for c in _PLACE}
        columns = {"bucket": np.full(len(x.least), key[0].as_py()), "at": np.arange(len(x.least)), "h1": x.h1.view(np.int64), "h2": x.h2.view(np.int64), "k": x.count}
        arrays = {c: pa.array(v, pa.int64()) for c, v in {**columns, **place}.items()}
        arrays["path"] = x.paths.take(pa.array(x.file[x.least]))
        return pa.table({c.split()[0]: arrays[c.split()[0]] for c in FRAMES.split(", ")})

    return make


def copies(token: str, width: int, size: int):
    """Blocks of a bucket's files that stand elsewhere first; firsts: the first place of each distinct frame that occurs twice or more, by number."""

    def make(lines: pa.Table, firsts: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in COPIES.split(", ")]
        empty = pa.table({c: pa.array([], pa.string() if c.startswith("path") else pa.int64()) for c in names})
        if not lines.num_rows or not firsts.num_rows:
            return empty
        x, at = Frames(lines, token, width), firsts.column("at").to_numpy()
        there = np.zeros(len(x.least), bool)
        there[at] = True
        a = {c: np.zeros(len(x.least), np.int64) for c in (*_PLACE, "path")}
        for c in _PLACE:
            a[c][at] = firsts.column(c).to_numpy()
        known = firsts.column("path").combine_chunks().dictionary_encode()
        a["path"][at] = known.indices.to_numpy(zero_copy_only=False)
        own = pc.index_in(x.paths, value_set=known.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        of = {c: v[x.which] for c, v in a.items()}
        off = x.pos - of["pos"]
        met = np.flatnonzero(there[x.which] & ((own[x.file] != of["path"]) | (off >= width)))
        if not len(met):
            return empty
        same = np.diff(met) == 1
        for c in (x.file, of["path"], off):
            same &= c[met][1:] == c[met][:-1]
        begin, end = met[np.append(True, ~same)], met[np.append(~same, True)]
        keep = np.maximum(of["o2"][end] - of["o1"][begin], x.o2[end] - x.o1[begin]) + 1 >= size
        begin, end = begin[keep], end[keep]
        return pa.table(
            [known.dictionary.take(pa.array(of["path"][begin])), of["first"][begin], of["last"][end], x.paths.take(pa.array(x.file[begin])), x.first[begin], x.last[end], end - begin + width],
            names=names,
        )

    return make
