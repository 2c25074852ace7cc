"""Substring deduplication on bytes: suffix order and common prefixes, built column by column for many texts at once.

A byte goes if a window of `window` bytes over it also starts anywhere else.

1. Equal texts are one row with a count. Each window selects the least of its gram hashes (winnowing), so equal windows
   select equal grams; neighbouring windows that select the gram at one place make a run. Runs whose gram is
   seen once can't recur and go no further. The others are cut out as pieces; equal pieces are one row with a count.
2. Pieces are dealt by gram into blocks of about BLOCK bytes. In each block the column-wise construction builds the
   collection's Burrows-Wheeler transform and common prefixes: all texts are read from their ends, each round
   inserts one symbol of every text, and places follow from the places of the round before. A symbol is SYMBOL bytes, and
   a piece stands for SYMBOL texts, one a phase, so every byte starts a suffix. A window recurs if the common
   prefix with a neighbour holds the whole window, or if its piece is counted twice. Hashes only choose blocks.
3. A gram with more than CROWD bytes of different pieces is dealt again by a second gram of the window, and what
   is still crowded by the whole windows; so no block grows with the data.
4. Recurring windows go back to their texts through (piece, text, place), and texts are cut.

The transform is kept by symbol: for each suffix, in order, its first symbol and the place of its rest. These
columns and the common prefixes are read and rewritten front to back each round. They are arrays of the task, as
a block's are a few MB; what lies between the steps is written to the shared folder.

Defined results: a null text has no bytes. Texts under `window` bytes lose nothing. Repeated rows count as often as
they stand, and each gets the same result. Cuts may fall inside a character, so what is kept is binary. Extra columns
stay, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, small, stored

WINDOW, SYMBOL = 200, 8
#: Gram lengths by level; the last is the window itself, so that its groups hold equal windows only.
GRAMS = (32, 32, None)
#: Bytes of pieces that one block holds (about a processor's cache in all its columns), and that one gram may have.
BLOCK, CROWD = 200_000, 400_000
#: Bytes of text that are hashed, and of pieces that are handed over, at a time.
SLICE = 1_000_000
HIGH = np.uint64(0xFFFFFFFF00000000)
ODD = 0x9E3779B97F4A7C15


_POWERS = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of ODD and of its inverse, n + 1 and more; kept by the process."""
    if len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (ODD, pow(ODD, -1, 1 << 64))]
    return _POWERS


def gram_hashes(data: np.ndarray, gram: int, seed: int) -> np.ndarray:
    """64-bit hash of each run of `gram` bytes."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64)
    power, back = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)])])
        x = (sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values, from running minima of blocks in both directions."""
    if width == 1:
        return keys
    n = len(keys)
    blocks = np.append(keys, np.full(-n % width, np.iinfo(np.uint64).max)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, start, number of windows, gram hash) of the runs of windows that select one gram; texts lie between offsets."""
    n = len(data) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= window)
    marks = np.zeros(n + 1, np.int8)
    np.add.at(marks, offsets[long], 1)
    np.add.at(marks, offsets[long] + lengths[long] - window + 1, -1)
    valid = np.cumsum(marks[:n], dtype=np.int8).astype(bool)
    hashes = gram_hashes(data, gram, seed)
    at = (least((hashes & HIGH) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1) & ~HIGH).astype(np.int64)
    new = valid & np.append(True, (at[1:] != at[:-1]) | ~valid[:-1])
    new[offsets[long]] = True
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(np.cumsum(valid)[begin] - 1, np.count_nonzero(valid)))
    text = np.searchsorted(offsets, begin, "right") - 1
    return text, begin - offsets[text], counts, hashes[at[begin]]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts one after another, and where each begins."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_table(texts: DataFrame, window: int, gram: int, seed: int) -> DataFrame:
    """(doc, n, gram, start, windows) of the runs of texts (doc, text, n)."""

    def make(batches):
        for b in (part for batch in batches for part in pieces(batch, limit=SLICE)):
            data, offsets = _bytes(b.column("text"))
            text, start, count, h = runs(data, offsets, window, gram, seed)
            if len(text):
                at = pa.array(text)
                columns = [b.column("doc").take(at), b.column("n").take(at), b.column("salt").take(at), pa.array(h.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "salt", "gram", "start", "windows"])

    made = texts.select("doc", "text", "n", "salt").mapInArrow(make, "doc binary, n long, salt long, gram long, start int, windows int")
    return made.select("doc", "n", F.xxhash64("salt", "gram").alias("gram"), "start", "windows")


def cut_out(chosen: DataFrame, window: int) -> DataFrame:
    """(doc, n, start, gram, piece) of the runs that stand in column `runs` of texts (doc, text, n)."""

    def make(batches):
        for part in (p for batch in batches for p in pieces(batch, limit=SLICE)):
            data, offsets = _bytes(part.column("text"))
            lists = part.column("runs")
            doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            rows = lists.flatten()
            size = rows.field("windows").to_numpy().astype(np.int64) + window - 1
            start = rows.field("start").to_numpy() + offsets[doc]
            slices = np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1
            edges = [0, *slices.tolist(), len(doc)]
            for a, z in zip(edges, edges[1:], strict=False):
                ends = np.concatenate([[0], np.cumsum(size[a:z])])
                where = np.arange(ends[-1]) + np.repeat(start[a:z] - ends[:-1], size[a:z])
                piece = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[where])])
                own = pa.array(doc[a:z])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(own), part.column("n").take(own), rows.field("start").slice(a, z - a), rows.field("gram").slice(a, z - a), piece],
                    names=["doc", "n", "start", "gram", "piece"],
                )

    return chosen.select("doc", "n", "text", "runs").mapInArrow(make, "doc binary, n long, start int, gram long, piece binary")


class Minima:
    """Least value of any range of an array: minima of all ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.table = np.empty((max(1, n.bit_length()), n), values.dtype)
        self.table[0] = values
        for k in range(1, len(self.table)):
            step = 1 << k - 1
            np.minimum(self.table[k - 1, : n - step], self.table[k - 1, step:], out=self.table[k, : n - step])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a .. b], both included, for each pair."""
        k = np.frexp(b - a + 1)[1] - 1
        return np.minimum(self.table[k, a], self.table[k, b + 1 - (1 << k)])


def recurring(data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """For each byte, whether the window that starts there (inside its text) also starts elsewhere in the collection."""
    whole = window // SYMBOL
    size = len(data)
    symbols = np.ndarray((size - SYMBOL + 1,), ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    _, code = np.unique(symbols, return_inverse=True)
    code = code.astype(np.int64) << 32
    # texts: one a phase; `left` is the byte at which the last inserted suffix of a text begins
    lengths = np.diff(offsets)
    phases = np.minimum(lengths, SYMBOL)
    text = np.repeat(np.arange(len(lengths)), phases)
    left = offsets[1:][text] - (np.arange(len(text)) - np.repeat(np.cumsum(phases) - phases, phases))
    begin = offsets[:-1][text]
    empties = len(left)
    place = np.arange(empties)  # of the last inserted suffix of each text; empty suffixes come first
    keys, common = np.zeros(0, np.int64), np.zeros(0, np.uint8)  # (symbol, place of the rest) and common prefix with the suffix before, in order
    active = np.arange(empties)
    while True:
        active = active[left[active] - SYMBOL >= begin[active]]
        if not len(active):
            break
        left[active] -= SYMBOL
        new = code[left[active]] | place[active]
        order = np.argsort(new)
        new = new[order]
        at = np.searchsorted(keys, new)
        inserted = at + np.arange(len(new))
        minima = Minima(common)
        n = len(keys) + len(new)
        # places move up by the suffixes inserted before them
        moved = np.concatenate([np.zeros(empties, np.int32), np.cumsum(np.bincount(at, minlength=len(keys) + 1), dtype=np.int32)])
        old = np.ones(n, bool)
        old[inserted] = False
        merged, prefixes = np.empty(n, np.int64), np.empty(n, np.uint8)
        merged[inserted], merged[old], prefixes[old] = new, keys, common
        after = inserted + 1
        touched = np.concatenate([inserted, after[after < n][old[after[after < n]]]])
        before = merged[np.maximum(touched - 1, 0)]
        same = (touched > 0) & (before >> 32 == merged[touched] >> 32)
        prefixes[touched] = 0
        there = touched[same]
        # rests that are empty share nothing; the others' common prefix is the least between their places
        a, b = (before[same] & 0xFFFFFFFF) - empties, (merged[there] & 0xFFFFFFFF) - empties
        shared = a >= 0
        prefixes[there] = 1
        prefixes[there[shared]] = np.minimum(minima(a[shared] + 1, b[shared]) + 1, whole)
        merged += moved[merged & 0xFFFFFFFF]
        keys, common = merged, prefixes
        place[active[order]] = empties + inserted
    hit = common >= whole
    hit[:-1] |= hit[1:]
    out = np.zeros(size, bool)
    longer = np.full(empties + len(keys) + 1, -1, np.int64)
    longer[keys & 0xFFFFFFFF] = empties + np.arange(len(keys))
    now, left = np.arange(empties), offsets[1:][text] - (np.arange(len(text)) - np.repeat(np.cumsum(phases) - phases, phases))
    while len(now):  # from each empty suffix to the longer ones of its text
        now = longer[now]
        now, left = now[now >= 0], left[now >= 0] - SYMBOL
        out[left] = hit[now - empties]
    return out


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def solve(window: int):
    """Of one block of pieces (name, piece, n): (name, a, b) of the stretches of windows that recur."""

    def make(block: pa.Table) -> pa.Table:
        data, offsets = _bytes(block.column("piece"))
        hit = recurring(data, offsets, window)
        valid = np.zeros(len(data) + 1, np.int64)
        lengths = np.diff(offsets)
        np.add.at(valid, offsets[:-1], 1)
        np.add.at(valid, offsets[:-1] + lengths - window + 1, -1)
        inside = np.cumsum(valid[:-1]) > 0
        twice = np.repeat(block.column("n").to_numpy() > 1, lengths)
        # a stretch ends before the next piece: the last window - 1 bytes of a piece start none
        a, b = spans_of(inside & (hit | twice))
        own = np.searchsorted(offsets, a, "right") - 1
        return pa.table([block.column("name").take(pa.array(own)), pa.array((a - offsets[own]).astype(np.int32)), pa.array((b - offsets[own]).astype(np.int32))], names=["name", "a", "b"])

    return make


def covered(texts: DataFrame, window: int, level: int = 0) -> DataFrame:
    """(doc, a, b): stretches of windows of texts (doc, text, n, salt) that recur; doc names a text."""
    gram = GRAMS[level] or window
    table = stored(run_table(texts, window, min(gram, window), level), "runs")
    seen = table.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    chosen = table.join(seen, "gram", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "gram")).alias("runs"))
    cut = cut_out(texts.join(chosen, "doc"), window).withColumn("name", F.unhex(F.md5("piece")))
    cut = stored(cut.select("doc", "n", "start", "gram", "name", "piece"), "cut")
    discard(table)
    alike = stored(cut.groupBy("gram", "name", "piece").agg(F.sum("n").alias("n")), "pieces")
    sizes = alike.groupBy("gram").agg(F.sum(F.octet_length("piece")).alias("size"))
    crowded = stored(sizes.filter(F.col("size") > CROWD).select("gram"), "crowded")
    some = level + 1 < len(GRAMS) and not crowded.isEmpty()
    calm = alike.join(small(crowded), "gram", "left_anti") if some else alike
    total = calm.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    dealt = calm.select("name", "piece", "n", F.pmod(F.xxhash64("gram", F.lit("block")), F.lit(-(-total // BLOCK) or 1)).alias("block"))
    found = stored(dealt.groupBy("block").applyInArrow(solve(window), "name binary, a int, b int"), "found")
    if some:
        again = alike.join(small(crowded), "gram", "left_semi").select(F.col("name").alias("doc"), F.col("piece").alias("text"), "n", F.col("gram").alias("salt"))
        found = found.unionByName(covered(again, window, level + 1).withColumnRenamed("doc", "name"))
    discard(alike, crowded)
    back = cut.select("doc", "start", "name").join(found, "name")
    return stored(back.select("doc", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")), "spans")


def cut_texts(texts: DataFrame, window: int, with_kept: bool) -> DataFrame:
    """(doc, n_removed, n_spans, kept_sha256, kept) of texts (doc, text, spans)."""

    def make(batches):
        for part in (p for batch in batches for p in pieces(batch, limit=SLICE)):
            data, offsets = _bytes(part.column("text"))
            spans = part.column("spans")
            doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            a, b = (flat.field(k).to_numpy().astype(np.int64) + offsets[doc] for k in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, b, doc = a[order], np.maximum.accumulate(b[order] + window - 1), doc[order]  # texts lie one after another
            new = np.append(True, (a[1:] > b[:-1]) | (doc[1:] != doc[:-1]))
            first = np.flatnonzero(new)
            begin, end, own = a[first], b[np.append(first[1:] - 1, len(b) - 1)], doc[first]
            removed = np.bincount(own, end - begin, part.num_rows).astype(np.int64)
            count = np.bincount(own, minlength=part.num_rows)
            cuts, at, digests, kept = np.cumsum(np.append(0, count)), memoryview(data), [], []
            for i in range(part.num_rows):
                edges = [offsets[i], *np.stack([begin, end], 1)[cuts[i] : cuts[i + 1]].reshape(-1).tolist(), offsets[i + 1]]
                left = [at[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                digest = hashlib.sha256()
                for x in left:
                    digest.update(x)
                digests.append(digest.hexdigest())
                kept.append(b"".join(left) if with_kept else None)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(removed), pa.array(count), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("doc", "text", "spans").mapInArrow(make, "doc binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_bytes(docs: DataFrame, window: int = WINDOW, text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary); other columns of these names go."""
    if window % SYMBOL:
        raise ValueError(f"window must be a multiple of {SYMBOL} bytes")
    aside = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    body = F.coalesce(F.col(aside[text_col]), F.lit(""))
    rows = docs.toDF(*aside.values()).withColumns({"doc": F.unhex(F.md5(body)), "bytes": F.octet_length(body).cast("bigint"), "digest": F.sha2(body, 256), "body": body.cast("binary")})
    alike = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") >= window).groupBy("text").agg(F.count("*").alias("n"))
    texts = stored(alike.select(F.unhex(F.md5("text")).alias("doc"), "text", "n", F.lit(0).cast("long").alias("salt")), "texts")
    spans = covered(texts, window).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    done = stored(cut_texts(texts.join(spans, "doc"), window, with_kept), "cut-texts")
    discard(texts)
    zero = F.lit(0).cast("bigint")
    made = {"n_bytes": F.col("bytes"), "n_removed": F.coalesce("n_removed", zero), "n_spans": F.coalesce("n_spans", zero), "kept_sha256": F.coalesce("kept_sha256", "digest")}
    if with_kept:
        made["kept"] = F.coalesce("kept", "body")
    own = [F.col(safe).alias(c) for c, safe in aside.items() if c == text_col or c not in made]
    return rows.join(done, "doc", "left").select(*own, *(c.alias(n) for n, c in made.items() if n != text_col))
