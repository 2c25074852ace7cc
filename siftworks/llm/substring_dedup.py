"""Substring deduplication with repeated-phrase automata.

A window is `window` consecutive words; a word goes if a window over it recurs anywhere in the corpus.

1. Fingerprints: in each window the least of its GRAM-word hashes is selected (winnowing). Equal windows
   select equal grams, so only windows whose selected gram recurs can recur. Neighbouring windows that
   select the gram at one place make a run, named by the hash of all its words.
2. Confirmation: the bucket that speaks for a run sends its words and, where runs of one gram differ, the
   128-bit hashes of its windows. A run that recurs is a passage as a whole; of the others, the stretches
   of windows that are counted twice or more are passages. Passages are text from here on.
3. Automata: a bucket of documents gets the passages whose fingerprints it holds, compiles them into its
   shard, one Aho-Corasick automaton over word numbers, and streams its documents through it, but for stretches
   that hold a gram of no passage. Only what the automaton finds is removed; the hashes merely choose the shards
   that a passage goes to and the stretches that are read.

Every occurrence is found: a recurring window lies in some run of its bucket, and that run's stretches, which
stand there as a whole, are patterns of the shard.

Counts are combined by bucket before any shuffle, so a passage in a third of all documents is one row a
bucket. Every Python task holds one bucket of about BUCKET_BYTES of text; a single document isn't split.
Lost executors only cost their own tasks: all state is in shuffles or in the shared folder.

Null text: no words, comes back as null. Texts under `window` words lose nothing. Repeated rows count as
often as they stand. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bucket_count, discard, free_name, pieces, stored

WINDOW, GRAM = 35, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers of the two window hashes and of the gram hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _sums(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of `width` values, by doubling; mixed at the end."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        if not len(out):
            return out
        power, size, done = h, 1, 0
        step = base
        while True:
            if width & size:
                out = out * np.uint64(step) + power[done : done + len(out)]
                done += size
            if size * 2 > width:
                break
            power = power[:-size] * np.uint64(step) + power[size:]
            step, size = step * step & 0xFFFFFFFFFFFFFFFF, size * 2
        return _mixed(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every run of `width` values, by doubling."""
    at, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        size += step
    return at


class Batch:
    """Word hashes of some texts in one row, with the places where windows start."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = pa.array([x for w in self.words for x in w], pa.binary()).dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        each = np.fromiter((xxhash.xxh64_intdigest(x) for x in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
        self.codes = codes
        self.hashes = each[codes] if len(codes) else np.zeros(0, np.uint64)
        n = max(len(self.hashes) - window + 1, 0)
        own = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = np.zeros(n, bool) if not n else own[:n] == own[window - 1 :]

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(fp, run, first start, number of windows) of the runs of windows that select one gram."""
        none = np.zeros(0, np.int64)
        if not self.starts.any():
            return none.view(np.uint64), none.view(np.uint64), none, none
        grams = _sums(self.hashes, GRAM, BASES[2])
        least = _least(grams, window - GRAM + 1)
        new = self.starts & np.append(True, (least[1:] != least[:-1]) | ~self.starts[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(np.cumsum(self.starts)[begin] - 1, np.count_nonzero(self.starts)))
        power, back = (np.full(len(self.hashes), x, np.uint64) for x in (BASES[0], pow(BASES[0], -1, 1 << 64)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * np.cumprod(power))])
            run = (sums[begin + n - 1 + window] - sums[begin]) * np.cumprod(back)[begin] + n.astype(np.uint64)
        return grams[least[begin]], _mixed(run), begin, n


def _counted(columns: list[np.ndarray], names: list[str], bucket: np.ndarray) -> pa.RecordBatch:
    """Rows (columns, bucket, n) of distinct values."""
    keys = pa.table([pa.array(c.view(np.int64)) for c in columns] + [pa.array(bucket)], names=[*names, "_bucket"])
    out = keys.group_by([*names, "_bucket"]).aggregate([([], "count_all")]).rename_columns([*names, "_bucket", "n"])
    return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], out.schema)


def fingerprints(dealt: DataFrame, window: int) -> DataFrame:
    """(fp, run, bucket, n) of the runs of every document, combined within batches."""

    def make(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            buckets = b.column("_bucket").to_numpy()
            x = Batch(b.column("text").to_pylist(), window)
            fp, run, begin, _ = x.runs(window)
            if len(fp):
                yield _counted([fp, run], ["fp", "run"], buckets[np.searchsorted(x.begins, begin, "right") - 1])

    return dealt.select("text", "_bucket").mapInArrow(make, "fp long, run long, _bucket long, n long")


def recurring_runs(counted: DataFrame) -> DataFrame:
    """(fp, run, bucket, speaks, whole, weight) of the runs whose gram occurs twice or more, for each bucket that has them.

    whole: the run recurs. weight: 0 if it is the only run of its gram, else what each of its windows counts for.
    Grams and runs are counted by partial sums and joined back, so a gram of a third of all documents isn't one task.
    """
    grams = counted.groupBy("fp").agg(F.sum("n").alias("n_fp"), (F.min("run") != F.max("run")).alias("several")).filter("n_fp > 1")
    per = stored(counted.join(grams.select("fp", "several"), "fp").groupBy("fp", "run", "_bucket").agg(F.sum("n").alias("n"), F.any_value("several").alias("several")), "run-counts")
    totals = per.groupBy("fp", "run").agg(F.sum("n").alias("n_run"), F.min("_bucket").alias("speaker"))
    weight = F.when(F.col("several"), F.least("n_run", F.lit(2))).otherwise(0)
    both = per.join(totals, ["fp", "run"])
    runs = both.select("fp", "run", "_bucket", (F.col("_bucket") == F.col("speaker")).alias("speaks"), (F.col("n_run") > 1).alias("whole"), weight.cast("long").alias("weight"))
    runs = stored(runs, "runs")
    discard(per)
    return runs


def passages_of(runs: DataFrame, spoken: DataFrame) -> DataFrame:
    """(bucket, words, good) for each bucket: the words of its runs and, unless the whole run recurs, the places of its recurring windows."""
    windows = spoken.filter("weight > 0").select("fp", "run", "whole", "weight", F.posexplode("hashes").alias("at", "h")).select("fp", "run", "whole", "weight", "at", "h.*")
    twice = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("total")).filter("total > 1").select("h1", "h2")
    good = windows.filter("NOT whole").join(twice, ["h1", "h2"]).groupBy("fp", "run").agg(F.collect_list("at").alias("good"))
    good = stored(good, "recurring-windows")  # the shuffles of single windows go before the documents are dealt out again
    texts = spoken.select("fp", "run", "words", "whole").join(good, ["fp", "run"], "left").filter("whole OR good IS NOT NULL")
    return runs.select("fp", "run", "_bucket").join(texts, ["fp", "run"]).select("_bucket", "words", "good")


def _key(fp: np.ndarray, run: np.ndarray) -> np.ndarray:
    return _mixed(fp ^ _mixed(run))


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All starts of runs."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


SPOKEN = "fp long, run long, whole boolean, weight long, words binary, hashes array<struct<h1: long, h2: long>>"


def _speak(window: int):
    pair = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
    schema = pa.schema([("fp", pa.int64()), ("run", pa.int64()), ("whole", pa.bool_()), ("weight", pa.int64()), ("words", pa.binary()), ("hashes", pa.list_(pair))])

    def make(docs: pa.Table, runs: pa.Table) -> pa.Table:
        """Words of the runs that the bucket speaks for, and the hashes of their windows where those are counted."""
        if not runs.num_rows or not docs.num_rows:
            return schema.empty_table()
        key = _key(*(runs.column(c).to_numpy().view(np.uint64) for c in ("fp", "run")))
        order = np.argsort(key)
        key, runs = key[order], runs.take(pa.array(order))
        x = Batch(docs.column("text").to_pylist(), window)
        fp, run, begin, n = x.runs(window)
        mine = _key(fp, run)
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        hit = np.flatnonzero(key[at] == mine)
        row, first = np.unique(at[hit], return_index=True)
        hit, runs = hit[first], runs.take(pa.array(row))
        begin, n = begin[hit], n[hit]
        doc = np.searchsorted(x.begins, begin, "right") - 1
        inside = begin - x.begins[doc]
        words = [b" ".join(x.words[d][i : i + k + window - 1]) for d, i, k in zip(doc.tolist(), inside.tolist(), n.tolist(), strict=True)]
        counted = np.where(runs.column("weight").to_numpy() > 0, n, 0)
        starts = _spread(begin, counted)
        hashes = pa.StructArray.from_arrays([pa.array(_sums(x.hashes, window, b)[starts].view(np.int64)) for b in BASES[:2]], fields=list(pair))
        ends = np.concatenate([[0], np.cumsum(counted)]).astype(np.int32)
        columns = [runs.column(c) for c in ("fp", "run", "whole", "weight")]
        return pa.table([*columns, pa.array(words, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), hashes)], schema=schema)

    return make


def shard(passages: pa.Table, numbers: pa.Array, window: int) -> ahocorasick.Automaton:
    """The automaton over the stretches of passages; numbers: the words of the documents, by number.

    A passage with a word that no document has can't occur.
    """
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    split = pc.split_pattern(pa.concat_arrays([pa.array([], pa.binary()), *passages.column("words").chunks]), " ")
    codes = pc.index_in(split.flatten(), value_set=numbers).fill_null(-1).to_numpy(zero_copy_only=False)
    ends, absent = split.offsets.to_numpy(), np.concatenate([[0], np.cumsum(codes < 0)])
    for a, b, good in zip(ends[:-1].tolist(), ends[1:].tolist(), passages.column("good").to_pylist(), strict=True):
        if good is None:
            stretches = [(a, b)]
        else:
            starts = np.sort(np.array(good)) + a
            stretches = [(int(r[0]), int(r[-1]) + window) for r in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)]
        for i, j in stretches:
            if absent[i] == absent[j]:
                machine.add_word(tuple(codes[i:j].tolist()))
    machine.make_automaton()
    return machine


def _grams(codes: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each place on, and whether they stand in one text; own: the text of each word."""
    grams = _sums(_mixed(codes.astype(np.uint64)), size, BASES[2])
    return grams, own[: len(grams)] == own[len(own) - len(grams) :]


def stretches(codes: np.ndarray, own: np.ndarray, passages: pa.Table, numbers: pa.Array, window: int) -> list[tuple[int, int]]:
    """Places (begin, end) of `window` words and more, all of whose grams stand in passages: no occurrence lies elsewhere."""
    size = min(GRAM, window)
    split = pc.split_pattern(pa.concat_arrays([pa.array([], pa.binary()), *passages.column("words").chunks]), " ")
    said = pc.index_in(split.flatten(), value_set=numbers).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    grams, inside = _grams(said, np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy())), size)
    known = np.unique(grams[inside])
    grams, inside = _grams(codes.astype(np.int64), own, size)
    if not len(known) or not len(grams):
        return []
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    held = np.concatenate([[False], (known[at] == grams) & inside, [False]])
    begin, end = np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(held[:-1] & ~held[1:])
    long = end - begin >= window - size + 1
    return list(zip(begin[long].tolist(), (end[long] + size - 1).tolist(), strict=True))


def covered(texts: list[list[bytes]], passages: pa.Table, window: int) -> list[np.ndarray | None]:
    """Of each text (its words), which words lie under an occurrence of a pattern; None if there is none.

    The automaton's root has an edge for each first word of a pattern, which makes a word that fits nothing dear, so it
    reads the stretches only whose grams all stand in passages.
    """
    flat = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
    out: list[np.ndarray | None] = [None] * len(texts)
    codes, sizes = flat.indices.to_numpy(zero_copy_only=False), [len(w) for w in texts]
    parts = stretches(codes, np.repeat(np.arange(len(texts)), sizes), passages, flat.dictionary, window)
    machine = shard(passages, flat.dictionary, window) if parts else ()
    if not len(machine):
        return out
    edge = np.zeros(len(codes) + 1, np.int64)
    for begin, end in parts:
        hits = np.fromiter(chain.from_iterable(machine.iter(tuple(codes[begin:end].tolist()))), np.int64).reshape(-1, 2)
        last, size = hits[:, 0], hits[:, 1]
        edge[begin : end + 1] += np.bincount(last - size + 1, minlength=end - begin + 1) - np.bincount(last + 1, minlength=end - begin + 1)
    cover, begin = np.cumsum(edge[:-1]) > 0, 0
    for d, n in enumerate(sizes):
        mine = cover[begin : begin + n]
        if mine.any():
            out[d] = mine
        begin += n
    return out


def _locate(window: int, out: pa.Schema):
    def make(docs: pa.Table, passages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        texts = docs.column("text").to_pylist()
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        covers = covered(words, passages, window) if passages.num_rows else [None] * len(texts)
        digests, kept_texts, removed = [], [], []
        for t, w, c in zip(texts, words, covers, strict=True):
            left = w if c is None else [a for a, k in zip(w, c.tolist(), strict=True) if not k]
            removed.append(len(w) - len(left))
            if "kept_sha256" in out.names:
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            if "kept_text" in out.names:
                kept_texts.append(t if c is None else _cut(t, c))
        made = {
            "n_words": lambda: pa.array([len(w) for w in words], pa.int64()),
            "n_removed": lambda: pa.array(removed, pa.int64()),
            "kept_sha256": lambda: pa.array(digests, pa.string()),
            "kept_text": lambda: pa.array(kept_texts, pa.string()),
        }
        return pa.table([made[f.name]() if f.name in made else docs.column(f.name) for f in out], names=out.names).cast(out)

    return make


def _cut(text: str, cover: np.ndarray) -> str:
    """The text without the covered words; each takes the white space after it along."""
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    spans = [m.span() for m in WORD.finditer(raw)]
    for i in np.flatnonzero(cover):
        begin, end = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(raw)
        out.append(raw[last:begin])
        last = end
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass").rstrip(" \t\n\r\x0b\x0c")


RESULTS = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}


def dedup_substrings(docs: DataFrame, window: int = WINDOW, results: tuple[str, ...] = tuple(RESULTS), with_text: bool = True) -> DataFrame:
    """`docs` (doc_id, text, more columns) with the results asked for; without text, unless switched on.

    kept_sha256 is of the kept words joined by one space. Columns of those names are replaced. Buckets have about
    BUCKET_BYTES of text and a partition each on average, whatever the size of the table.
    """
    docs = docs.drop(*RESULTS)
    n, bucket = bucket_count(docs), free_name(docs, "_bucket")
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    counted = stored(fingerprints(docs.select("text", number.alias("_bucket")), window), "fingerprints")
    runs = recurring_runs(counted)
    discard(counted)
    # Both passes read the same columns, so that the documents are dealt out once.
    dealt = docs.withColumn(bucket, number).repartition(n, bucket)
    speakers = runs.filter("speaks").groupBy("_bucket")
    spoken = stored(dealt.groupBy(bucket).cogroup(speakers).applyInArrow(_speak(window), SPOKEN), "spoken")
    passages = passages_of(runs, spoken)
    schema = T.StructType([f for f in dealt.schema.fields if f.name not in ("text", bucket) or (with_text and f.name == "text")])
    for name in results:
        schema = schema.add(name, RESULTS[name])
    return dealt.groupBy(bucket).cogroup(passages.groupBy("_bucket")).applyInArrow(_locate(window, to_arrow_schema(schema)), schema)
