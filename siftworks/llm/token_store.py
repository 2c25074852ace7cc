"""Token ids in files: static range asymmetric numeral systems over one shared frequency table.

Layout, under one folder:
  table/   (id, freq): frequencies of the ids in the whole corpus, scaled to 2**SCALE in all.
  blocks/  one row a block: part, block, start (ids of the part before it), n_tokens, doc_ids, lengths,
           payload (32-bit words), words, states (lane states at checkpoints), places, crc.
A part is a range of document ids; parts, their blocks and the documents in them ascend by doc_id. A block
ends with a document once it holds BLOCK ids, so only a document longer than that makes a larger one.
In a block, id i belongs to lane i % LANES. Every EVERY steps a checkpoint keeps all lane states and the
place in the payload, so a reader can begin at any of them; `crc` guards the block's ids.

Each task holds one block and one batch of texts. Null texts are empty: only the end id. Repeated ids are
stored each, ordered by text digest; a null doc_id comes first. An empty table gives no blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordEncoder
from .common import bucket_count, pieces, shared_folder, stored

SCALE, BLOCK, LANES, EVERY, END = 20, 1 << 19, 4096, 64, 1
LOW = 1 << 31
#: Parts of which the ids are summed together first.
GROUP = 1000
#: Distinct words that a Python worker remembers here; a task holds little else.
CACHE_WORDS = 1_500_000
RAW = "part long, block long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary"
FILE = "part long, block long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary, states binary, places array<long>, crc long"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 for every counted id, 2**SCALE in all; the most frequent id takes the rest."""
    counts = counts.astype(np.float64)
    used = int((counts > 0).sum())
    freq = np.where(counts > 0, 1 + np.floor(counts * ((1 << SCALE) - used) / max(counts.sum(), 1)), 0).astype(np.int64)
    freq[int(counts.argmax())] += (1 << SCALE) - int(freq.sum())
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks of ids with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)[:-1]
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))
        self.filler = int(freq.argmax())

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[int]]:
        """Payload, states at checkpoints (the first is the block's begin) and their places in the payload."""
        steps = -(-len(ids) // LANES)
        grid = np.full(steps * LANES, self.filler, np.uint16)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, LANES)
        x, out, states, marks, made = np.full(LANES, LOW, np.uint64), [], [], [], 0
        for s in range(steps - 1, -1, -1):
            f = self.freq[grid[s]]
            full = x >= f << np.uint64(63 - SCALE)
            if full.any():
                w = x[full]
                out.append((w & np.uint64(0xFFFFFFFF)).astype("<u4"))
                made += len(w)
                x[full] = w >> np.uint64(32)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + self.cum[grid[s]]
            if s % EVERY == 0:
                states.append(x.astype("<u8"))
                marks.append(made)
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        return words.tobytes(), b"".join(a.tobytes() for a in reversed(states)), [made - m for m in reversed(marks)]

    def segment(self, payload: bytes, states: bytes, places: list[int], k: int, n: int) -> np.ndarray:
        """Ids from checkpoint k to the next, of a block of n."""
        words = np.frombuffer(payload, "<u4").astype(np.uint64)
        x = np.frombuffer(states, "<u8", LANES, 8 * LANES * k).astype(np.uint64)
        at, first = places[k], k * EVERY
        last = min(first + EVERY, -(-n // LANES))
        grid, mask = np.empty((last - first, LANES), np.uint16), np.uint64((1 << SCALE) - 1)
        for s in range(last - first):
            slot = x & mask
            sym = self.symbol[slot]
            grid[s] = sym
            x = self.freq[sym] * (x >> np.uint64(SCALE)) + slot - self.cum[sym]
            low = x < LOW
            if c := int(np.count_nonzero(low)):
                x[low] = (x[low] << np.uint64(32)) | words[at : at + c]
                at += c
        return grid.reshape(-1)[: n - first * LANES]

    def decode(self, payload: bytes, states: bytes, places: list[int], n: int) -> np.ndarray:
        return np.concatenate([self.segment(payload, states, places, k, n) for k in range(len(places))] or [np.zeros(0, np.uint16)])


def raw_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of ids in ascending doc_id order, each document followed by END."""
    parts = bucket_count(docs)
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def make(batches):
        encoder, part, block, start = WordEncoder.of(path, CACHE_WORDS), TaskContext.get().partitionId(), 0, 0
        end = np.array([END], "<u2").tobytes()
        names, sizes, held, n = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "n_tokens": n, "doc_ids": names, "lengths": sizes, "ids": b"".join(held)}], SCHEMA)

        for b in (x for batch in batches for x in pieces(batch)):
            for i, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                names.append(i)
                sizes.append(len(ids) // 2 + 1)
                held += (ids, end)
                n += sizes[-1]
                if n >= BLOCK:
                    yield row()
                    block, start, names, sizes, held, n = block + 1, start + n, [], [], [], 0
        if names:
            yield row()

    return ordered.mapInArrow(make, RAW)


SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("part", "block", "start", "n_tokens")] + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())]
)


def id_counts(raw: DataFrame) -> DataFrame:
    """(id, n) over all blocks; each task sends at most one row an id."""

    def make(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return raw.select("ids").mapInArrow(make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def load_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The shared table: at most 2**16 rows, whatever the corpus."""
    freq = np.zeros(1 << 16, np.uint64)
    for r in spark.read.schema("id long, freq long").parquet(f"{folder}/table").collect():
        freq[r.id] = r.freq
    return freq


def write_tokens(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Writes the files for `docs` (doc_id, text) with the vocabulary at `path`; returns their folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    raw = stored(raw_blocks(docs, path), "raw-blocks")
    counts = np.zeros(1 << 16, np.int64)
    for r in id_counts(raw).collect():
        counts[r.id] = r.n
    freq = scaled(counts) if counts.any() else counts.astype(np.uint64)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(freq)

    def make(batches):
        coder = Coder(table.value)
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r.pop("ids"), "<u2")
                payload, states, places = coder.encode(ids)
                yield pa.RecordBatch.from_pylist([r | {"payload": payload, "states": states, "places": places, "crc": zlib.crc32(ids)}], OUT)

    raw.mapInArrow(make, FILE).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


OUT = pa.schema([*[f for f in SCHEMA if f.name != "ids"], ("payload", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("crc", pa.int64())])


def ids_before(blocks: DataFrame) -> DataFrame:
    """(part, before): ids of all parts before it. Sums by GROUP parts first, so that no window holds all parts."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("group", F.floor(F.col("part") / GROUP))
    groups = totals.groupBy("group").agg(F.sum("total").alias("all"))
    groups = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("base"))
    inside = F.sum("total").over(Window.partitionBy("group").orderBy("part")) - F.col("total")
    return totals.withColumn("inside", inside).join(groups, "group").select("part", (F.col("base") + F.col("inside")).alias("before"))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and, unless switched off, ids (32-bit, little-endian).

    A block whose ids don't have its checksum fails the read.
    """
    blocks = spark.read.schema(FILE).parquet(f"{folder}/blocks")
    before = ids_before(blocks)
    freq = load_table(spark, folder)
    table = spark.sparkContext.broadcast(freq)
    fields = [("doc_id", pa.int64()), ("part", pa.int64()), ("in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def make(batches):
        coder = Coder(table.value)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r["payload"], r["states"], r["places"], r["n_tokens"])
                if zlib.crc32(ids.astype("<u2")) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                wide, size = memoryview(ids.astype("<u4").tobytes()), np.array(r["lengths"], np.int64)
                at = np.cumsum(size) - size
                cut = [wide[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [r["doc_ids"], [r["part"]] * len(at), at + r["start"], size, [zlib.crc32(x) for x in cut]]
                arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([bytes(x) for x in cut], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    types = "doc_id long, part long, in_part long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.mapInArrow(make, types).join(before, "part")
    return rows.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
