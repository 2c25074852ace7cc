"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh
transform); the nearest signed axis is the hash. A table takes the hashes of HASHES rotations together.
Queries probe the home bucket and those next to it (the runner-up axes, by the squared loss of taking
them). Candidates are joined by (table, bucket) and ranked again by the exact inner product of the original vectors in double
precision. Where a query has found fewer than `k` candidates, it is compared with every vector, in blocks.

HASHES is 1 (two buckets an axis), the setting that moves the fewest probes; README has the recall and the share of
vectors that a query meets. Vectors are shuffled once a table. Of equal vectors only the k + 1 least ids take part: no
answer holds more of them. The rows of each bucket are counted, and a bucket with more than a block (BLOCK_VALUES
components) is dealt by row hash over ceil(count / block) salts, its queries likewise; each block of vectors meets each
block of queries, so no task holds more than about two blocks, whatever a bucket holds. Each task keeps the best `k` of a query before
they meet. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id and
vectors of another length than most usable rows have (of two such lengths the smaller one counts). Repeated ids
are vectors of their own; a query never meets rows of its own id. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, stored

TABLES, HASHES, PROBES, SEED = 16, 1, 8, 20240229
#: Vector components that one block holds, and scores that are computed at a time.
BLOCK_VALUES, BLOCK_SCORES = 4_000_000, 8_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    h, n = 1, x.shape[1]
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, table: int, j: int) -> np.ndarray:
    """Pseudo-rotation number j of a table: H D3 H D2 H D1, D of random signs."""
    n = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([SEED, table, j])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def axes(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` nearest signed axes of each row, nearest first, and how much each loses against the first."""
    size = np.abs(x)
    at = np.argsort(-size, axis=1, kind="stable")[:, :count]
    value = np.take_along_axis(x, at, 1)
    best = np.abs(value)
    return 2 * at + (value < 0), (best[:, :1] - best) ** 2


def buckets(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Bucket numbers of each row in one table, the home bucket first."""
    keys, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for j in range(HASHES):
        axis, loss = axes(rotations(x, table, j), min(probes, x.shape[1]))
        base = 4 * (1 << max(1, int(x.shape[1] - 1).bit_length()))
        keys = (keys[:, :, None] * base + axis[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        keys, cost = np.take_along_axis(keys, order, 1), np.take_along_axis(cost, order, 1)
    return keys


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def usual_length(v: DataFrame) -> int:
    """The most frequent number of components."""
    most = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most.n if most else 0


def least_of_equal(v: DataFrame, count: int) -> DataFrame:
    """Distinct (id, vec), of each vector the `count` least ids; first within eight shares of the ids, so that no class meets in one task."""
    shares = v.distinct().withColumn("share", F.pmod(F.xxhash64("id"), F.lit(8)))
    for keys in (["vec", "share"], ["vec"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        shares = shares.withColumn("place", place).filter(F.col("place") <= count).drop("place")
    return shares.select("id", "vec")


def hashed(v: DataFrame, probes: int) -> DataFrame:
    """(id, vec, keys): the bucket of each table and probe, as one number."""

    def make(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = np.concatenate([buckets(x, t, probes) * TABLES + t for t in range(TABLES)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), lists], names=["id", "vec", "keys"])

    return v.mapInArrow(make, f"id long, vec {dict(v.dtypes)['vec']}, keys array<long>")


def blocks_of(rows: DataFrame, block: int, name: str) -> DataFrame:
    """(key, name): the buckets with more rows than a block, and into how many blocks they are dealt."""
    sizes = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / block).alias(name))
    return F.broadcast(kept(sizes.filter(F.col(name) > 1)))


def dealt(home: DataFrame, probe: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries as rows of (id, vec, key, salt, part): each block of a bucket's vectors meets each block of its queries once."""
    salts, parts = blocks_of(home, block, "salts"), blocks_of(probe, block, "parts")

    def rows(df: DataFrame, own: str, of: str, other: str, to: str) -> DataFrame:
        each = df.select("id", "vec", F.xxhash64("id", "vec").alias("h"), F.explode("keys").alias("key")).join(salts, "key", "left").join(parts, "key", "left")
        mine = F.pmod("h", F.coalesce(F.col(of), F.lit(1)))
        return each.select("id", "vec", "key", mine.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(to), F.lit(1)) - 1)).alias(other))

    return rows(home, "salt", "salts", "part", "parts"), rows(probe, "part", "parts", "salt", "salts").select("id", "vec", "key", "salt", "part")


def _best(k: int):
    """Of one block of vectors and one of queries: the best k rows of each query, by blocks of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def make(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        q, x = _matrix(queries.column("vec")), _matrix(rows.column("vec"))
        qid, xid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        out, step = [], max(1, min(256, BLOCK_SCORES // len(x)))
        for a in range(0, len(q), step):
            score = np.einsum("id,jd->ij", q[a : a + step], x)
            score[qid[a : a + step, None] == xid[None, :]] = -np.inf
            for i, s in enumerate(score):
                at = np.lexsort((xid, -s))[:k] if len(s) <= 4 * k else _top(s, xid, k)
                at = at[s[at] > -np.inf]
                out.append((np.full(len(at), qid[a + i]), xid[at], s[at]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return make


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(s, -k)[-k]
    at = np.flatnonzero(s >= least)
    return at[np.lexsort((ids[at], -s[at]))][:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query by inner product; ties to the smaller id."""
    v, q = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    same = F.size("vec") == usual_length(v)
    v, q = least_of_equal(v.filter(same), k + 1), q.filter(same).distinct()
    home, probe = stored(hashed(v, 1), "vectors"), stored(hashed(q, PROBES), "probes")
    v, q = home.select("id", "vec"), probe.select("id", "vec")
    count, size = home.agg(F.count("*"), F.max(F.size("vec"))).first()
    block = max(1, BLOCK_VALUES // (size or 1))
    mine, theirs = dealt(home, probe, block)
    key = ["key", "salt", "part"]
    pairs = theirs.groupBy(*key).cogroup(mine.groupBy(*key)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    met = stored(pairs.distinct(), "candidates")
    few = q.join(met.groupBy(F.col("query_id").alias("id")).agg(F.countDistinct("vec_id").alias("n")), "id", "left").filter(f"coalesce(n, 0) < {k}").select("id", "vec")
    few = kept(few)
    if not few.isEmpty():
        n = max(4 * int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // block))
        every = v.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(n)))
        blocks = few.count() // 1000 + 1
        for b in range(blocks):
            some = few.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)) == b)
            spread = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            met = met.unionByName(spread.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(_best(k), "query_id long, vec_id long, score double"))
        met = met.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
