"""MinHash near-deduplication with DartMinHash signatures.

Documents are weighted sets of five-word shingles. Darts are thrown at each element's region, weight by
rank: a Poisson process of rate 1 that is a pure function of the element, so documents share the darts of
what they share. About k ln k + 2k darts land per document, whatever its size; the earliest of each of
the k coordinates makes the signature, and two signatures agree in a coordinate with a probability equal
to the weighted Jaccard similarity. Signatures meet in BANDS bands of ROWS coordinates.

1. Copies of one text collapse to one node, named by the text's 128-bit digest; one text a node is kept.
2. The centre of a bucket is its member that meets most others over all buckets. Each node is compared with
   the best of its centres, then with all whose class isn't its own, exactly, on the shingles themselves.
3. Links of at least `threshold` are merged to classes by alternating large and small stars.
4. In buckets that still hold several classes every pair of different classes is judged, by sketches of
   WIDE coordinates, in blocks of BLOCK members; pairs within reach of the threshold are compared exactly.
   So no bucket is capped, none is one group above BLOCK members, and only promising pairs are emitted.

With weights "set" every distinct shingle weighs 1 and the similarity is Jaccard's; "count" weighs it by
its occurrences. Words are split at ASCII white space. A text of 1 to 4 words is one shingle. Null texts
and texts without words form classes of their own. Rows that repeat an id and its text are one document
to the classes. Extra columns are left out of `near_classes` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, kept, pieces, stored

#: At a similarity of 0.8 a pair shares no band in 3 of a million cases.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Coordinates of the sketches of open buckets, and the share below the threshold at which a pair is out of
#: reach: four standard deviations.
WIDE, MARGIN, BLOCK = 512, 0.07, 2048


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, count) of the distinct shingles of the texts, ordered by text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    flat = pa.array([x for w in split for x in w], pa.binary()).dictionary_encode()
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(x) for x in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    h = each[flat.indices.to_numpy(zero_copy_only=False)]
    begin, own = np.cumsum(n) - n, np.repeat(np.arange(len(texts)), n)
    place, left = np.arange(len(h)) - begin[own], n[own]
    short = left < size
    with np.errstate(over="ignore"):
        g, step = np.zeros(len(h), np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for j in range(size):
            there = place + j < left
            g = g * step + np.where(there, np.append(h[j:], np.zeros(min(j, len(h)), np.uint64))[: len(h)], np.uint64(0x5851F42D4C957F2D))
    at = np.flatnonzero(np.where(short, place == 0, place + size <= left))
    g, own = mix(g[at]), own[at]
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.append(True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])) if len(g) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return g[first], own[first], np.diff(np.append(first, len(g)))


#: Darts in memory at once.
DARTS = 1_500_000


def dart_signatures(elements: np.ndarray, own: np.ndarray, weights: np.ndarray, sets: int, k: int) -> np.ndarray:
    """k signature values (32 bits) of each of `sets` weighted sets, whose elements stand in order; some sets at a time."""
    size = max(1, int(DARTS / (k * math.log(k) + 2 * k)))
    out = [np.zeros((0, k), np.uint32)]
    for a in range(0, sets, size):
        i, j = np.searchsorted(own, [a, a + size])
        out.append(_throw(elements[i:j], own[i:j] - a, weights[i:j], min(size, sets - a), k))
    return np.concatenate(out)


def _throw(elements: np.ndarray, own: np.ndarray, weights: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Signatures of sets; those without elements get zeros.

    The weight axis is cut at 0, 1, 2, 4, 8 ...: each piece below an element's weight is a region with
    darts of its own, whose ranks are sums of exponential gaps. Darts above the weight don't count. Sets
    with an empty coordinate throw again up to twice the rank.
    """
    out = np.zeros((sets, k), np.uint32)
    total = np.bincount(own, weights, sets)
    top = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(sets), where=total > 0)
    todo = total > 0
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    e = np.repeat(elements, levels)
    level = np.arange(len(e)) - np.repeat(np.cumsum(levels) - levels, levels)
    d, w = np.repeat(own, levels), np.repeat(weights, levels).astype(np.float64)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    size = np.where(level > 0, low, 1.0)
    with np.errstate(over="ignore"):
        e = mix(e + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        while todo.any():
            live = todo[d]
            x, own_, w_, low_, size_ = e[live], d[live], w[live], low[live], size[live]
            rank, darts, t = np.zeros(len(x)), [], 0
            while len(x):
                u = mix(x + np.uint64((2 * t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / size_
                go = rank < top[own_]
                x, own_, w_, low_, size_, rank = x[go], own_[go], w_[go], low_[go], size_[go], rank[go]
                v = mix(x + np.uint64((2 * t + 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                height = low_ + size_ * ((mix(v) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0)
                inside = height < w_
                darts.append((own_[inside] * k + (v[inside] % np.uint64(k)).astype(np.int64), rank[inside], (v[inside] >> np.uint64(32)).astype(np.uint32)))
                t += 1
            spot, ranks, ids = (np.concatenate(c) for c in zip(*darts, strict=True))
            order = np.argsort(-ranks, kind="stable")
            filled = np.zeros(sets * k, bool)
            flat = out.reshape(-1)
            flat[spot[order]] = ids[order]
            filled[spot] = True
            todo = todo & ~filled.reshape(sets, k).all(1)
            top = np.where(todo, 2 * top, top)
    return out


def text_node(text: Column) -> Column:
    """The node of a text: its 16-byte digest; null for a null text."""
    return F.unhex(F.md5(text))


def signatures(docs: DataFrame, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, bands) of each document with words."""
    k = bands * rows
    types = f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, bands array<long>"

    def make(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            coded = b.column("node").dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            _, first = np.unique(place, return_index=True)
            g, own, count = shingles(b.column("text").take(pa.array(first)).to_pylist())
            sig = dart_signatures(g, own, count if weights == "count" else np.ones(len(g)), len(first), k)
            has = np.bincount(own, minlength=len(first)) > 0
            keys = np.full((len(first), bands), 0x2545F4914F6CDD1D, np.uint64)
            for r in range(rows):
                keys = mix(keys + sig[:, r::rows].astype(np.uint64))
            at = np.flatnonzero(has[place])
            if len(at):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys[place[at]].reshape(-1).view(np.int64)))
                rows_ = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows_), b.column("node").take(rows_), lists], names=["doc_id", "node", "bands"])

    return docs.filter("text IS NOT NULL").select("doc_id", "text", text_node(F.col("text")).alias("node")).mapInArrow(make, types)


def verified(pairs: DataFrame, texts: DataFrame, weights: str, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least `threshold` similar."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def make(batches):
        for b in (part for batch in batches for part in pieces(batch, "text_a", 1_000_000)):
            sets: dict[bytes, int] = {}
            for side in ("a", "b"):
                for n, t in zip(b.column(side).to_pylist(), b.column(f"text_{side}").to_pylist(), strict=True):
                    sets.setdefault(n, t)
            number = {n: i for i, n in enumerate(sets)}
            g, own, count = shingles(list(sets.values()))
            ends = np.searchsorted(own, np.arange(len(sets) + 1))
            good = []
            for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                (i, j), (k, m) = ends[number[a] : number[a] + 2], ends[number[c] : number[c] + 2]
                _, x, y = np.intersect1d(g[i:j], g[k:m], assume_unique=True, return_indices=True)
                if weights == "count":
                    shared, all_ = np.minimum(count[i:j][x], count[k:m][y]).sum(), count[i:j].sum() + count[k:m].sum()
                else:
                    shared, all_ = len(x), j - i + m - k
                good.append(bool(shared >= threshold * (all_ - shared) - 1e-9))
            yield b.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(make, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `edges` (a, b): root is the least node of the connected component.

    Large and small stars in turn; each is a minimum by node and a join back, no group is collected.
    """
    now, seen = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now, old = kept(small.filter("a <> b").distinct()), now
        discard(old)


def near_nodes(docs: DataFrame, sigs: DataFrame, threshold: float, weights: str) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the nodes with links, and their links (a, b). sigs: the written signatures of `docs`."""
    nodes = sigs.groupBy("node").agg(F.min("bands").alias("bands"))
    every = stored(nodes.select("node", F.posexplode("bands").alias("band", "key")), "bands")
    sizes = every.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(every.join(sizes, ["band", "key"]), "shared-bands")
    discard(every)
    member = stored(shared.groupBy("node").agg(F.sum("n").alias("meets")), "members")
    # One text a node, combined within tasks before the shuffle; then those of nodes that share a bucket. The same plan at every size.
    texts = docs.filter("text IS NOT NULL").groupBy(text_node(F.col("text")).alias("node")).agg(F.first("text").alias("text"))
    texts = stored(texts.join(member.select("node").hint("merge"), "node", "left_semi"), "texts")
    rows = shared.join(member, "node")
    centres = rows.groupBy("band", "key").agg(F.max(F.struct("meets", "node")).alias("centre"))
    buckets = stored(rows.join(centres, ["band", "key"]).select("band", "key", "n", "node", "centre"), "buckets")
    discard(shared, member)
    outer = buckets.filter("centre.node <> node")
    best = outer.groupBy("node").agg(F.max("centre").alias("c")).select(F.col("node").alias("a"), F.col("c.node").alias("b"))
    links = kept(verified(best, texts, weights, threshold))
    roots = components(links)
    other = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    more = outer.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    more = more.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").join(other, "b", "left")
    more = more.filter(F.coalesce("root", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = kept(links.unionByName(verified(more, texts, weights, threshold)))
    roots = components(links)
    near = stored(reachable(buckets, roots, nodes, texts, weights, threshold), "near")
    rest = near.join(best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    found = kept(verified(rest, texts, weights, threshold))
    if not found.isEmpty():
        links = kept(links.unionByName(found))
        roots = components(links)
    discard(texts, buckets, near)
    return roots, links


def placed(docs: DataFrame, threshold: float, weights: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, root) of each document with words, and the links of the nodes."""
    sigs = stored(signatures(docs, weights), "signatures")
    roots, links = near_nodes(docs, sigs, threshold, weights)
    return sigs.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), links


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """(doc_id, node, class_id, class_size, n_links) of every row: class_id is the least doc_id of its class.

    n_links: verified links between different texts at this row's text. The links join every class, but pairs whose
    class is already known aren't compared, so n_links isn't the number of all near texts.
    """
    rows, links = placed(docs, threshold, weights)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    sizes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    classed = rows.join(sizes, "root").join(degree, "node", "left").select("doc_id", "node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    wordless = docs.filter("NOT coalesce(text, '') RLIKE '[^ \\t-\\r]'").select("doc_id", F.lit(None).cast("binary").alias("node"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"))
    return classed.unionByName(wordless)


def reachable(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, weights: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket but different classes whose wide sketches come within MARGIN of the threshold.

    A pair that shares several buckets comes out of the first of them only.
    """
    open_ = buckets.select("band", "key", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = open_.groupBy("band", "key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("band", "key")
    open_ = stored(open_.join(several, ["band", "key"]), "open")

    def sketches(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            g, own, count = shingles(b.column("text").to_pylist())
            sig = dart_signatures(g, own, count if weights == "count" else np.ones(len(g)), b.num_rows, WIDE)
            keys = b.column("bands").flatten().to_numpy().reshape(b.num_rows, -1)
            rows = np.concatenate([sig.astype(np.uint8), keys.view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in rows], pa.binary())], names=["node", "sketch"])

    wide = texts.join(open_.select("node").distinct(), "node").join(nodes, "node").mapInArrow(sketches, "node binary, sketch binary")
    # Each pair of blocks of a bucket is one group; a bucket of up to BLOCK members is one block.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_.join(wide, "node").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "with"), "j": F.greatest("mine", "with")})

    def judge(t: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        sketch, keys, band = row[:, :WIDE], row[:, WIDE:].copy().view(np.int64), t.column("band")[0].as_py()
        names, root = t.column("node").to_pylist(), t.column("root").dictionary_encode().combine_chunks().indices.to_numpy()
        mine, cross = t.column("mine").to_numpy(), t.column("i")[0].as_py() != t.column("j")[0].as_py()
        one, two = [], []
        for x in range(t.num_rows):
            at = np.flatnonzero(root[x + 1 :] != root[x]) + x + 1
            if cross:
                at = at[mine[at] != mine[x]]
            at = at[(keys[at] == keys[x]).argmax(1) == band] if len(at) else at
            at = at[(sketch[at] == sketch[x]).mean(1) >= threshold - MARGIN] if len(at) else at
            one += [max(names[x], names[y]) for y in at]
            two += [min(names[x], names[y]) for y in at]
        return pa.table([pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["a", "b"])

    need = dealt.select("band", "key", "i", "j", "mine", "node", "root", "sketch")
    return need.groupBy("band", "key", "i", "j").applyInArrow(judge, "a binary, b binary").distinct()


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """`docs` with one row of each class, all its columns as they were.

    Rows are told apart by id and text, so another text under the id of a copy stays. Of a class the row of the least
    doc_id stays (a null id is the least), of that id the one of the least digest. Of rows that repeat id and text one stays.
    """
    rows, _ = placed(docs, threshold, weights)
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("stays"))
    gone = rows.join(best, "root").filter("NOT (doc_id <=> stays.doc_id AND node = stays.node)").select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node"))
    gone, node = kept(gone.distinct()), free_name(docs, "_node")
    left = docs.withColumn(node, text_node(F.col("text"))).dropDuplicates(["doc_id", node]).alias("d")
    on = F.col(f"d.{node}").eqNullSafe(F.col("g.gone_node")) & F.col("d.doc_id").eqNullSafe(F.col("g.gone_id"))
    return left.join(gone.alias("g"), on, "left_anti").drop(node)
