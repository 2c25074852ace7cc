"""Trie of shared conversation prefixes, by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text). Its tour has two arcs, an enter and an exit, so a
subtree is the stretch of the tour between them. The tour is a linked list; ranking it gives every arc
its position and, with weights carried along, the prefix sums of leaves and savings at it. What a subtree holds is the
difference of the sums at its two arcs.

1. Turns get their places by a range partition over (conversation, turn, ...) with the counts of earlier partitions
   carried on. A node is named by its depth and two 64-bit sums (exclusive or) of hashes of (depth, role and text by
   md5): prefix sums again, in blocks of depths.
2. Nodes are rows grouped by that name, so their members are combined before any shuffle. The least member and
   the depth name a node from here on: siblings follow one another by it, which keeps a conversation's own path together.
3. Arcs are linked: enter to the first child or to the own exit, exit to the next sibling's enter or to the
   parent's exit. The next sibling is found by a range partition over all children, so a node with a third
   of all nodes as children isn't one group.
4. Ranking: arcs are dealt into blocks of about ARCS by conversation and depth, so that most links stay inside; each
   block contracts its stretches of the list to their heads. While more than ARCS heads are left, those that
   draw the least lot among their neighbours are taken out (a third of them a round) and put back in reverse order
   when the rest is ranked. The last heads, at most ARCS, are ranked as one block.

No window, group or join key gathers a conversation, a node's members or its children in one task, except that the
members that end at one node are read in order by the one task that hashes them: SHA-256 has no parallel form. They
arrive as joined strings of up to 256 ids, and the task holds one Arrow batch of them at a time.

Defined results: rows with a null conversation are left out; null role or text is empty; a null turn comes first; equal
turns are ordered by md5 of the role's length, role and text, so repeated rows are turns of their own. A conversation
without rebuilt turns is a member of the root alone. An empty table has no nodes. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, kept, small, stored

#: Arcs that one task ranks, and depths that one window sums up.
ARCS, DEPTHS = 200_000, 4096
#: Ids that are joined to one string before they are hashed: 2 ** CHUNK.
CHUNK = 8
SUMS = ["rank", "leaves", "saved"]


def content(role: Column, text: Column) -> Column:
    """md5 that names a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def in_parts(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`rows` written in range partitions by `order`, with the partition's number as _part; equal rows are spread too."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie")
    return stored(dealt.withColumn("_part", F.spark_partition_id()), name)


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, content, chars): turns numbered from 0 in each conversation."""
    order = [F.col("turn").asc_nulls_first(), "content"]
    dealt = in_parts(turns, ["conv_id", *order], "turns")
    counts = dealt.groupBy("conv_id", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = small(kept(counts.select("conv_id", "_part", before.alias("before")).filter("before > 0")))
    inside = F.row_number().over(Window.partitionBy("_part", "conv_id").orderBy(*order, "_tie"))
    here = dealt.withColumn("inside", inside).join(carried, ["conv_id", "_part"], "left")
    out = stored(here.select("conv_id", (F.col("inside") - 1 + F.coalesce("before", F.lit(0))).alias("place"), "content", "chars"), "places")
    discard(dealt)
    return out


def rebuilt(own: DataFrame, shared: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, content, chars, total) of every rebuilt turn, and (conv_id, total) of every conversation.

    `shared` is the number of first turns that conversation conv_id takes from conversation `base`: at most 5.
    """
    sizes = own.groupBy("conv_id").agg((F.max("place") + 1).alias("size"))
    heads = own.filter("place < 5").select(F.col("conv_id").alias("base"), F.struct("place", "content", "chars").alias("t"))
    convs = sizes.select("conv_id", "size", shared.alias("h"), base.alias("base"))
    used = heads.join(convs.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.sort_array(F.collect_list("t")).alias("head"))
    convs = convs.join(used, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(used.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).cast("bigint").alias("total")), "heads")
    first = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("d"), "t.content", "t.chars", "total")
    kept_own = own.join(convs.select("conv_id", "h", F.size("head").alias("n"), "total"), "conv_id").filter("place >= h")
    rest = kept_own.select("conv_id", (F.col("place") - F.col("h") + F.col("n") + 1).alias("d"), "content", "chars", "total")
    return first.unionByName(rest), convs.select("conv_id", "total")


def named(turns: DataFrame) -> DataFrame:
    """`turns` with the name (k1, k2) of the prefix that ends with them and (p1, p2) of the one before."""
    x = {f"x{i}": F.xxhash64(F.lit(i), F.col("d"), F.col("content")) for i in (1, 2)}
    turns = turns.withColumns(x | {"block": F.floor((F.col("d") - 1) / DEPTHS)})
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *(F.bit_xor(f"y{i}").over(earlier).alias(f"c{i}") for i in (1, 2))).filter("block > 0")
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = turns.withColumns({f"s{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)}).join(carried, ["conv_id", "block"], "left")
    k = {f"k{i}": F.col(f"s{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("bigint"))) for i in (1, 2)}
    return summed.withColumns(k).withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}).select("conv_id", "d", "chars", "total", "k1", "k2", "p1", "p2")


def ends(members: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256) of the nodes at which conversations end, from rows (d, k1, k2, conv_id)."""
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = members.groupBy("d", "k1", "k2", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(ids.alias("ids"))
    key = ["d", "k1", "k2"]

    def make(batches):
        state, now, done = None, None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            for k, text in zip(keys, b.column("ids").to_pylist(), strict=True):
                if k == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = k, hashlib.sha256(text.encode())
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now is not None:
            done.append((*now, state.hexdigest()))
        yield out(done)

    def out(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*key, "ends_sha256"])

    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(make, "d long, k1 long, k2 long, ends_sha256 string")


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, sibling): the next child of the same parent by least member; null for the last one."""
    key = ["depth", "parent", "conv_id"]
    dealt = in_parts(nodes.filter("depth > 0").select(*key), key, "children")
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(*key)).alias("f"))
    carried = F.broadcast(firsts.select("_part", F.lead("f").over(Window.orderBy("_part")).alias("after")))  # a row a partition
    follower = F.lead(F.struct(*key)).over(Window.partitionBy("_part").orderBy(*key))
    rows = dealt.withColumn("f", follower).join(carried, "_part", "left").withColumn("f", F.coalesce("f", "after"))
    same = (F.col("f.depth") == F.col("depth")) & (F.col("f.parent") == F.col("parent"))
    return rows.select("conv_id", "depth", F.when(same, F.col("f.conv_id")).alias("sibling"))


def arcs(nodes: DataFrame) -> DataFrame:
    """(c, e, nc, ne, rank, leaves, saved): arcs, 2 * depth to enter and one more to leave, the arc that follows, weights.

    `nodes` has conv_id, depth, parent, child (least of its children's members), sibling, saved.
    """
    leaf = F.col("child").isNull()
    enter = (2 * F.col("depth")).alias("e")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    into = F.struct(
        F.col("conv_id").alias("c"), enter, F.coalesce("child", "conv_id").alias("nc"), F.when(leaf, enter + 1).otherwise(enter + 2).alias("ne"),
        one.alias("rank"), F.when(leaf, one).otherwise(none).alias("leaves"), F.col("saved"),
    )
    out = F.struct(
        F.col("conv_id").alias("c"), (enter + 1).alias("e"), F.coalesce("sibling", "parent").alias("nc"),
        F.when(F.col("sibling").isNotNull(), enter).when(F.col("parent").isNotNull(), enter - 1).alias("ne"), one.alias("rank"), none.alias("leaves"), none.alias("saved"),
    )
    return nodes.select(F.explode(F.array(into, out)).alias("a")).select("a.*")


CONTRACTED = "c long, e long, hc long, he long, nc long, ne long, last boolean, rank long, leaves long, saved long, w_rank long, w_leaves long, w_saved long"


def contract(block: pa.Table) -> pa.Table:
    """Each arc of a block with the head of its stretch and the sums before it; the last arc of a stretch has what follows and the stretch's sums."""
    n = block.num_rows
    side = {k: block.column(k).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for k in ("c", "e", "nc", "ne")}
    codes, _ = pd.factorize(pd.concat([side["c"], side["nc"]], ignore_index=True))
    e = np.concatenate([side["e"].to_numpy(np.int64), side["ne"].fillna(-1).to_numpy(np.int64)])
    names = np.where(codes < 0, -1, (codes.astype(np.int64) << 33) | e)
    order = np.argsort(names[:n])
    at = np.minimum(np.searchsorted(names[:n], names[n:], sorter=order), n - 1)
    follows = np.where(names[order[at]] == names[n:], order[at], -1)
    weights = np.stack([block.column(k).to_numpy() for k in SUMS], 1)
    head, before = np.arange(n), np.zeros_like(weights)
    inner = np.flatnonzero(follows >= 0)
    head[follows[inner]] = inner
    before[follows[inner]] = weights[inner]
    while True:  # pointer doubling inside the block
        up = head[head]
        moved = np.flatnonzero(up != head)
        if not len(moved):
            break
        before[moved] += before[head[moved]]
        head = up
    last = follows < 0
    total = before + weights
    columns = [block.column("c"), block.column("e"), block.column("c").take(pa.array(head)), block.column("e").take(pa.array(head)), block.column("nc"), block.column("ne"), pa.array(last)]
    return pa.table([*columns, *(pa.array(before[:, i]) for i in range(3)), *(pa.array(total[:, i]) for i in range(3))], names=[f.split()[0] for f in CONTRACTED.split(", ")])


def contracted(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """Rows of contract() for `rows` dealt into blocks by conversation and depth."""
    block = F.pmod(F.xxhash64("c", F.shiftright("e", 13)), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("bigint")
    return stored(rows.withColumn("block", block).groupBy("block").applyInArrow(contract, CONTRACTED), name)


def stretches(done: DataFrame) -> DataFrame:
    """The heads that contract() left, as arcs."""
    return done.filter("last").select(F.col("hc").alias("c"), F.col("he").alias("e"), "nc", "ne", *(F.col(f"w_{k}").alias(k) for k in SUMS))


def lot(seed: int, c: str, e: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(c), F.col(e))


def drawn(heads: DataFrame, seed: int) -> DataFrame:
    """`heads` (c, e, nc, ne, pc, pe, sums) with `out`: whether the row draws less than both neighbours; the first row never goes."""
    mine = lot(seed, "c", "e")
    return heads.withColumn("out", F.col("pc").isNotNull() & (mine < lot(seed, "pc", "pe")) & (F.col("nc").isNull() | (mine < lot(seed, "nc", "ne"))))


def closed(heads: DataFrame) -> DataFrame:
    """The rows that stay: each took over what followed a row that went, and its sums."""
    zero = [F.lit(0).cast("bigint").alias(k) for k in SUMS]
    no = F.lit(None).cast("bigint")
    gone = heads.filter("out")
    stay = heads.filter("NOT out").select(F.lit(0).alias("kind"), "c", "e", "nc", "ne", "pc", "pe", *SUMS)
    to_before = gone.select(F.lit(1).alias("kind"), F.col("pc").alias("c"), F.col("pe").alias("e"), "nc", "ne", no.alias("pc"), no.alias("pe"), *SUMS)
    to_after = gone.filter("nc IS NOT NULL").select(F.lit(2).alias("kind"), F.col("nc").alias("c"), F.col("ne").alias("e"), no.alias("nc"), no.alias("ne"), "pc", "pe", *zero)
    told = stay.unionByName(to_before).unionByName(to_after).groupBy("c", "e")
    of = lambda kind, a, b: F.max(F.when(F.col("kind") == kind, F.struct(a, b)))
    told = told.agg(of(0, "nc", "ne").alias("n0"), of(1, "nc", "ne").alias("n1"), of(0, "pc", "pe").alias("p0"), of(2, "pc", "pe").alias("p2"), *(F.sum(k).alias(k) for k in SUMS))
    following, before = F.coalesce("n1", "n0"), F.coalesce("p2", "p0")
    return told.select("c", "e", following["nc"].alias("nc"), following["ne"].alias("ne"), before["pc"].alias("pc"), before["pe"].alias("pe"), *SUMS)


def ranked(tour: DataFrame, count: int) -> DataFrame:
    """(c, e, rank, leaves, saved): sums of all arcs before each of the `count` arcs of one list."""
    first = contracted(tour, -(-count // ARCS), "stretches")
    heads, levels = stored(stretches(first), "heads"), []
    n = heads.count()
    if n > ARCS:
        back = heads.filter("nc IS NOT NULL").select(F.col("nc").alias("c"), F.col("ne").alias("e"), F.col("c").alias("pc"), F.col("e").alias("pe"))
        heads = heads.join(back, ["c", "e"], "left")
    while n > ARCS:
        levels.append(stored(drawn(heads, len(levels)), "lots"))
        heads = stored(closed(levels[-1]), "heads")
        n = heads.count()
    last = contracted(heads.select("c", "e", "nc", "ne", *SUMS), 1, "last")
    sums = last.select("c", "e", *SUMS)
    weights = heads.select("c", "e", *(F.col(k).alias(f"w_{k}") for k in SUMS))
    for level in reversed(levels):  # rows that went stand behind the row before them, at the end of what it weighed then
        known = sums.join(weights, ["c", "e"]).select(F.col("c").alias("kc"), F.col("e").alias("ke"), *(F.col(k).alias(f"s_{k}") for k in SUMS), *(f"w_{k}" for k in SUMS))
        to = level.withColumns({"kc": F.when(F.col("out"), F.col("pc")).otherwise(F.col("c")), "ke": F.when(F.col("out"), F.col("pe")).otherwise(F.col("e"))})
        at = [F.when(F.col("out"), F.col(f"s_{k}") + F.col(f"w_{k}") - F.col(k)).otherwise(F.col(f"s_{k}")).alias(k) for k in SUMS]
        sums = stored(to.join(known, ["kc", "ke"]).select("c", "e", *at), "sums")
        weights = level.select("c", "e", *(F.col(k).alias(f"w_{k}") for k in SUMS))
    heads_at = sums.select(F.col("c").alias("hc"), F.col("e").alias("he"), *(F.col(k).alias(f"s_{k}") for k in SUMS))
    return first.join(heads_at, ["hc", "he"]).select("c", "e", *((F.col(k) + F.col(f"s_{k}")).alias(k) for k in SUMS))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with parent, child and saved, from rows of named() and (conv_id, total) of all conversations."""
    key, up = ["d", "k1", "k2"], ["p1", "p2"]
    made = turns.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.max(p).alias(p) for p in up))
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), *(zero.alias(p) for p in up))
    made = stored(made.unionByName(root), "nodes")
    own = F.broadcast(made.filter("d = 0").select(F.col("d").alias("of"), F.col("conv_id").alias("root")))  # one row
    above = made.filter("d > 0").select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    below = made.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    below = below.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child"))
    stop = turns.filter("d = total").select(*key, "conv_id").unionByName(members.filter("total = 0").select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    deep = made.filter("d > 1").join(above, ["d", *up], "left")
    shallow = made.filter("d <= 1").withColumn("at", F.col("d") - 1).join(own, F.col("at") == F.col("of"), "left").withColumnRenamed("root", "above").drop("at", "of")
    nodes = deep.unionByName(shallow).join(below, key, "left").join(ends(stop), key, "left")
    return stored(
        nodes.select(
            "conv_id", F.col("d").alias("depth"), F.col("above").alias("parent"), "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "child",
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ),
        "trie",
    )


def prefix_trie(conversations: DataFrame, shared: Column | None = None, base: Column | None = None) -> DataFrame:
    """Nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, entered and left (tour positions).

    Conversation conv_id is rebuilt with the first `shared` (at most 5) turns of conversation `base` in place of its own.
    """
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string").cast("binary")) % 6 if shared is None else shared
    base = c - c % 100 if base is None else base
    chars = F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars")
    turns = conversations.filter(c.isNotNull()).select(c.cast("bigint").alias("conv_id"), "turn", content(F.col("role"), F.col("text")).alias("content"), chars)
    own = placed(turns)
    rows, members = rebuilt(own, shared, base)
    steps = stored(named(rows), "steps")
    discard(own)
    nodes = trie(steps, members)
    discard(steps)
    linked = nodes.join(next_siblings(nodes), ["conv_id", "depth"], "left")
    at = ranked(arcs(linked), 2 * nodes.count())
    depth, exit_ = F.floor(F.col("e") / 2).alias("depth"), F.col("e") % 2 == 1
    spans = at.groupBy(F.col("c").alias("conv_id"), depth).agg(*(F.max(F.when(exit_ if side else ~exit_, F.col(k))).alias(f"{k}{side}") for k in SUMS for side in (0, 1)))
    return nodes.join(spans, ["conv_id", "depth"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves1") - F.col("leaves0")).alias("n_leaves"),
        (F.col("saved1") - F.col("saved0")).alias("saved_tokens"), "ends_sha256", F.col("rank0").alias("entered"), F.col("rank1").alias("left"),
    )
