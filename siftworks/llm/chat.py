"""Chat formatting by quotation linking.

Messages quote others with `>` marks, nested to any level. Each message is parsed into its own words and
quoted passages (runs of lines of one level); passages are normalised (case, white space and punctuation
at the ends of words are folded) and hashed; a quoted passage is linked to the latest earlier message of its
conversation whose own words have that hash. A message's parent is what its shallowest linked quote links
to. Replies are then ordered by thread, depth and message number, and stand without their quotes.

Linking is an as-of window over (conversation, hash, block of message numbers) with the blocks' last
originals carried on, so neither a long conversation nor a phrase that everyone repeats makes pairs or
one task. Threads are resolved by pointer doubling with reliable checkpoints.

Null texts have empty bodies and no quotes; empty bodies are never linked to. Messages that repeat a
number are ordered by their text's hash and share links. Rows without a conversation form one
conversation of their own (null). Extra columns stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import kept, stored

MARKS = re.compile(r"^(?:[ \t]*>)+")
EDGE = re.compile(r"[^\w\s]+(?=\s|$)|(?<!\S)[^\w\s]+")
BLOCK = 256
PARSED = T.StructType().add("body", "string").add("body_hash", "long").add("quotes", T.ArrayType(T.StructType().add("level", "integer").add("hash", "long")))


def normalised(text: str) -> str:
    return " ".join(EDGE.sub(" ", text.lower()).split())


def passage_hash(text: str) -> int | None:
    """Signed 64-bit hash of a passage's normal form; None if that is empty."""
    plain = normalised(text)
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63) if plain else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own words of a message, and its quoted passages with their levels, in their order."""
    own, quotes, level = [], [], 0
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        if m is None:
            own.append(line)
            level = 0
            continue
        here, line = m[0].count(">"), line[m.end() :].removeprefix(" ")
        if here == level:
            quotes[-1][1].append(line)
        else:
            quotes.append((here, [line]))
        level = here
    return "\n".join(own).strip("\n"), [(k, "\n".join(ls)) for k, ls in quotes]


def parsed(messages: DataFrame) -> DataFrame:
    """`messages` with body, body_hash and quotes in place of text."""
    keep = [f for f in messages.schema.fields if f.name not in ("text", *PARSED.names)]
    schema = T.StructType(keep + PARSED.fields)
    arrow, names = to_arrow_schema(schema), [f.name for f in keep]

    def make(batches):
        for b in batches:
            done = [parse(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            quotes = [[{"level": k, "hash": h} for k, q in qs if (h := passage_hash(q)) is not None] for _, qs in done]
            made = [pa.array([x for x, _ in done], pa.string()), pa.array([passage_hash(x) for x, _ in done], pa.int64()), pa.array(quotes, arrow.field("quotes").type)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + made, names=schema.names).cast(arrow)

    return messages.select(*names, "text").mapInArrow(make, schema)


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_id, parent) of the messages whose quotes are found."""
    originals = messages.filter("body_hash IS NOT NULL").select("conv_id", "msg_id", F.col("body_hash").alias("hash"), F.lit(None).cast("int").alias("level"))
    quotes = messages.select("conv_id", "msg_id", F.explode("quotes").alias("q")).select("conv_id", "msg_id", F.col("q.hash").alias("hash"), F.col("q.level").alias("level"))
    both = originals.unionByName(quotes).withColumn("block", F.floor(F.col("msg_id") / BLOCK))
    original = F.when(F.col("level").isNull(), F.col("msg_id"))
    lasts = both.groupBy("conv_id", "hash", "block").agg(F.max(original).alias("last"))
    carried = lasts.select("conv_id", "hash", "block", F.max("last").over(Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("msg_id").rangeBetween(Window.unboundedPreceding, -1)
    asof = both.withColumn("near", F.max(original).over(inside)).filter("level IS NOT NULL")
    on = asof.conv_id.eqNullSafe(carried.conv_id) & (asof.hash == carried.hash) & (asof.block == carried.block)
    found = asof.join(carried, on, "left").select(asof.conv_id, "msg_id", "level", F.coalesce("near", "earlier").alias("parent")).filter("parent IS NOT NULL")
    return found.groupBy("conv_id", "msg_id").agg(F.min(F.struct("level", F.negate("parent").alias("p"))).alias("best")).select("conv_id", "msg_id", F.negate("best.p").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, msg_id, root, depth) by pointer doubling: rounds grow with the logarithm of the depth."""
    now = kept(links.select("conv_id", "msg_id", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = now.join(up, now.conv_id.eqNullSafe(up.c) & (now.root == up.m), "left")
        step = kept(step.select("conv_id", "msg_id", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def format_chats(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, msg_id, text, more columns) in reply order: parent, root, depth, position, text without quotes."""
    split = stored(parsed(messages.drop("parent", "root", "depth", "position")), "messages")
    links = kept(linked(split))
    depth = threads(links)
    rows = split.drop("body_hash", "quotes")
    for side, names in ((links, ["parent"]), (depth, ["root", "depth"])):
        other = side.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), *names)
        rows = rows.join(other, rows.conv_id.eqNullSafe(other._c) & (rows.msg_id == other._m), "left").drop("_c", "_m")
    rows = rows.withColumns({"root": F.coalesce("root", "msg_id"), "depth": F.coalesce("depth", F.lit(0).cast("bigint"))})
    order = Window.partitionBy("conv_id").orderBy("root", "depth", "msg_id", F.xxhash64("body"))
    return rows.withColumn("position", F.row_number().over(order).cast("bigint")).withColumnRenamed("body", "text")


def as_mail(conversations: DataFrame, levels: int = 2) -> DataFrame:
    """Conversations as mail: (conv_id, msg_id, role, text), each turn under the quotes of the `levels` turns before it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    parts = [F.col("text")]
    for k in range(1, levels + 1):
        mark = ">" * k + " "
        before = F.lag("text", k).over(by)
        parts.insert(0, F.concat(F.lit(mark), F.regexp_replace(before, "\n", "\n" + mark)))
    return conversations.select("conv_id", F.col("turn").alias("msg_id"), "role", F.concat_ws("\n", *parts).alias("text"))
