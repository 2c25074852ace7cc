"""Benchmark decontamination with a distributed positional inverted index.

1. Corpus counts of every test term (one pass, combined before the shuffle).
2. Each test window picks its rarest terms; the index stores the postings (term, document, position) of
   those terms for the whole corpus.
3. Postings meet on offset-adjusted positions: a posting at p of a term at place i of an item votes for
   the alignment p - i. A window is a candidate where the lists of all its rarest terms agree.
4. Candidates are matched word for word in the document, and the covered words counted.

Only DataFrame functions are used. Texts are split into words once, into a written table that all passes
read. Tables of test terms are broadcast while their files have at most `common.SMALL_BYTES`, else the same
joins shuffle. Documents and items are keyed by id and
text digest, so repeated ids with different texts stay apart; rows that repeat id and text count once in
the index and come back each. A null or empty text has no words: nothing is hit. Items without words are
never found; a null item_id is found but has no name to list. All rows of `docs` come back, extra columns
are dropped by `phrase_hits` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, kept, small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, RAREST = 13, 3
#: Bytes of compressed files of a table of document keys that may be broadcast.
KEY_BYTES = 32_000_000


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes the words; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def digest(text: Column) -> Column:
    """16 bytes of a text, the same for null and empty texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def split_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, n_words, w): the words of each text and its digest, one row for each row of `docs`."""
    return docs.select("doc_id", digest(F.col("text")).alias("_h"), words(F.col("text")).alias("w")).select("doc_id", "_h", F.size("w").cast("bigint").alias("n_words"), "w")


def tokens(split: DataFrame) -> DataFrame:
    """(doc_id, _h, pos, term) of every word of split documents."""
    return split.select("doc_id", "_h", F.posexplode("w").alias("pos", "term"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, item_words, start, terms): a shorter item is one window; item tells rows of one id apart."""
    split = items.select("item_id", "text").distinct().withColumn("item_words", words(F.col("text"))).filter(F.size("item_words") > 0)
    split = split.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "item_words")
    starts = F.sequence(F.lit(0), F.greatest(F.size("item_words") - window, F.lit(0)))
    return split.withColumn("start", F.explode(starts)).withColumn("terms", F.expr(f"slice(item_words, start + 1, {window})"))


def term_counts(split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in all documents of each term of the vocabulary."""
    return split.select(F.explode("w").alias("term")).join(small(vocabulary), "term").groupBy("term").count()


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item, start, ipos, term) of the rarest terms of each window all of whose terms occur."""
    places = windows.select("item", "start", F.posexplode("terms").alias("off", "term"))
    places = places.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by = Window.partitionBy("item", "start")
    ranked = places.withColumn("least", F.min("count").over(by)).withColumn(
        "rank", F.row_number().over(by.orderBy("count", "term", "off"))
    )
    return ranked.filter(f"least > 0 AND rank <= {rarest}").select("item", "start", (F.col("start") + F.col("off")).alias("ipos"), "term")


def postings(split: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: postings of the terms over the whole corpus."""
    return tokens(split).join(small(terms), "term")


def alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Intersects offset-adjusted lists: (doc_id, _h, item, delta, starts) of candidate windows."""
    needed = kept(anchors.groupBy("item", "start").agg(F.collect_set("ipos").alias("need")))
    by_item = kept(needed.groupBy("item").agg(F.collect_list(F.struct("start", "need")).alias("windows")))
    places = kept(anchors.select("term", "item", "ipos").distinct())
    votes = index.join(small(places), "term").select("doc_id", "_h", "item", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos")
    agreed = votes.groupBy("doc_id", "_h", "item", "delta").agg(F.collect_set("ipos").alias("got"))
    fits = F.expr("transform(filter(windows, w -> forall(w.need, p -> array_contains(got, p))), w -> w.start)")
    return agreed.join(small(by_item), "item").withColumn("starts", fits).filter("size(starts) > 0").select("doc_id", "_h", "item", "delta", "starts")


def proximity(index: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """Documents where both terms of a pair (pair_id, term_a, term_b) stand within `span` words, in any order.

    Blocks of `span` words make it an equi join: a posting meets those of its own and the two next blocks.
    """
    block = F.floor(F.col("pos") / span)
    a = index.join(pairs, index.term == pairs.term_a).select("pair_id", "doc_id", "_h", F.col("pos").alias("pos_a"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    b = index.join(pairs, index.term == pairs.term_b).select("pair_id", "doc_id", "_h", F.col("pos").alias("pos_b"), block.alias("block"))
    near = a.join(b, ["pair_id", "doc_id", "_h", "block"]).filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= span) & (F.col("pos_a") != F.col("pos_b")))
    return near.groupBy("pair_id", "doc_id", "_h").agg(F.min(F.abs(F.col("pos_a") - F.col("pos_b"))).alias("distance"))


def marked(split: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _h, n_words, n_hit, items) of the documents in which a window occurs. items: item_ids as sorted strings."""
    windows = kept(item_windows(items, window))
    vocabulary = kept(windows.select(F.explode("terms").alias("term")).distinct())
    anchors = kept(rarest_terms(windows, kept(term_counts(split, vocabulary))))
    index = stored(postings(split, kept(anchors.select("term").distinct())), "postings")
    found = alignments(index, anchors).join(small(kept(windows.select("item", "item_id", "item_words").distinct())), "item")
    cands = stored(found.select("doc_id", "_h", F.struct("item_id", "delta", "starts", "item_words").alias("c")).groupBy("doc_id", "_h").agg(F.collect_list("c").alias("cands")), "candidates")
    # words of documents without candidates are left where they are: shuffled are those of the few others at most
    held = kept(cands.select("doc_id", "_h"))
    same = F.col("d._h").eqNullSafe(F.col("k._h")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    few = split.alias("d").join(small(held, KEY_BYTES).alias("k"), same, "left_semi")
    both = few.alias("d").join(cands.alias("c"), F.col("d._h").eqNullSafe(F.col("c._h")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).select("d.*", "cands")
    spans = F.expr(f"""
        flatten(transform(cands, c -> transform(
            filter(c.starts, s -> c.delta + s >= 0 AND
                slice(w, greatest(c.delta + s, 0) + 1, {window}) = slice(c.item_words, s + 1, {window})
                OR (c.delta + s >= 0 AND size(c.item_words) < {window} AND
                    slice(w, greatest(c.delta + s, 0) + 1, size(c.item_words)) = c.item_words)),
            s -> struct(c.item_id AS item, c.delta + s AS at, least({window}, size(c.item_words)) AS len))))""")
    hit = F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.at, x.at + x.len - 1)))))").cast("bigint")
    named = F.expr("array_sort(array_distinct(filter(transform(spans, x -> cast(x.item AS string)), i -> i IS NOT NULL)))")
    return both.withColumn("spans", spans).select("doc_id", "_h", "n_words", hit.alias("n_hit"), named.alias("items")).filter("n_hit > 0")


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, items (sorted strings of item_ids with occurring windows)."""
    split = stored(split_documents(docs), "words")
    hits = kept(marked(split, items, window).select("doc_id", "_h", "n_hit", "items").dropDuplicates(["doc_id", "_h"]))
    on = F.col("d._h").eqNullSafe(F.col("h._h")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    rows = split.select("doc_id", "_h", "n_words").alias("d").join(hits.alias("h"), on, "left")
    return rows.select("d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """The rule: some word is hit and hits are at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that aren't contaminated, all their columns as they were."""
    split = stored(split_documents(docs), "words")
    bad = kept(marked(split, items, window).filter(contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("_h").alias("bad_h")).distinct())
    h = free_name(docs, "_h")
    on = F.col(f"d.{h}").eqNullSafe(F.col("b.bad_h")) & F.col("d.doc_id").eqNullSafe(F.col("b.bad_id"))
    return docs.withColumn(h, digest(F.col("text"))).alias("d").join(bad.alias("b"), on, "left_anti").drop(h)
