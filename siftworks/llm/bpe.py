"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash over characters cuts each text into chunks; equal passages get equal cuts, wherever
   they stand. Chunk digests are counted over the corpus.
2. A chunk that occurs twice or more is encoded once, by the bucket that owns it, and its ids go to every
   bucket that needs them. Chunks that occur once are encoded where they stand.
3. A chunk's ids are those of its whole words. At each join the broken words are re-encoded together with
   a whole word on each side; the join holds if the ids of those words agree with the chunks' own, else it
   widens to the whole document, which is then encoded in one.

Ids equal those of the tokenizers library for the whole text because no token of the vocabularies used
here spans ASCII white space: the vocabulary drops white space before it merges.

Texts, chunk ids and results stay in bucket-sized Arrow tables. Null texts count as empty: no ids, and
the decoded text is empty. Repeated rows are encoded each. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bucket_count, free_name, pieces, stored

#: A chunk has 2**CHUNK_BITS characters on average; the rolling hash sees ROLL of them.
CHUNK_BITS, ROLL = 11, 16
WHITE = " \t\n\r\x0b\x0c"
#: Distinct words that a Python worker remembers, and their bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 64_000_000
#: Punctuation after an ASCII letter and before white space is a pre-token of its own, so it is split off first.
TAIL = r"([A-Za-z])([.,;:!?]+)([ \t\n]|$)"
MARKS = re.compile("[\u0300-\U0010ffff]")


def _composed(text: str) -> bool:
    """No character of the text can combine with a letter before it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return MARKS.search(text) is None
    return True


class WordEncoder:
    """Ids of white-space separated words, remembered up to a bound in Arrow and numpy arrays."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # ASCII letters in lower case are their own normal form and byte symbols: the model alone encodes them.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    @classmethod
    def of(cls, path: str, most: int = CACHE_WORDS) -> WordEncoder:
        """The one of this worker, which remembers `most` words."""
        if path not in cls._made:
            cls._made[path] = cls(path, most)
        return cls._made[path]

    def _forget(self) -> None:
        self.words, self.size, self.pool = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def _known(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words, of which unknown ones are encoded first."""
        if len(self.words) + len(words) > self.most or self.words.nbytes > CACHE_BYTES:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        number = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            unknown = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            new = words.take(pa.array(unknown))
            letters = pc.and_(pc.and_(pc.string_is_ascii(new), pc.ascii_is_lower(new)), pc.ascii_is_alpha(new)).to_numpy(zero_copy_only=False)
            order = np.argsort(~letters, kind="stable")
            new, count = new.take(pa.array(order)), int(letters.sum())
            number[unknown[order]] = np.arange(len(self.words), len(self.words) + len(new))
            text = new.to_pylist()
            (a, m), (b, n) = self._letters(text[:count]), self._whole(text[count:])
            self.words = pa.concat_arrays([self.words, new])
            self.pool, self.size = np.concatenate([self.pool, a, b]), np.concatenate([self.size, m, n])
        return number

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ASCII letters in lower case, one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            made = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u2")
            n = np.diff(np.flatnonzero(self.ends[made]), prepend=-1)
            a, b = (made, n) if len(n) == len(part) else self._whole(part)
            ids.append(a)
            sizes.append(b)
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, each encoded by itself, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u2", int(size.sum())), size

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end; a null text has none.

        A-Z is lowered first where that can't matter to composition or to added tokens.
        """
        column = pc.fill_null(column, "")
        lower = pa.array(["<|" not in t and _composed(t) for t in column.to_pylist()], pa.bool_())
        if not len(column):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        text = pc.if_else(lower, pc.ascii_lower(column), column)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, TAIL, r"\1 \2 "))
        coded = split.flatten().dictionary_encode()
        number = self._known(coded.dictionary)
        begin = np.cumsum(self.size) - self.size
        codes = number[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.size[codes]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        out = np.empty(int(ends[-1]), "<u2")
        for a in range(0, len(codes), 1 << 18):
            b = min(a + (1 << 18), len(codes))
            out[ends[a] : ends[b]] = self.pool[np.repeat(begin[codes[a:b]] - ends[a:b], n[a:b]) + np.arange(ends[a], ends[b])]
        return out, ends[split.offsets.to_numpy()[1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit strings."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def cuts(text: str) -> list[int]:
    """Ends of the chunks: where the hash of the last ROLL characters has CHUNK_BITS zero bits, and the end."""
    if len(text) <= ROLL:
        return [len(text)] if text else []
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(2654435761)
    size, step = 1, 0x01000193
    while size < ROLL:
        x = x[:-size] * np.uint32(step) + x[size:]
        step, size = step * step & 0xFFFFFFFF, size * 2
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = (np.flatnonzero(x >> np.uint32(32 - CHUNK_BITS) == 0) + ROLL).tolist()
    return at if at and at[-1] == len(text) else [*at, len(text)]


def chunks(text: str | None) -> list[str]:
    ends = cuts(text or "")
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def edges(chunk: str) -> tuple[int, int] | None:
    """Where the chunk's whole words begin and end: after its first and at its last white space, if any."""
    first = min((i for c in WHITE if (i := chunk.find(c)) >= 0), default=-1)
    if first < 0:
        return None
    return first, max(chunk.rfind(c) for c in WHITE)


class Joiner:
    """Puts a document's ids together from its chunks and mended joins."""

    def __init__(self, encoder: WordEncoder):
        self.encoder, self.joins, self.plans = encoder, [], []

    def add(self, parts: list[str]) -> None:
        """Notes a document's pieces: (chunk number, None) or (None, number of a join's text)."""
        plan, broken, last = [], "", None
        for k, chunk in enumerate(parts):
            e = edges(chunk)
            if e is None:
                broken += chunk
                continue
            broken += chunk[: e[0]]
            if broken:
                plan.append((None, len(self.joins)))
                self.joins.append((broken, _last_word(parts[last]) if last is not None else "", _first_word(chunk)))
            plan.append((k, None))
            broken, last = chunk[e[1] + 1 :], k
        if broken:
            plan.append((None, len(self.joins)))
            self.joins.append((broken, _last_word(parts[last]) if last is not None else "", ""))
        self.plans.append(plan)

    def mended(self) -> list[bytes | None]:
        """Ids of the joins' broken words, encoded between their neighbours; None where those don't agree."""
        encoder = self.encoder
        mixed = encoder.tokenizer.encode_batch_fast([f"{a} {b} {c}" for b, a, c in self.joins], add_special_tokens=False)
        sides = encoder.encode([x for _, a, c in self.joins for x in (a, c)])
        alone, out = encoder.encode([b for b, _, _ in self.joins]), []
        for k, (e, own) in enumerate(zip(mixed, alone, strict=True)):
            ids, left, right = np.array(e.ids, "<u2").tobytes(), sides[2 * k], sides[2 * k + 1]
            out.append(own if ids == left + own + right else None)
        return out


def _last_word(chunk: str) -> str:
    a, b = edges(chunk)
    words = chunk[a:b].rsplit(None, 1) if a < b else []
    return words[-1] if words else ""


def _first_word(chunk: str) -> str:
    a, b = edges(chunk)
    words = chunk[a:b].split(None, 1) if a < b else []
    return words[0] if words else ""


def inner(chunk: str) -> str:
    """The chunk's whole words."""
    e = edges(chunk)
    return "" if e is None else chunk[e[0] : e[1]]


def chunk_counts(dealt: DataFrame) -> DataFrame:
    """(digest, bucket, n) of the chunks with whole words, combined within batches."""

    def make(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            counts: dict[tuple[bytes, int], int] = {}
            for t, k in zip(b.column("text").to_pylist(), b.column("_bucket").to_pylist(), strict=True):
                for c in chunks(t):
                    key = (digest(c), k)
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in counts], pa.binary()), pa.array([k for _, k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    names=["digest", "_bucket", "n"],
                )

    return dealt.select("text", "_bucket").mapInArrow(make, "digest binary, _bucket long, n long")


def _encode_owned(path: str):
    schema = pa.schema([("digest", pa.binary()), ("ids", pa.binary())])

    def make(docs: pa.Table, owned: pa.Table) -> pa.Table:
        want = set(owned.column("digest").to_pylist())
        found: dict[bytes, str] = {}
        if want:
            for t in docs.column("text").to_pylist():
                for c in chunks(t):
                    if (d := digest(c)) in want:
                        found[d] = c
        ids = WordEncoder.of(path).encode([inner(c) for c in found.values()]) if found else []
        return pa.table([pa.array(list(found), pa.binary()), pa.array(ids, pa.binary())], schema=schema)

    return make


def _assemble(path: str, out: pa.Schema):
    def make(docs: pa.Table, shared: pa.Table) -> pa.Table:
        encoder = WordEncoder.of(path)
        ready = dict(zip(shared.column("digest").to_pylist(), shared.column("ids").to_pylist(), strict=True))
        texts = docs.column("text").to_pylist()
        ids: list[bytes] = []
        for i in range(0, len(texts), 500):
            split = [chunks(t) for t in texts[i : i + 500]]
            joiner = Joiner(encoder)
            for parts in split:
                joiner.add(parts)
            mended = joiner.mended()
            for parts, plan in zip(split, joiner.plans, strict=True):
                if any(j is not None and mended[j] is None for _, j in plan):
                    whole = encoder.tokenizer.encode("".join(parts), add_special_tokens=False).ids
                    plan[:] = [(None, len(mended))]
                    mended.append(np.array(whole, "<u2").tobytes())
            own = [[ready.get(digest(parts[k])) if k is not None else mended[j] for k, j in plan] for parts, plan in zip(split, joiner.plans, strict=True)]
            alone = [(d, n) for d, found in enumerate(own) for n, x in enumerate(found) if x is None]
            fresh = encoder.encode([inner(split[d][joiner.plans[d][n][0]]) for d, n in alone]) if alone else []
            for (d, n), x in zip(alone, fresh, strict=True):
                own[d][n] = x
            ids += [b"".join(x) for x in own]
        decoded = [x for i in range(0, len(ids), 500) for x in encoder.tokenizer.decode_batch([np.frombuffer(y, "<u2").tolist() for y in ids[i : i + 500]], skip_special_tokens=False)]
        wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids] if "ids_sha256" in out.names else []
        made = {
            "ids": lambda: pa.array(ids, pa.binary()),
            "decoded": lambda: pa.array(decoded, pa.string()),
            "n_tokens": lambda: pa.array([len(x) // 2 for x in ids], pa.int64()),
            "ids_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in wide], pa.string()),
            "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        }
        return pa.table([made[f.name]() if f.name in made else docs.column(f.name) for f in out], names=out.names).cast(out)

    return make


RESULTS = {"ids": "binary", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, results: tuple[str, ...] = ("ids", "decoded", "n_tokens")) -> DataFrame:
    """`docs` (doc_id, text, more columns) without text, with the results asked for.

    Buckets have about BUCKET_BYTES of text and a partition each on average, whatever the size of the table.
    ids: little-endian unsigned 16-bit ids. path: a vocabulary file of the tokenizers library whose ids
    have 16 bits and whose pre-tokens hold no white space. Columns named like a result are replaced.
    """
    docs = docs.drop(*RESULTS)
    n, bucket = bucket_count(docs), free_name(docs, "_bucket")
    dealt = docs.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, bucket)
    per = stored(chunk_counts(docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("_bucket"))).groupBy("digest", "_bucket").agg(F.sum("n").alias("n")), "chunks")
    often = per.groupBy("digest").agg(F.sum("n").alias("total"), F.min("_bucket").alias("owner")).filter("total > 1")
    needed = stored(per.join(often, "digest").select("digest", "_bucket", "owner"), "shared-chunks")
    owned = needed.filter("_bucket = owner").select("digest", "_bucket")
    # Both passes read the same columns, so that the documents are dealt out once.
    once = dealt.groupBy(bucket).cogroup(owned.groupBy("_bucket")).applyInArrow(_encode_owned(path), "digest binary, ids binary")
    shared = needed.select("digest", "_bucket").join(once, "digest")
    schema = T.StructType([f for f in dealt.schema.fields if f.name not in ("text", bucket)])
    for name in results:
        schema = schema.add(name, RESULTS[name])
    return dealt.groupBy(bucket).cogroup(shared.groupBy("_bucket")).applyInArrow(_assemble(path, to_arrow_schema(schema)), schema)
