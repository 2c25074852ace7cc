"""Training-data operators on small fixtures: brute force, exact round trips and odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftworks.llm.common import kept
from siftworks.llm import ann, bpe, chat, decontaminate, near_dedup, queries, substring_dedup, token_store, url_filter

tokenizers = pytest.importorskip("tokenizers")
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 9),
    (6, "Ünïcode Ça H̱ ß İ <|endoftext|> don't 3.14 x_y 漢字 " * 3), (7, "same text here for all to see twice"), (8, "same text here for all to see twice"),
    (8, "same text here for all to see twice"), (9, "z" * 30_000), (10, "ab cd " * 4_000), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, bucket string, n_words int")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(queries.vocabulary())


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def count_rows(rows):
    return sorted(rows, key=repr)


# --- 1 -----------------------------------------------------------------------------------------------


def test_urls_are_judged_exactly(spark):
    hosts = [f"h{i}.example.net" for i in range(3000)]
    urls = [(i, f"https://{h}/p?q", "old") for i, h in enumerate(hosts)] + [(-1, None, "x"), (-2, "no scheme", "x"), (-3, "http://A.Example.ORG/en/12#x", "x"), (-4, "http://example.org", "x"), (-5, "http://xorg/", "x")]
    pages = spark.createDataFrame(urls, "page_id long, url string, host string")
    listed = spark.createDataFrame([(f"{h}/p",) for h in hosts[::3]] + [("",), (None,)], "key string")
    for limit in (8_000_000, 400):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, queries.URL_RULES, max_filter_bytes=limit).collect()}
        assert len(got) == len(urls)
        assert all(got[i] == (h, "/p", None, "block" if i % 3 == 0 else "allow") for i, h in enumerate(hosts))
        assert got[-1] == got[-2] == ("", "", None, "allow")
        assert got[-3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
        assert got[-4] == ("example.org", "", None, "allow") and got[-5] == ("xorg", "/", None, "allow")


def test_url_levels_end_and_seed_their_hashes(spark, monkeypatch):
    """Keys left after the last level are compared themselves, and positions of levels differ for keys whose plain hashes agree."""
    keys = [f"h{i}/p" for i in range(2000)]
    pages = spark.createDataFrame([(i, "http://" + k) for i, k in enumerate(keys)], "page_id long, url string")
    listed = spark.createDataFrame([(k,) for k in keys[::4]], "key string")
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(url_filter, "MAX_LEVELS", 3)
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, listed, []).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(2000))
    first = spark.range(1).select(*(F.xxhash64(F.lit(i), F.lit("key")) == F.xxhash64(F.lit("key"), F.lit(i)) for i in range(3))).first()
    assert not any(first)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, spark.createDataFrame([], "key string"), []).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------


def brute_hits(docs, items, n=13):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return count_rows(out)


def test_hits_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, line(rng.choice([3, 5, 13, 20, 40]))) for i in range(12)] + [(50, None), (51, "..."), (52, "Rare Word"), (53, "a a a")]
    docs = list(ODD)
    for i in range(30):
        own = rng.choice(items[:12])[1]
        docs = docs + [(100 + i, f"{line(40)}, {own.upper()}; {line(7)}" if i % 2 else line(70))]
    docs = docs + [(200, "rare-word rare"), (201, "a a a a a"), (100, "another text of the same id " + items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.phrase_hits(d, b).collect()]
    assert count_rows(got) == brute_hits(docs, items)


def test_only_candidates_words_are_joined(spark):
    docs = spark.createDataFrame([(i, f"a b c d word{i}") for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "c d word3")], "item_id string, text string")
    hits = decontaminate.marked(decontaminate.stored(decontaminate.split_documents(docs), "words"), items)
    assert [(r.doc_id, r.n_hit) for r in hits.collect()] == [(3, 3)]
    assert "LeftSemi" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_decontaminate_keeps_clean_rows_whole(spark):
    docs = spark.createDataFrame([(1, "clean text", "k"), (2, "the benchmark phrase stands here", "k"), (None, None, "k")], "doc_id long, text string, term string")
    items = spark.createDataFrame([(1, "benchmark phrase")], "item_id long, text string")
    assert count_rows(decontaminate.decontaminate(docs, items).collect()) == count_rows([(1, "clean text", "k"), (None, None, "k")])
    assert decontaminate.phrase_hits(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 3


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "cat x x dog"), (2, "dog cat"), (3, "cat x x x x x x dog")], "doc_id long, text string")
    keyed = decontaminate.split_documents(docs)
    pairs = spark.createDataFrame([(9, "cat", "dog")], "pair_id long, term_a string, term_b string")
    index = decontaminate.postings(keyed, kept(spark.createDataFrame([("cat",), ("dog",)], "term string")))
    assert {(r.doc_id, r.distance) for r in decontaminate.proximity(index, pairs, 3).collect()} == {(1, 3), (2, 1)}


# --- 3 -----------------------------------------------------------------------------------------------


def brute_repeats(docs, n):
    from collections import Counter

    words = [(t or "").encode().split() for _, t in docs]
    count = Counter(tuple(w[s : s + n]) for w in words for s in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {k for s in range(len(w) - n + 1) if count[tuple(w[s : s + n])] > 1 for k in range(s, s + n)}
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return count_rows(out)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40 if seed else 2)]
    line = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [line(rng.randint(20, 90)) for _ in range(6)]
    docs = list(ODD)
    for i in range(40):
        w = line(rng.randint(0, 60)) + rng.choice(shared) + line(rng.randint(0, 9)) + rng.choice(shared)[rng.randint(0, 9) :]
        docs.append((100 + i, rng.choice([" ", "\n", "  \t"]).join(w)))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"))
    assert count_rows((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats(docs, substring_dedup.WINDOW)


def test_the_automaton_decides():
    """Without its passage in the automaton a repeat stays."""
    import pyarrow as pa

    words = [f"w{i}".encode() for i in range(60)]
    passages = pa.table({"words": pa.array([b" ".join(words[5:45]), b" ".join(words[20:60])]), "good": pa.array([None, [0, 1, 5]], pa.list_(pa.int32()))})
    texts = [words, words[:40], [b"x", *words[4:46], b"y"]]
    both = substring_dedup.covered(texts, passages, 35)
    assert np.flatnonzero(both[0]).tolist() == list(range(5, 60)) and both[1] is None and np.flatnonzero(both[2]).tolist() == list(range(2, 42))
    one = substring_dedup.covered(texts, passages.slice(1), 35)
    assert np.flatnonzero(one[0]).tolist() == list(range(20, 60)) and one[2] is None
    assert substring_dedup.covered(texts, passages.slice(0, 0), 35) == [None] * 3


def test_repeats_keep_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 7, "k"), (2, text + " tail", 8, "l")], "doc_id long, text string, _bucket int, fp string")
    got = sorted((r.doc_id, r._bucket, r.fp, r.kept_text) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [(1, 7, "k", ""), (2, 8, "l", "tail")]
    out = bpe.encode_documents(df, queries.vocabulary(), ("n_tokens",)).collect()
    assert sorted((r.doc_id, r._bucket, r.fp) for r in out) == [(1, 7, "k"), (2, 8, "l")]
    items = spark.createDataFrame([(1, text), (1, "w39 tail"), (None, "tail")], "item_id long, text string")
    marked = decontaminate.phrase_hits(df, items).collect()
    assert sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in marked) == [(1, 40, ("1",)), (2, 41, ("1",))]
    clash = df.withColumnsRenamed({"_bucket": "_h", "fp": "bad_id"})
    assert decontaminate.decontaminate(clash, items.limit(0)).columns == clash.columns


def test_kept_text_has_the_kept_words(spark, odd):
    rows = substring_dedup.dedup_substrings(odd).collect()
    assert len(rows) == len(ODD) and all(r.bucket == "x" for r in rows)
    for r in rows:
        assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256
        assert r.kept_text == r.text or r.n_removed
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


# --- 4 and 6 -----------------------------------------------------------------------------------------


def test_ids_and_texts_equal_the_library(spark, odd, tokenizer):
    shared = " ".join(f"Word{i}, and more." for i in range(900))
    rows = ODD + [(20, shared), (21, "Intro. " + shared), (22, shared + "tail"), (23, shared.replace(" ", "")), (24, "x" * 5000 + " " + shared)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = count_rows((r.doc_id, tuple(np.frombuffer(r.ids, "<u2").tolist()), r.decoded) for r in bpe.encode_documents(df, queries.vocabulary()).collect())
    expected = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == count_rows(expected)
    assert bpe.encode_documents(empty(spark), queries.vocabulary()).count() == 0


def test_words_equal_the_library(tokenizer):
    """Marks that normalisation makes meet punctuation; every letter meets every mark of punctuation."""
    import random

    rng = random.Random(5)
    letters = [chr(c) for c in range(0x21, 0x3000) if chr(c).isprintable()] + list("BELEDİYESİহয়क़Éß中国ÅΣς\u0301")
    texts = ["BELEDİYESİ. ", "হয়, ", "क़?", "it's, don't! a.b. 'S x'LL", "<|endoftext|>. a<|ENDOFTEXT|>, b<|endoftext|>!"]
    for c in letters:
        texts += [c + m + " a" for m in (".", ",", ";", ":", "!", "?", "...")] + ["A" + c + ",\n" + c.upper() + "'s."]
    texts += ["".join(rng.choice(letters + list("abcABC.,!' \t") * 30) for _ in range(20)) for _ in range(5000)]
    encoder = bpe.WordEncoder(queries.vocabulary(), 3000)
    got = [x for i in range(0, len(texts), 1000) for x in encoder.encode(texts[i : i + 1000])]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want


def test_chunks_are_content_defined():
    body = " ".join(f"w{i * i * 7919 % 100_003}" for i in range(4000))
    one, two = bpe.chunks(body), bpe.chunks("another beginning " + body)
    assert "".join(one) == body and len(one) > 3
    assert len(set(one[1:]) & set(two)) >= len(one) - 2


def test_store_round_trip(spark, odd, tokenizer):
    folder = token_store.write_tokens(odd, queries.vocabulary())
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    assert sorted(((r.doc_id is not None, r.doc_id) for r in got)) == [(r.doc_id is not None, r.doc_id) for r in got]
    start, texts = 0, {}
    for i, t in ODD:
        texts.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(r.ids)
        start += len(ids)
    assert token_store.read_tokens(spark, token_store.write_tokens(empty(spark), queries.vocabulary())).count() == 0


def test_blocks_decode_from_any_checkpoint():
    rng = np.random.default_rng(1)
    ids = rng.choice(50, 3 * token_store.EVERY * token_store.LANES + 77, p=np.arange(1, 51) / 1275).astype(np.uint16)
    coder = token_store.Coder(token_store.scaled(np.bincount(ids, minlength=50)))
    payload, states, places = coder.encode(ids)
    assert (coder.decode(payload, states, places, len(ids)) == ids).all() and len(places) == 4
    step = token_store.EVERY * token_store.LANES
    assert (coder.segment(payload, states, places, 2, len(ids)) == ids[2 * step : 3 * step]).all()
    assert len(payload) < 0.8 * len(ids)
    for counts in ([7], [1, 0, 10**9], [1] * 400):
        assert token_store.scaled(np.array(counts)).sum() == 1 << token_store.SCALE


# --- 5 -----------------------------------------------------------------------------------------------


def brute_classes(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(tuple(sorted(g)) for g in groups.values())


def test_classes_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    docs = [(i, t) for i, t in ODD if i is not None]
    for base in range(12):
        text = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 40, 120]))]
        for v in range(9):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            docs.append((1000 + 20 * base + v, " ".join(copy)))
    got = {}
    for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.class_id if r.class_id not in (1, 2, 3) else -r.doc_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in got.values()) == brute_classes(docs)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(25):
        w = list(base)
        for k in rng.choice(60, 3, replace=False):
            w[k] = f"v{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    got = {}
    for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in got.values()) == brute_classes(docs)


def test_one_copy_stays(spark, odd):
    left = near_dedup.drop_near_copies(odd).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert sum(r.doc_id is None for r in left) == 1
    assert near_dedup.drop_near_copies(empty(spark)).count() == 0


def test_another_text_under_the_id_of_a_copy_stays(spark):
    a, b, c = ("alpha " * 3 + "one two three four", "beta five six seven eight nine", "gamma ten eleven twelve thirteen fourteen")
    rows = [("3", b, 1), ("5", a, 1), ("5", b, 1), ("6", c, 1), ("6", c, 1), (None, c, 1)]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id string, text string, _node int")).collect()
    assert sorted(((r.doc_id or "", r.text) for r in left)) == [("", c), ("3", b), ("5", a)]


@pytest.mark.parametrize(("wa", "wb"), [(1.0, 1.0), (3.0, 5.5), (0.4, 2.0)])
def test_darts_estimate_weighted_similarity(wa, wb):
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(1, 2**63, 150).astype(np.uint64)])
    own = np.repeat([0, 1], [300, 350])
    sig = near_dedup.dart_signatures(np.concatenate([a, b]), own, np.repeat([wa, wb], [300, 350]), 2, 4096)
    true = 200 * min(wa, wb) / (200 * max(wa, wb) + 100 * wa + 150 * wb)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


# --- 8 -----------------------------------------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[700:730] = x[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] * 32, 0), (2003, [None] * 32, 0), (2020, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        score = y @ y[q]
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-score[i], i))[:10]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(abs(s - score[v]) < 1e-9 for _, v, s in found)
    assert hits / (10 * len(got)) >= 0.9


def test_nearest_groups_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    x[1:450:3] = x[1] * (1 + 1e-3 * rng.normal(size=(150, 16)))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "BLOCK_VALUES", 16 * 40)
    home = ann.hashed(ann.least_of_equal(ann.usable(df, "vec_id", "embedding"), 6), 1)
    assert home.count() == 600 + 6
    mine, theirs = ann.dealt(home, ann.hashed(ann.usable(df, "vec_id", "embedding"), ann.PROBES), 40)
    for rows in (mine, theirs):
        assert rows.groupBy("key", "salt", "part").count().agg(F.max("count")).first()[0] <= 80
    assert mine.select("id", "key", "salt").distinct().count() == 16 * 606 and mine.filter("salt > 0").count() > 0
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 30 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(0, 900, 30):
        score = x.astype(np.float64) @ x[i].astype(np.float64)
        assert got[i] == sorted((j for j in range(900) if j != i), key=lambda j: (-score[j], j))[:5]


def test_vectors_of_odd_ids_and_lengths(spark):
    rows = [(i, [float(i % 7), 1.0, float(-i)]) for i in range(1, 41)] + [(None, [1.0, 1.0, 1.0]), (60, [1.0, 2.0]), (80, [1.0, 2.0, 3.0, 4.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0 or vec_id is null"), 50).collect()
    assert {r.query_id for r in got} == {20, 40} and {r.vec_id for r in got} == set(range(1, 41))
    odd = df.filter("vec_id > 50")
    assert ann.usual_length(ann.usable(odd, "vec_id", "embedding")) == 2 and ann.nearest(odd, odd, 3).count() == 0


def test_few_vectors_find_all(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id = 20"), 20).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------


def test_quotes_are_parsed_and_linked(spark):
    body, quotes = chat.parse("On Monday you wrote:\n> one\n> two\n>> deep\n> three\nmine")
    assert body == "On Monday you wrote:\nmine" and quotes == [(1, "one\ntwo"), (2, "deep"), (1, "three")]
    rows = [
        (1, 0, "Hello there.", "a"), (1, 1, "> hello  THERE\nHi", "b"), (1, 2, ">> Hello there.\n> Hi\nBye", "c"), (1, 3, "> Hello there.\nOther", "d"),
        (1, 4, "> unknown\nLone", "e"), (2, 0, None, "f"), (2, 1, "> Hello there.\nNo", "g"), (None, 0, "x", "h"), (None, 1, "> x\ny", "i"), (1, 900, ">Bye\nLate", "j"),
    ]
    got = {r.root_: tuple(r)[:-1] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, msg_id long, text string, depth string")).select("conv_id", "msg_id", "parent", "root", "depth", "text", F.concat_ws("-", "conv_id", "msg_id").alias("root_")).collect()}
    assert got["1-1"] == (1, 1, 0, 0, 1, "Hi") and got["1-2"] == (1, 2, 1, 0, 2, "Bye") and got["1-3"] == (1, 3, 0, 0, 1, "Other")
    assert got["1-4"] == (1, 4, None, 4, 0, "Lone") and got["2-1"] == (2, 1, None, 1, 0, "No") and got["1"] == (None, 1, 0, 0, 1, "y")
    assert got["1-900"] == (1, 900, 2, 0, 3, "Late")


def test_automata_read_only_stretches_whose_grams_are_known():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}".encode()
    copied = [[word() for _ in range(rng.randrange(12, 30))] for _ in range(6)]
    texts = [[word() for _ in range(200)] for _ in range(8)] + [[]]
    for i, c in enumerate(copied):
        texts[i][20 * i : 20 * i] = c
        texts[i + 2][5:5] = c[:11]  # a word less than a window
    passages = pa.table({"words": pa.array([b" ".join(c) for c in copied], pa.binary()), "good": pa.array([None] * 6, pa.list_(pa.int32()))})
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    parts = substring_dedup.stretches(flat.indices.to_numpy(), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), passages, flat.dictionary, 12)
    assert sum(b - a for a, b in parts) < 250 and len(parts) == 6
    expected = [any(t[i : i + len(c)] == c for i in range(len(t)) for c in copied) for t in texts]
    covers = substring_dedup.covered(texts, passages, 12)
    assert [c is not None for c in covers] == expected
    assert [int(c.sum()) for c in covers[:6]] == [len(c) for c in copied]
