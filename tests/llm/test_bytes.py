"""Byte-level substring deduplication: against brute force, with odd rows, crowded grams and small blocks."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from siftworks.llm import queries, suffix_dedup


def brute(texts, window):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    texts, seen = [(t or "").encode() for t in texts], {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1)
        out.append((len(t), int(gone.sum()), len(edges), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def some_texts(rng, n):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    parts = [" ".join(word() for _ in range(rng.randrange(8, 30))) for _ in range(6)]
    return ["-".join([rng.choice(parts), " ".join(word() for _ in range(rng.randrange(12))), rng.choice(parts)][: rng.randrange(1, 4)]) for _ in range(n)]


@pytest.mark.parametrize(("block", "crowd"), [(1_000_000, 1_000_000), (500, 150), (500, 0)])
def test_bytes_equal_brute_force(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(suffix_dedup, "GRAMS", (8, 8, None))
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    texts = some_texts(random.Random(1), 60)
    texts += [None, "", "short", "z" * 500, "z" * 31, texts[0], texts[0], "x" * 40 + "y" * 40]
    rows = [(i, t, "k", 7) for i, t in enumerate(texts)] + [(None, texts[1], "k", 7), (0, texts[0], "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_sha256 string, doc int")
    got = suffix_dedup.dedup_bytes(df, window=32)
    assert got.columns == ["doc_id", "text", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    want = sorted(((str(r[0]), r[1] or "", *w) for r, w in zip(rows, brute([r[1] for r in rows], 32), strict=True)), key=repr)
    seen = got.collect()
    assert sorted(((str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in seen), key=repr) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in seen)
    assert any(r.n_removed for r in seen) and any(not r.n_removed for r in seen)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup_bytes(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_bytes(none, window=35)


def test_construction_equals_counting():
    rng = random.Random(3)
    for _ in range(40):
        window, base, texts = rng.choice([8, 16, 24]), "".join(rng.choice("ab") for _ in range(60)).encode(), []
        for _ in range(rng.randrange(1, 12)):
            size = rng.randrange(window, 60)
            at = rng.randrange(61 - size)
            text = bytearray(base[at : at + size])
            text[rng.randrange(size)] = rng.choice(b"abc")
            texts.append(bytes(text))
        seen = {}
        for t in texts:
            for i in range(len(t) - window + 1):
                seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
        want = [i + window <= len(t) and seen[t[i : i + window]] > 1 for t in texts for i in range(len(t))]
        got = suffix_dedup.recurring(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), window)
        assert got.tolist() == want


def test_op13_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in zip(t["doc_id"], brute(t["text"], 200), strict=True)}
    rows = queries.op13_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
