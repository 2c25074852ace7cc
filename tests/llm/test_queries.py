"""Registered training-data queries: against SQL, brute force or held-out labels on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF, same_as_sql

from siftworks.llm import labelled, near_dedup, quality, queries, sql, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert same_as_sql(queries.QUERIES[name](spark, SF), duck, sql.ORACLES[name]) > 0


def test_op4_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, SF).collect()}
    for i, text in docs():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[i] == want


def test_op6_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(queries.vocabulary()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_store(spark, SF).collect()}
    for i, text in sorted(docs()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5_equals_brute_force(spark):
    from test_small import brute_classes

    got = {}
    for r in queries.op5_minhash(spark, SF).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in got.values()) == brute_classes(docs())


def test_op8_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, ids = np.array(t["embedding"], np.float64), np.array(t["vec_id"])
    got = {}
    for r in queries.op8_nearest(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hits += len(set(best) & got[q])
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize(("query", "label", "least"), [("op7_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = SF.replace("sf0.001", "sf0.01")
    t = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    truth = dict(zip(t["doc_id"], t[label], strict=True))
    rows = queries.QUERIES[query](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) >= least


def test_scores_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a\n\nb")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for score, model in ((quality.score_quality, quality.QualityModel), (toxicity.score_toxicity, toxicity.ToxicityModel)):
        trained = model(["good words here\nand there", "!!! ### $$$ %%%", "you idiot you idiot", "fine"], np.array([1.0, 0.0, 1.0, 0.0]))
        for m in (trained, model(*labelled.sample(odd.limit(0), labels, "toxic"))):
            rows = score(odd, m).collect()
            assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(odd.limit(0), trained).count() == 0


def test_field_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    score, step = rng.normal(size=7), rng.normal(size=(2, 2))
    own = np.array([0, 0, 0, 0, 1, 2, 2])
    got, _ = quality.forward_backward(score, step, own, 3)
    for d in range(3):
        at = np.flatnonzero(own == d)
        total, ones = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(s * k for s, k in zip(score[at], y, strict=True)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[at], ones / total)


def test_grammar_reads_paths():
    lex = toxicity.Lexicon({"idiot": 2.0})
    read = lambda t: {k: v for k, v in toxicity.clause_paths(lex.read(t)).items() if v}
    assert read("an idiot here") == {"I": 2} and read("you idiot") == {"A": 2} and read("idiot you") == {"A": 2}
    assert read("not an idiot") == {"i": 2} and read("not a b c idiot") == {"I": 2}
    assert read("they said idiot kill") == {"r": 3} and read("kill them") == {"D": 1} and read("never kill") == {"t": 1}
    assert read("") == {} and lex.read("idiotic")[0] == ("I", 2.0)


def test_best_path_equals_enumeration_of_paths():
    import itertools

    def paths(t, marks):
        found = [(0.0, t.start, ())]
        for m in marks:
            found = [(w + v, n, (*out, x)) for w, s, out in found for x, v, n in t.arcs.get(s, {}).get(m, ())]
        return [(w + t.final[s], list(out)) for w, s, out in found if s in t.final]

    rng = np.random.default_rng(3)
    T = toxicity.Transducer
    make = lambda: T(0, {s: {m: [("ab"[rng.integers(2)], float(rng.integers(9)), int(rng.integers(3))) for _ in range(rng.integers(1, 3))] for m in "ab"} for s in range(3)}, {0: 0.0, 2: 1.0})
    one, two = make(), make()
    both = toxicity.compose(one, two)
    for marks in itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(6)):
        chained = [(w1 + w2, out2) for w1, out1 in paths(one, marks) for w2, out2 in paths(two, out1)]
        assert sorted(chained) == sorted(paths(both, marks))
        best = toxicity.best_path(both, list(marks))
        assert (best is None and not chained) or best[0] == max(w for w, _ in chained) and best in [(w, o) for w, o in chained]
    for marks in itertools.product("OITYNR", repeat=4):
        assert len(paths(toxicity.GRAMMAR, marks)) == 1  # a clause is read in one way


def test_stems_break_ties_alike():
    texts, toxic = ["zulu yank"] * 6 + ["good"] * 6, np.array([1.0] * 6 + [0.0] * 6)
    assert list(toxicity.learn_stems(texts, toxic)) == ["yank", "zulu"]
    assert toxicity.learn_stems([], np.zeros(0)) == {}


def test_long_texts_of_short_lines_score_alike(monkeypatch):
    texts = ["good words here\nand there", "!!! ### $$$ %%%", "fine", "### %%%"]
    model = quality.QualityModel(texts, np.array([1.0, 0.0, 1.0, 0.0]))
    long = ["\n".join(["a b", "### %%%", ""] * 50), None, "x"]
    whole = model(long)
    monkeypatch.setattr(quality, "LINES", 7)
    assert np.allclose(model(long), whole)


def test_pipeline_stages(spark):
    frame = queries.table(spark, SF, "documents")
    columns, before = frame.columns, frame.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, SF), name)
        assert frame.columns == columns and 0 < frame.count() <= before
        before = frame.count()
        if name == "near_dedup":
            classes = near_dedup.near_classes(frame)
            assert classes.select("class_id").distinct().count() == before
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == before
