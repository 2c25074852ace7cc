"""Toxicity with a weighted finite-state pattern grammar.

A text is cut into clauses. A clause is read by a chain of weighted transducers:

  lexicon    words -> marks: I insult, T threat, each with the word's weight; Y target, N negation, R reported
             speech, O any other word. A trie of word beginnings, the longest one counts.
  negation   I, T -> i, t within REACH words after an N
  report     I, T, i, t -> r after an R, up to the clause's end
  target     I, T -> A, D in a clause with a Y; it guesses at the clause's begin and only right guesses end

Negation, report and target are composed once (`compose`); a clause's best accepted path (`best_path`) gives every
insult and threat its class: aimed (A, D), plain (I, T), negated (i, t) or reported (r). A document's features are
what its matched clauses weigh by class; the arcs' weights by class are learned as a logistic function, so a word
counts as the path says on which it was read, and words outside matched clauses don't count.

The insult stems and their weights are learned: word beginnings and whole words of SUPPORT or more toxic sample texts
that hardly stand in clean ones. The sample is bounded (`labelled.SAMPLE_PER_LABEL` rows of either label), and with it
the lexicon. Ties between stems go to the shorter, then to the lesser one. Null and empty texts have no clause and get
the score of that. An empty sample, or one of a single label, gives every text the share of label 1 (0 if empty). Extra
columns stay out of `score_toxicity` and are kept by `drop_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import Logistic, held_out, sample, scores

REACH = 3
CLAUSE = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+")
# Seed words of the marks in English, German, French and Spanish.
THREAT = "kill hurt destroy crush beat burn stab shoot töten schlagen vernichten tuer détruire frapper matar golpear destruir".split()
TARGET = "you your he she they him her them du ihr dich euch tu vous toi ellos usted ustedes".split()
NEGATION = "not never no isn aren nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTED = "said says called claims wrote quoted sagte sagt schrieb dit écrit dijo dice escribió".split()
#: Lengths of word beginnings that may become stems; the support (texts, or share of the toxic texts) and purity that they need.
LENGTHS, SUPPORT, SHARE, PURITY = range(4, 13), 5, 0.04, 0.85
#: Words that a worker remembers, alternatives in one pattern, and classes of matched words.
CACHE_WORDS, ALTERNATIVES, CLASSES = 50_000, 500, "AIDTitr"


class Transducer:
    """Weighted, without empty labels. arcs: state -> read mark -> [(written mark, weight, next state)]; final: state -> weight."""

    def __init__(self, start, arcs: dict, final: dict):
        self.start, self.arcs, self.final = start, arcs, final


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What `b` makes of what `a` writes; weights add up along a path."""
    start, arcs, final = (a.start, b.start), {}, {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        x, y = state
        arcs[state] = {}
        for read, ways in a.arcs.get(x, {}).items():
            arcs[state][read] = [(w2, v1 + v2, (n1, n2)) for w1, v1, n1 in ways for w2, v2, n2 in b.arcs.get(y, {}).get(w1, ())]
            todo += [n for _, _, n in arcs[state][read]]
        if x in a.final and y in b.final:
            final[state] = a.final[x] + b.final[y]
    return Transducer(start, arcs, final)


def best_path(t: Transducer, marks: list[str]) -> tuple[float, list[str]] | None:
    """The heaviest accepted path over the marks and what it writes; None if there is none. Ties go to the path found first."""
    live = {t.start: (0.0, None)}
    for mark in marks:
        after: dict = {}
        for state, (weight, back) in live.items():
            for written, w, state2 in t.arcs.get(state, {}).get(mark, ()):
                if state2 not in after or after[state2][0] < weight + w:
                    after[state2] = (weight + w, (back, written))
        live = after
    ends = [(weight + t.final[state], back) for state, (weight, back) in live.items() if state in t.final]
    if not ends:
        return None
    weight, back = max(ends, key=lambda e: e[0])
    out = []
    while back is not None:
        back, written = back
        out.append(written)
    return weight, out[::-1]


def negation() -> Transducer:
    arcs = {}
    for k in range(REACH + 1):
        less = max(k - 1, 0)
        same = {m: [(m, 0.0, less)] for m in "OYR"}
        arcs[k] = same | {m: [(m.lower() if k else m, 0.0, less)] for m in "IT"} | {"N": [("O", 0.0, REACH)]}
    return Transducer(0, arcs, dict.fromkeys(arcs, 0.0))


def report() -> Transducer:
    plain = {m: [(m, 0.0, 0)] for m in "OYITit"} | {"R": [("O", 0.0, 1)]}
    told = {m: [(m, 0.0, 1)] for m in "OY"} | {m: [("r", 0.0, 1)] for m in "ITit"} | {"R": [("O", 0.0, 1)]}
    return Transducer(0, {0: plain, 1: told}, {0: 0.0, 1: 0.0})


def target() -> Transducer:
    plain = {m: [(m, 0.0, "plain")] for m in "OITitr"}
    aimed = {m: [(to, 0.0, "aimed")] for m, to in zip("OITitr", "OADitr", strict=True)} | {"Y": [("O", 0.0, "seen")]}
    seen = {m: [(to, 0.0, "seen")] for m, ((to, _, _),) in aimed.items()}
    both = {m: plain.get(m, []) + aimed[m] for m in aimed}
    return Transducer("begin", {"begin": both, "plain": plain, "aimed": aimed, "seen": seen}, {"begin": 0.0, "plain": 0.0, "seen": 0.0})


GRAMMAR = compose(compose(negation(), report()), target())


class Lexicon:
    """The lexical transducer: marks and weights of words, by learned beginnings and fixed words."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.longest = max(map(len, stems), default=0)
        self.fixed = {w: (m, 1.0) for m, ws in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORTED)) for w in ws}
        self.known: dict[str, tuple[str, float]] = {}
        forms = [re.escape(f.removesuffix("$")) for f in stems] + THREAT
        #: Patterns of which a lower-case text with an insult or a threat matches one.
        self.patterns = ["|".join(forms[i : i + ALTERNATIVES]) for i in range(0, len(forms), ALTERNATIVES)]

    def _read(self, word: str) -> tuple[str, float]:
        for n in range(min(self.longest, len(word)), 0, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return ("I", w)
        if (w := self.stems.get(word + "$")) is not None:
            return ("I", w)
        return self.fixed.get(word, ("O", 0.0))

    def read(self, clause: str) -> list[tuple[str, float]]:
        """Marks and weights of a clause's words."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, words = self.known, WORD.findall(clause)
        for w in words:
            if w not in known:
                known[w] = self._read(w)
        return [known[w] for w in words]

    def may_match(self, texts: pa.Array) -> np.ndarray:
        """Which lower-case texts can hold an insult or a threat."""
        out = np.zeros(len(texts), bool)
        for p in self.patterns:
            out |= pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)
        return out


def forms_of(text: str) -> set[str]:
    """Beginnings of a text's words, and its whole words with `$`."""
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in LENGTHS if n <= len(w)} | {w + "$" for w in words}


def learn_stems(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Beginnings and whole words (`word$`) of the sample with their log odds, none the beginning of another."""
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    bad: Counter = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            bad.update(forms_of(t))
    bad = {f: b for f, b in bad.items() if b >= max(SUPPORT, SHARE * n_bad)}
    good: Counter = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            good.update(f for f in forms_of(t) if f in bad)
    found = {}
    for form, b in bad.items():
        rate_b, rate_g = b / n_bad, good.get(form, 0) / n_good
        if rate_b / (rate_b + rate_g) >= PURITY:
            found[form] = float(np.log((b + 0.5) / n_bad) - np.log((good.get(form, 0) + 0.5) / n_good))
    out: dict[str, float] = {}
    for f in sorted(found, key=lambda f: (-found[f] * np.log1p(bad[f]), len(f), f)):
        if not any(f[:n] in out for n in range(1, len(f))):
            out[f] = found[f]
    return out


def clause_paths(marks: list[tuple[str, float]]) -> dict[str, float]:
    """Weights of the clause's insults and threats by the class that the best path gives them."""
    out = dict.fromkeys(CLASSES, 0.0)
    path = best_path(GRAMMAR, [m for m, _ in marks])
    for written, (_, weight) in zip(path[1] if path else (), marks, strict=False):
        if written in out:
            out[written] += weight
    return out


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Per text: weights of its matched clauses by class (log), then of aimed and plain words (A, I, D, T) alone: the heaviest clause, weight a word, clauses (log)."""
    lower = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
    out = np.zeros((len(texts), len(CLASSES) + 3))
    for i in np.flatnonzero(lexicon.may_match(lower)):
        total, most, clauses, n = np.zeros(len(CLASSES)), 0.0, 0, 0
        for clause in CLAUSE.split(lower[i].as_py()):
            marks = lexicon.read(clause)
            n += len(marks)
            if any(m in "IT" for m, _ in marks):
                paths = np.array([*clause_paths(marks).values()])
                held = max(paths[:4].sum(), 0.0)
                total += paths
                most, clauses = max(most, held), clauses + (held > 0)
        out[i, : len(CLASSES)] = np.log1p(np.maximum(total, 0))
        out[i, len(CLASSES) :] = most, 100 * max(total[:4].sum(), 0.0) / (n + 20), np.log1p(clauses)
    return out


class ToxicityModel:
    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.constant = float(toxic.mean()) if len(toxic) else 0.0
        self.logistic, self.lexicon = None, Lexicon({})
        if len(set(toxic)) < 2:
            return
        self.lexicon = Lexicon(learn_stems(texts, toxic))
        # The clause weights are fitted on texts that the stems weren't learned from, in two folds.
        half, x = np.arange(len(texts)) % 2 == 0, np.zeros((len(texts), len(CLASSES) + 3))
        for fold in (half, ~half):
            own = learn_stems([t for t, k in zip(texts, fold, strict=True) if k], toxic[fold])
            x[~fold] = features([t for t, k in zip(texts, fold, strict=True) if not k], Lexicon(own))
        self.logistic = Logistic(np.concatenate([x, x[toxic == 0]]), np.concatenate([toxic, toxic[toxic == 0]]))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.constant)
        return self.logistic(features(texts, self.lexicon))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel(*sample(docs, labels, "toxic"))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score of each text. Only the texts go to Python and only the scores come back; rows stay where they are."""
    return scores(model)(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = docs.select("doc_id", toxicity_score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rejected documents, all columns as they were."""
    return docs.filter(toxicity_score(model, F.col("text")) < threshold)
