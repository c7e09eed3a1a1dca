"""Toxicity: a Levenshtein automaton runs over a trie of learned terms, and the words around a hit tell abuse from quotation."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import only_store, release, ship

#: Labelled rows that the lexicon and the weights are fitted on (those with the smallest hash of the id).
TRAIN_DOCS = 20_000
#: Terms at most, and what a term's counts must say: log-likelihood ratio statistic and odds.
MOST_TERMS, LEAST_EVIDENCE, LEAST_ODDS = 400, 16.0, 3.0
STEM = (4, 8)
#: Words to either side of a hit that count as its context.
WINDOW = 8
#: States that the automaton keeps; beyond that it starts over.
MOST_STATES = 200_000

TOKEN = re.compile(r"\w[\w@$*]*\w|\w")
QUOTES = re.compile("[\"“”«»„]")
N_FEATURES = 8


def errors(term: str, stem: bool) -> int:
    """Edits that a term of this length allows."""
    n = len(term) - 2 * stem
    return 0 if n < 4 else 1 if n < 8 else 2


class Automaton:
    """All words within a term's edit distance, as one lazily built deterministic automaton.

    A state is a set of (trie node, edits so far): the product of the trie with the Levenshtein automaton of every
    term at once. Steps are kept, so a word costs a look-up per character, and most words end in the empty state soon.
    Stems accept as soon as they are read; words at the end.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allow = [0]
        self.terms = terms
        for i, (term, stem) in enumerate(terms):
            node, k = 0, errors(term, stem)
            self.allow[0] = max(self.allow[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allow.append(0)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], k)
            self.ends[node].append(i)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.word: list[tuple[int, int] | None] = []  # (edits, term) if a word ends here
        self.stem: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs) -> int:
        """The number of a state after leaving out characters of the trie; -1 for the empty one."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.allow[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            found: list[list[tuple[int, int]]] = [[], []]
            for node, e in key:
                for t in self.ends[node]:
                    if e <= errors(*self.terms[t]):
                        found[self.terms[t][1]].append((e, t))
            self.word.append(min(found[0], default=None))
            self.stem.append(min(found[1], default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            out.add((node, e + 1))
            for d, child in self.children[node].items():
                out.add((child, e + (c != d)))
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state, stem = self.start, None
        for c in word:
            step = self.steps[state]
            if c in step:
                state = step[c]
            else:
                state = step[c] = self._step(state, c)
            if state < 0:
                return stem
            s = self.stem[state]
            if s and (stem is None or s < stem):
                stem = s
        last = self.word[state]
        return min((x for x in (last, stem) if x), default=None)


def features(text: str, automaton: Automaton, weights: list[float]) -> list[float]:
    """What the score sees of a text: summed weights of exact, misspelled and stem hits outside quotation marks, of hits inside
    them, the densest window, distinct terms, the share of hits, and the length."""
    low = text.lower()
    hits = []
    n = 0
    match = automaton.match
    for n, m in enumerate(TOKEN.finditer(low), 1):
        found = match(m[0])
        if found:
            hits.append((n, m.start(), *found))
    out = [0.0] * N_FEATURES
    out[7] = math.log1p(n)
    if not hits:
        return out
    marks = [m.start() for m in QUOTES.finditer(low)]
    places = [h[0] for h in hits]
    for at, char, e, term in hits:
        near = bisect_right(places, at + WINDOW) - bisect_right(places, at - WINDOW - 1)
        out[4] = max(out[4], float(min(near, 4)))
        quoted = bisect_right(marks, char) % 2 == 1 and bisect_right(marks, char) < len(marks)
        out[3 if quoted else 2 if automaton.terms[term][1] else 1 if e else 0] += weights[term] / (1 + e)
    out[:4] = [math.log1p(x) for x in out[:4]]
    out[5] = math.log1p(len({h[3] for h in hits}))
    out[6] = math.log1p(100 * len(hits) / n)
    return out


class Model:
    def __init__(self, terms: list[tuple[str, bool]], weights: list[float], bias: float, slopes: list[float]):
        self.terms, self.weights, self.bias, self.slopes = terms, weights, bias, slopes

    @property
    def automaton(self) -> Automaton:
        """The worker's automaton for these terms, with the steps that earlier tasks built."""
        store = only_store("automata")
        key = tuple(self.terms)
        if key not in store:
            store.clear()
            store[key] = Automaton(self.terms)
        return store[key]

    def features(self, text: str, automaton: Automaton | None = None) -> list[float]:
        return features(text, automaton or self.automaton, self.weights)

    def score(self, text: str, automaton: Automaton | None = None) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, self.features(text, automaton)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def evidence(yes, no, all_yes, all_no) -> Column:
    """Log-likelihood ratio statistic of a term's document counts in both classes."""
    rate = (yes + no) / (all_yes + all_no)

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    return 2 * (part(yes, rate * all_yes) + part(no, rate * all_no))


def _lexicon(sample: DataFrame, all_yes: int, all_no: int) -> tuple[list[tuple[str, bool]], list[float]]:
    """Words and stems that mark the class, and their log odds."""
    def count(batches):
        only_store("automata")
        yes, no = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (yes if toxic else no).update(w for w in set(TOKEN.findall(text.lower())) if len(w) <= 32)
        words = list(yes.keys() | no.keys())
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([yes[w] for w in part], pa.int64()),
                                              pa.array([no[w] for w in part], pa.int64())], names=["word", "yes", "no"])
        del yes, no, words
        release()

    words = sample.mapInArrow(count, "word string, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    lengths = F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.char_length("word")))
    keys = F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))),
                    F.when(F.char_length("word") >= STEM[0], F.transform(lengths, lambda n: F.struct(
                        F.substring("word", F.lit(1), n).alias("term"), F.lit(True).alias("stem")))).otherwise(
                        F.array().cast("array<struct<term:string,stem:boolean>>")))
    terms = words.withColumn("k", F.explode(keys)).groupBy("k.term", "k.stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    y, n, ay, an = F.least("yes", F.lit(all_yes)), F.least("no", F.lit(all_no)), F.lit(float(all_yes)), F.lit(float(all_no))
    odds = F.log((y + 0.5) / (ay + 1)) - F.log((n + 0.5) / (an + 1))
    found = terms.withColumns({"e": evidence(y, n, ay, an), "w": odds}).where(
        (F.col("e") >= LEAST_EVIDENCE) & (F.col("w") >= math.log(LEAST_ODDS))).orderBy(
        F.desc("e"), F.desc(F.char_length("term")), "stem", "term").limit(20 * MOST_TERMS).collect()
    kept: dict[tuple[str, bool], float] = {}
    for r in found:  # of terms that say the same, the one with the most evidence, longest first
        covered = any((r.term[:k], True) in kept for k in range(STEM[0], len(r.term) + 1))
        wider = r.stem and any(t.startswith(r.term) and w >= r.w - 0.7 for (t, _), w in kept.items())
        if not covered and not wider and len(r.term) >= 3 and len(kept) < MOST_TERMS:
            kept[(r.term, r.stem)] = r.w
    return list(kept), list(kept.values())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, list[float]]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), [float(v) for v in w[1:]]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_docs: int = TRAIN_DOCS) -> Model:
    """A model from labelled rows for which ``learn`` (over the labels' ids) holds. Of several labels the largest counts; null
    labels teach nothing. Without both classes the model has no terms and scores every text 0."""
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__toxic"))
    # the hash alone keeps about twice as many rows as are wanted; only those are put in order
    count, space = known.count(), 1 << 40
    place = F.pmod(F.xxhash64("__id"), F.lit(space))
    chosen = known.where(place < (space if count <= 2 * train_docs else 2 * train_docs * space // count)).groupBy("__id").agg(
        F.max("__toxic").alias("__toxic")).orderBy(place, "__id").limit(train_docs)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "__id").select(F.col("__toxic").alias("toxic"), "text")
    totals = sample.agg(F.sum("toxic").alias("yes"), F.count(F.lit(1)).alias("n")).first()
    yes, no = totals.yes or 0, totals.n - (totals.yes or 0)
    if not yes or not no:
        return Model([], [], -30.0, [0.0] * N_FEATURES)
    terms, weights = _lexicon(sample, yes, no)
    model = Model(terms, weights, 0.0, [0.0] * N_FEATURES)

    def seen(batches):
        automaton = model.automaton
        for batch in batches:
            got = [model.features(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=["toxic", "x"])
        release()

    rows = sample.mapInArrow(seen, "toxic int, x array<double>").toPandas()
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["toxic"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    model.bias, model.slopes = _logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Per row: doc_id, the ``keep`` columns, score and predicted (score >= 0.5).

    Null texts count as empty; an empty text gets the score of a text without hits. Whole texts are read, one in memory at a
    time; the model is bounded by its parameters; no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *(keep or []), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    names = [*rows.columns[:-1], "score"]

    def run(batches):
        automaton = model.automaton
        for batch in batches:
            got = [model.score(t, automaton) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=names)

    return rows.mapInArrow(run, ", ".join([*schema, "score double"])).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns; null texts count as empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = model.automaton
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "", automaton) < 0.5 for t in batch.column(at)], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


ship(__name__)
