"""Operator 8: toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: whole words and stems (first letters of words) that stand in toxic
training documents and hardly in others, picked one by one by how many toxic documents
without an entry so far they cover. Its trie, read by the automaton of words at most one
edit away, becomes one automaton whose states are made when first met; a word is a walk
through it and mostly ends after a few letters. Terms of fewer than FUZZY letters allow no
edit.

A hit counts as quoted if a quotation mark stands among the WINDOW words on either side,
else as abuse, and as exact or misspelled; a logistic regression on these counts gives the
score, so what each is worth is learned too (misspelled forms that clean texts hold, or
quotations, get little).

Lexicon and weights are fitted on SAMPLE labelled training rows at most (least hash of the
id first); scoring runs over all rows. Null and empty texts have no hit; without labelled
rows of both kinds every score is 0. Rows are independent, so ids may repeat or be null, and
equal texts get equal scores; an empty table stays empty. Labels of one id count as toxic if
one of them is. Ties between terms go to the longer one. Columns keep their values, whatever
their names, but for the score's own, which replaces one of its name. A text of any length
is scored whole; what is held is its lower-case copy and its words.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import release, text_batches, widened

SAMPLE = 8192
THRESHOLD = 0.7
FUZZY = 5
WINDOW = 6
LONGEST_STEM = 7
SHORTEST_STEM = 4
MOST_TERMS = 256
MEMO, MEMO_LETTERS = 1 << 17, 32
WORD = re.compile(r"[^\W\d_]+")
QUOTE = re.compile("[\"“”„«»‹›]")
FEATURES = 7


# ------------------------------------------------------------------------ automaton


class Automaton:
    """Words within one edit of the lexicon's terms: (term, is a stem) pairs."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple[bool, bool, bool]] = [(False, False, False)]  # word, stem, allows an edit
        for term, stem in terms:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.end.append((False, False, False))
                at = self.children[at][c]
            word, was, edit = self.end[at]
            self.end[at] = (word or not stem, was or stem, edit or len(term) >= FUZZY)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.word: list[int] = []  # the edits at which a word that ends here is in the lexicon; 9: none
        self.stem: list[int] = []
        self.start = self._state({(0, 0)})
        self.memo: dict[str, int] = {}

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The state of these (trie node, edits) pairs, -1 if none; a letter of the term may be left out at an edit."""
        found = set(found)
        found |= {(child, 1) for node, e in found if e == 0 for child in self.children[node].values()}
        least: dict[int, int] = {}
        for node, e in found:
            least[node] = min(e, least.get(node, 9))
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.step.append({})
            ok = [(e, *self.end[node]) for node, e in key if e == 0 or self.end[node][2]]
            self.word.append(min([e for e, word, _, _ in ok if word], default=9))
            self.stem.append(min([e for e, _, stem, _ in ok if stem], default=9))
        return self.states[key]

    def _next(self, state: int, c: str) -> int:
        found = set()
        for node, e in self.members[state]:
            if c in self.children[node]:
                found.add((self.children[node][c], e))
            if e == 0:
                found.add((node, 1))
                found |= {(child, 1) for child in self.children[node].values()}
        to = self.step[state][c] = self._state(found)
        return to

    def distance(self, word: str) -> int:
        """0 or 1: the least edits to a term (of a stem: from a beginning of the word); 9: more."""
        got = self.memo.get(word)
        if got is None:
            got, state = self._walk(word)
            if len(word) <= MEMO_LETTERS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def _walk(self, word: str) -> tuple[int, int]:
        state, best = self.start, 9
        for c in word:
            to = self.step[state].get(c)
            state = self._next(state, c) if to is None else to
            if state < 0:
                return best, state
            best = min(best, self.stem[state])
            if best == 0:
                return 0, state
        return min(best, self.word[state]), state

    def features(self, text: str) -> np.ndarray:
        """Of a text: 1, then for exact and misspelled hits whether and how many are abuse, and how many are quoted."""
        low = text.lower()
        seen = self.distance
        near = [d for d in map(seen, WORD.findall(low)) if d < 9]
        out = np.zeros(FEATURES)
        out[0] = 1
        if near:
            spans = [m.span() for m in WORD.finditer(low)]
            for i, (start, end) in enumerate(spans):
                d = seen(low[start:end])
                if d < 9:
                    around = low[spans[max(0, i - WINDOW)][0] : spans[min(len(spans) - 1, i + WINDOW)][1]]
                    out[(3 if QUOTE.search(around) else 2) + 3 * d] += 1
            out[[2, 3, 5, 6]] = np.log1p(out[[2, 3, 5, 6]])
            out[1], out[4] = min(out[2], 1), min(out[5], 1)
        return out


# --------------------------------------------------------------------------- fitting


def _terms(text: str) -> set[tuple[str, bool]]:
    words = set(WORD.findall(text.lower()))
    return {(w, False) for w in words if len(w) >= SHORTEST_STEM} | {(w[:k], True) for w in words for k in range(SHORTEST_STEM, LONGEST_STEM + 1) if len(w) > k}


def learn_lexicon(toxic: list[str], clean: list[str]) -> list[tuple[str, bool]]:
    """Greedy cover of the toxic texts by terms that are at least 40 times as frequent in them as in clean ones."""
    # A text's terms are made again when they are needed: to hold those of all texts takes far more than the texts.
    support = Counter()
    for t in toxic:
        support.update(_terms(t))
    least = max(3, len(toxic) // 200)
    kept = {x for x, n in support.items() if n >= least}
    support = {x: support[x] for x in kept}
    against = Counter(x for t in clean for x in _terms(t) & kept)
    kept = {x for x in kept if support[x] / len(toxic) >= 40 * (against[x] + 0.1) / max(1, len(clean))}
    where: dict[tuple[str, bool], set[int]] = {x: set() for x in kept}
    for i, t in enumerate(toxic):
        for x in _terms(t) & kept:
            where[x].add(i)
    chosen, left = [], set(range(len(toxic)))
    while where and len(chosen) < MOST_TERMS:
        # Ties: the longer term, then a word before a stem.
        best = max(where, key=lambda x: (len(where[x] & left), len(x[0]), not x[1], x[0]))
        if len(where[best] & left) < least:
            break
        chosen.append(best)
        left -= where.pop(best)
    # Words that the cover had no need for, but that nearly only toxic texts hold, and often.
    more = [x for x in where if not x[1] and support[x] >= max(least, len(toxic) // 50) and not against[x]]
    return chosen + sorted(more, key=lambda x: -support[x])[: MOST_TERMS - len(chosen)]


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), pull)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> dict:
    """The model of a sample; texts that repeat count once."""
    rows = sorted({(t, y) for t, y in zip(texts, toxic, strict=True)})
    one, none = [t for t, y in rows if y == 1], [t for t, y in rows if y != 1]
    if not one or not none:
        return {"terms": [], "weights": None}
    terms = learn_lexicon(one, none)
    machine = Automaton(terms)
    x = np.array([machine.features(t) for t, _ in rows])
    return {"terms": terms, "weights": regression(x, np.array([float(y == 1) for _, y in rows])).tolist()}


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo by; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """A model from labelled rows; sample bounds what is broadcast and what the one fitting task reads."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).dropna().filter(remainder("_id", 3) != 1)
    known = known.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(known), "_id").select("text", "y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic = [], []
        for f in frames:
            texts += f.text.tolist()
            toxic += f.y.tolist()
        model = json.dumps(fit(texts, toxic))
        del texts, toxic
        release()
        yield pd.DataFrame({"model": [model]})

    found = rows.repartition(1).mapInPandas(run, "model string").collect()
    return json.loads(found[0][0]) if found else {"terms": [], "weights": None}


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col double, 0 to 1."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    terms, weights = [tuple(t) for t in model["terms"]], model["weights"]

    def run(batches):
        machine = Automaton(terms)
        for b in text_batches(batches):
            found = [0.0 if weights is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(machine.features(t.as_py() or "") @ weights))))) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, widened(docs.schema, {out_col: "double"}))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
