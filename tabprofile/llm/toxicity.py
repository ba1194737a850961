"""Toxicity scores: Levenshtein automata run against a trie of a learned lexicon.

The lexicon holds whole terms and stems (prefixes) that mark toxic documents
in the labelled rows.  A word is matched by the intersection of the trie with
a Levenshtein automaton, made deterministic lazily: long terms are also found
with an error or two.  Hits inside quotations count less, see
:func:`quote_discount`.  A logistic model over a handful of hit statistics
gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, forget, settle, without

WORD = re.compile(r"[^\W_]+")
STEM_LENGTHS = (3, 4, 5, 6)
#: Labelled rows a fit may use (those with the least hash of the id).
FIT_ROWS = 8192
DISCOVERY_RATE = 0.2
#: Share of the toxic documents that an entry must explain beyond the entries before it (two documents at least).
LEAST_ADDED = 0.005
#: Sets of other entries that a word occurs with, from which on it cannot come from copies of a few documents.
VARIED_COMPANY = 5
#: Words looked at on either side of a hit, and what a fully quoted hit loses of its weight.
WINDOW, QUOTED_LOSS = 8, 0.8
#: Quotation marks that open and close, and words that report or mention speech.
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted term word words sagte schrieb wort dit écrit mot dijo escribió palabra".split()
)
#: Words whose match a task remembers: a few MB, as Python workers stay in memory from stage to stage.
MEMO_WORDS = 64_000


def errors_allowed(term: str) -> int:
    """Edits that still match a term: none below 5 characters, one below 8, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """All words within a term's allowed edits, or that begin with a stem, as one lazy automaton.

    A state is a set of (trie node, edits so far); a transition is computed
    when a word first takes it and kept.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget: list[int] = [0]  # most edits any term below a node allows
        self.weights = {("term", t): w for t, w in terms.items()} | {("stem", s): w for s, w in stems.items()}
        for t in terms:
            for node in (path := self._add(t)):
                self.budget[node] = max(self.budget[node], errors_allowed(t))
            self.term[path[-1]] = t
        for s in stems:
            self.stem[self._add(s)[-1]] = s
        self.alphabet = {c for kids in self.child for c in kids}
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0)}))

    def _add(self, word: str) -> list[int]:
        path = [0]
        for c in word:
            if c not in self.child[path[-1]]:
                self.child[path[-1]][c] = len(self.child)
                self.child.append({})
                self.term.append(None)
                self.stem.append(None)
                self.budget.append(0)
            path.append(self.child[path[-1]][c])
        return path

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """Add what leaving out characters of a term reaches; keep the fewest edits for each node."""
        least: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(kid, e + 1) for kid in self.child[node].values() if e + 1 <= self.budget[kid]]
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.items)
            self.items.append(items)
            self.moves.append({})
        return self.states[items]

    def _move(self, state: int, c: str) -> int:
        new: set[tuple[int, int]] = set()
        for node, e in self.items[state]:
            if c in self.child[node]:
                new.add((self.child[node][c], e))
            if e + 1 <= self.budget[node]:
                new.add((node, e + 1))  # a character too many
            new.update((kid, e + 1) for kid in self.child[node].values() if e + 1 <= self.budget[kid])
        return self._state(self._close(new))

    def match(self, word: str) -> tuple[str, str, int] | None:
        """(kind, entry, edits) of the best entry: stems and exact terms first, then fewest edits, then the heaviest."""
        state, found = self.start, None
        for i, c in enumerate(word):
            key = c if c in self.alphabet else "\0"
            nxt = self.moves[state].get(key)
            if nxt is None:
                nxt = self.moves[state][key] = self._move(state, key)
            state = nxt
            if not self.items[state]:
                break
            for node, e in self.items[state]:
                if e == 0 and self.stem[node] is not None:
                    found = ("stem", self.stem[node], 0)
        best = None
        for node, e in self.items[state]:
            t = self.term[node]
            if t is not None and e <= errors_allowed(t):
                rank = (e, -self.weights["term", t], t)
                if best is None or rank < best[0]:
                    best = (rank, ("term", t, e))
        if best and (best[1][2] == 0 or not found):
            return best[1]
        return found


@dataclass(frozen=True)
class ToxicityModel:
    """What a fit leaves: the lexicon (weights are log odds) and the logistic model; a few KB."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (0.0,) * 5
    intercept: float = -3.0


def quote_discount(text: str, start: int, end: int) -> float:
    """How far a hit at text[start:end] is quoted or mentioned, 0 to 1, judged by its context window."""
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    words = WORD.findall(before.lower())[-WINDOW:]
    near = 0.5 if any(w in REPORTING for w in words) else 0.0
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    closed = min((p for c in CLOSING if (p := after.find(c)) >= 0), default=-1)
    marks = 0.6 if opened >= 0 and closed >= 0 and "\n" not in before[opened:] + after[:closed] else 0.0
    return min(1.0, near + marks)


def hit_statistics(text: str | None, auto: LexiconAutomaton, memo: dict[str, tuple | None]) -> list[float]:
    """Heaviest exact and inexact hit, log count of either, and hits per word; quoted hits weigh less."""
    if not text:
        return [0.0] * 5
    low = text.lower()
    words = WORD.findall(low)
    hit_words = {}
    for w in set(words):
        if w in memo:
            m = memo[w]
        else:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            m = memo[w] = auto.match(w)
        if m:
            hit_words[w] = m
    if not hit_words:
        return [0.0] * 5
    top, sums = [0.0, 0.0], [0.0, 0.0]
    for at in WORD.finditer(low):
        m = hit_words.get(at[0])
        if m:
            share = 1 - QUOTED_LOSS * quote_discount(low, at.start(), at.end())
            inexact = int(m[2] > 0)
            weight = auto.weights[m[0], m[1]] * share / (1 + m[2])
            top[inexact] = max(top[inexact], weight)
            sums[inexact] += share
    return [top[0], top[1], math.log1p(sums[0]), math.log1p(sums[1]), 10 * (sums[0] + sums[1]) / max(len(words), 10)]


def _candidates(text: str | None) -> set[str]:
    """Features a lexicon entry can be made of: 'w' + word, and 's' + stem of longer words."""
    words = set(WORD.findall((text or "").lower()))
    return {"w" + w for w in words if 3 <= len(w) <= 30} | {
        "s" + w[:k] for w in words for k in STEM_LENGTHS if len(w) > k
    }


def learn_lexicon(sample: DataFrame, text_col: str, label_col: str) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems that are in many toxic and few other documents of the (bounded) sample.

    Document counts are made per partition and summed by a shuffle; what
    comes to the driver is how many candidates have each pair of counts, and
    then all that are significant.  The sample bounds both, so the lexicon has
    no other limit.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch[text_col], batch[label_col]):
                seen[int(label)].update(_candidates(text))
        keys = [k for k in seen[0].keys() | seen[1].keys()]
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pd.DataFrame({"f": part, "c0": [seen[0][k] for k in part], "c1": [seen[1][k] for k in part]})

    sizes = dict(sample.groupBy(F.col(label_col).cast("int")).count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return {}, {}
    spread = sample.select(text_col, label_col).mapInPandas(count, "f string, c0 long, c1 long")
    sums = settle(spread.groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c0 + c1 >= 3"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    candidates = sums.where((F.col("c1") >= 3) & (F.col("c1") >= 4 * F.col("c0")))
    tested, base = sums.count(), n1 / (n0 + n1)
    pairs = [tuple(r) for r in candidates.groupBy("c0", "c1").count().collect()]
    listed = sample.sparkSession.createDataFrame(_significant(pairs, tested, base), "c0 long, c1 long")
    some = candidates.join(F.broadcast(listed), ["c0", "c1"]).withColumn("odds", odds)  # pairs of counts of the bounded sample
    good = some.select("f", "odds", "c0", "c1").collect()
    forget(sums)
    wanted = frozenset(r["f"] for r in good)

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fs": [sorted(_candidates(t) & wanted) for t in batch[text_col]]})

    # At most one short row for each toxic row of the sample.
    toxic = sample.where(F.col(label_col) == 1).select(text_col).mapInPandas(incidence, "fs array<string>").collect()
    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    for r in _cover(good, [set(x["fs"]) for x in toxic]):
        kind, body = r["f"][0], r["f"][1:]
        (terms if kind == "w" else stems)[body] = r["odds"]
    return terms, stems


def _cover(good: list, docs: list[set[str]]) -> list:
    """Entries picked one by one, each for the toxic documents that no entry before it is in.

    Words that merely come along in copies of a toxic document explain none
    that its slurs do not, and so stay out; so do stems of which one word is
    the reason.  An entry must add ``LEAST_ADDED`` of the toxic documents.
    """
    where: dict[str, set[int]] = {r["f"]: set() for r in good}
    for k, fs in enumerate(docs):
        for f in fs:
            where[f].add(k)
    left, picked, least = set(range(len(docs))), [], max(2, LEAST_ADDED * len(docs))
    while True:
        new = {r["f"]: len(where[r["f"]] & left) for r in good}
        # Of equal gains the longer entry, a word before a stem: it says the same more exactly.
        best = max(good, key=lambda r: (new[r["f"]] * r["odds"], len(r["f"]), r["f"][0] == "w", r["f"]), default=None)
        if best is None or new[best["f"]] < least:
            break
        picked.append(best)
        left -= where[best["f"]]
    # Further words that keep varied company are terms too, though the documents they are in have others as well.
    chosen = {r["f"] for r in picked}
    company = [frozenset(fs & chosen) for fs in docs]
    for r in good:
        if r["f"][0] == "w" and r["f"] not in chosen:
            if len({company[k] for k in where[r["f"]]}) >= VARIED_COMPANY:
                picked.append(r)
    return picked


def _significant(pairs: list[tuple[int, int, int]], tested: int, base: float) -> list[tuple[int, int]]:
    """Of the pairs of counts (c0, c1, how many candidates have them) those that stand out at a false discovery rate of DISCOVERY_RATE.

    The bound on the chance of c1 toxic among c0 + c1 documents is Chernoff's;
    the procedure is that of Benjamini and Hochberg.
    """
    ordered = sorted((_log_p(c0, c1, base), n) for c0, c1, n in pairs)
    cut, rank = None, 0
    for k, (p, n) in enumerate(ordered):
        rank += n
        if (k + 1 == len(ordered) or ordered[k + 1][0] > p) and p <= math.log(DISCOVERY_RATE * rank / max(tested, 1)):
            cut = p
    return [(c0, c1) for c0, c1, _ in pairs if cut is not None and _log_p(c0, c1, base) <= cut]


def _log_p(c0: int, c1: int, base: float) -> float:
    n, share = c0 + c1, c1 / (c0 + c1)
    if share <= base:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
    return -n * (share * math.log(share / base) + rest)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression; the last column of x is 1 and not penalised."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 when divided by 4: never used for a fit."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled rows that are not held out.

    The rows with the least MD5 of the id are taken, so the sample does not
    depend on the order or partitioning of the tables.  Rows without label or
    id are left out; an id labelled several times counts as toxic if any row
    says so.  Without a toxic row in the sample the model gives every text
    the score of an empty one.

    Misspellings are rare in labelled text, so for each toxic row a second one
    is added in which its exact hits stand as inexact ones, at a quarter of
    the weight: the model then knows that they mean the same.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .where(~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__label"))
        .orderBy(F.md5(F.col("__id").cast("string")), "__id")
        .limit(fit_rows)
    )
    sample = settle(
        docs.select(F.col(id_col), F.col(text_col).alias("__text"))
        .join(F.broadcast(known), F.col(id_col) == F.col("__id"))  # at most fit_rows rows of 12 bytes
        .select("__text", "__label")
    )
    terms, stems = learn_lexicon(sample, "__text", "__label")
    draft = ToxicityModel(terms, stems)

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, memo = LexiconAutomaton(draft.terms, draft.stems), {}
        for batch in batches:
            rows = [hit_statistics(t, auto, memo) for t in batch["__text"]]
            yield pd.DataFrame(rows, columns=list("abcde")).assign(y=batch["__label"].to_numpy())

    got = sample.mapInPandas(stats, "a double, b double, c double, d double, e double, y int").toPandas()
    if not len(got):
        return draft
    x, y = got[list("abcde")].to_numpy(), got["y"].to_numpy(float)
    toxic = x[(y == 1) & (x[:, 0] > 0)]
    misspelt = np.column_stack([np.zeros(len(toxic)), toxic[:, 0] / 2, np.zeros(len(toxic)), toxic[:, 2], toxic[:, 4]])
    full = np.vstack([x, misspelt])
    beta = _logistic(
        np.column_stack([full, np.ones(len(full))]),
        np.concatenate([y, np.ones(len(misspelt))]),
        np.concatenate([np.ones(len(x)), np.full(len(misspelt), 0.25)]),
    )
    return ToxicityModel(terms, stems, tuple(beta[:-1]), float(beta[-1]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the toxicity of each whole text, 0 to 1; a null text counts as empty.

    One pass without a shuffle; the model (a few KB) goes along with the
    function.
    """

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, memo, coef = LexiconAutomaton(model.terms, model.stems), {}, np.array(model.coef)
        for texts in batches:
            z = np.array([hit_statistics(t, auto, memo) for t in each(texts)]).reshape(len(texts), 5) @ coef
            yield pa.array(1 / (1 + np.exp(-np.clip(z + model.intercept, -30, 30))))

    return without(docs, out).withColumn(out, rate(F.col(text_col)))
