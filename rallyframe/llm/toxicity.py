"""Toxicity scores from a fuzzy lexicon and the context of its hits.

The lexicon is learned: beginnings of words (a closing mark makes one a whole word) that labelled toxic documents hold
far more often than the others. It becomes a trie; a token is read by the intersection of the trie with the
Levenshtein automata of all its terms, made deterministic state by state as tokens need it, so that a misspelled term
is found within the edits its length allows and most tokens die after a few letters. Quotation (a pair of quotation
marks around a hit in its line, reporting words in a window around it) is told from abuse (address, shouting); both go
into a logistic regression.

Documented bound: the lexicon and the regression are fitted on about TRAIN_ROWS labelled documents, chosen by a hash
of doc_id, whole texts of them, each text once; scoring reads every document whole. A lexicon has as many terms as these
documents prove, of any length: beginnings are counted STRETCH letters further at a time, while enough toxic documents
hold them. Only rows that `training_rows` lets through are ever learned from; labels, lang, source and doc_id are no
inputs of a score.

Cases: null text scores like the empty one, which has no hits; without labelled rows of both kinds the score is the
share of toxic labels (0 without any); a document with several label rows is toxic if one says so, and one with several
rows is learned from once, by the text that sorts first; repeated rows each give a row; a null doc_id is not held out; other columns pass through `score_documents`.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .runtime import columns, map_batches, schema_of, stored, table

TRAIN_ROWS = 20_000
#: Least letters of a beginning, and how many lengths are counted in one pass.
SHORTEST, STRETCH = 4, 10
#: Chance that a term is kept by accident, of the hundred thousands looked at.
LOG_CHANCE = math.log(1e-7)
#: Tokens a worker remembers as clean.
CLEAN_TOKENS = 300_000
#: States of the automata that a worker keeps before it starts anew.
STATES = 60_000
#: Words before and after a hit.
CONTEXT = 6
THRESHOLD = 0.7
END = "$"
WORD = re.compile(r"\w+")
#: Words of reporting, and of address.
REPORTING = frozenset("said says wrote writes quoted quote called stated reported according sagte schrieb zitierte laut dit écrit cité selon dijo escribió citó según".split())
ADDRESS = frozenset("you your yours ur u du dich dir dein tu te toi vous ton tú ti usted ustedes".split())
#: Pairs of quotation marks within a line.
QUOTED = re.compile(r'"[^"\n]*"|[“„][^“”„\n]*[”“]|«[^«»\n]*»|»[^«»\n]*«|‘[^‘’\n]*’')


def edits_for(term: str) -> int:
    letters = len(term.rstrip(END))
    return 1 if letters < 10 else 2


class FuzzyTrie:
    """The terms' trie under Levenshtein automata with a budget of edits per term."""

    def __init__(self, terms: dict[str, int]) -> None:
        """terms: to the edits allowed."""
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]
        self.ends: dict[int, str] = {}
        self.allowed = terms
        for term, edits in terms.items():
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.ends[node] = term
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0}) if self.allowed else -1

    def _state(self, least: dict[int, int]) -> int:
        """Close under letters that the token lacks, and number the state; -1 is the dead one."""
        queue = list(least)
        while queue:
            node = queue.pop()
            for c, child in self.children[node].items():
                e = least[node] + 1
                if c != END and e <= self.budget[child] and e < least.get(child, 9):
                    least[child] = e
                    queue.append(child)
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            found = [(e, self.ends[n]) for n, e in least.items() if n in self.ends and e <= self.allowed[self.ends[n]]]
            self.accepts.append(min(found) if found else None)
            self.moves.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < least.get(node, 9):
                least[node] = e

        for node, e in self.members[state]:
            if c != END:
                put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                if letter == c:
                    put(child, e)
                elif END not in (letter, c):
                    put(child, e + 1)
        to = self.moves[state][c] = self._state(least)
        return to

    def match(self, token: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that the token is or begins with."""
        if len(self.members) > STATES:
            self._begin()
        state, best = self.start, None
        for c in token + END:
            if state < 0:
                break
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state >= 0 and (found := self.accepts[state]) and (best is None or found < best):
                best = found
        return best


class Model:
    """Lexicon with weights, and the regression. Plain values, so that it travels in a closure."""

    def __init__(self, terms: dict[str, tuple[float, int]], weights: list[float], base: float) -> None:
        self.terms, self.weights, self.base = terms, weights, base


def quotation(text: str, words: list[re.Match], i: int, quoted: bool) -> float:
    """0 for abuse to 1 for quotation, from the CONTEXT words on each side of word i and whether it is between quotation marks."""
    near, far = ([m.group() for m in part] for part in (words[max(0, i - CONTEXT) : i], words[i + 1 : i + 1 + CONTEXT]))
    a, b = words[i].span()
    score = 0.0
    if quoted:
        score += 0.6
    if REPORTING & {*near, *far}:
        score += 0.4
    if ADDRESS & {*near[-3:], *far[:3]}:
        score -= 0.3
    if text[a:b].isupper() or "!" in text[b : b + 3]:
        score -= 0.2
    return min(1.0, max(0.0, score))


class Scanner:
    """Hits of texts, with a memory of tokens that have none."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.trie = FuzzyTrie(terms)
        self.clean: set[str] = set()

    def _dirty(self, raw: str) -> bool:
        return any(self.trie.match(t) for t in WORD.findall(raw.lower()))

    def hits(self, text: str) -> list[tuple[str, int, int, float]]:
        """(term, edits, number of hits, sum of their quotation): a row for each term and number of edits."""
        new = set(text.split()) - self.clean
        dirty = [t for t in new if self._dirty(t)]
        if len(self.clean) > CLEAN_TOKENS:
            self.clean.clear()
        self.clean.update(new)
        if not dirty:
            return []
        self.clean.difference_update(dirty)
        low = text.lower()
        if len(low) != len(text):  # letters whose lower case is longer
            text = low
        pairs = [m.span() for m in QUOTED.finditer(low)]
        begins = [a for a, _ in pairs]
        out: dict[tuple[str, int], tuple[int, float]] = {}
        words = list(WORD.finditer(low))
        for i, m in enumerate(words):
            if found := self.trie.match(m.group()):
                at = bisect.bisect_right(begins, m.start()) - 1
                quote = quotation(text, words, i, at >= 0 and m.end() <= pairs[at][1])
                n, total = out.get(found[::-1], (0, 0.0))
                out[found[::-1]] = n + 1, total + quote
        return [(*key, *sums) for key, sums in out.items()]


def features(hits: list[tuple[str, int, int, float]], words: int, terms: dict[str, tuple[float, int]]) -> list[float]:
    exact = fuzzy = quoted = 0.0
    for term, edits, n, quote in hits:
        weight, allowed = terms.get(term, (0.0, 0))
        if edits > allowed:
            continue
        quoted += weight * quote
        if edits:
            fuzzy += weight * (n - quote)
        else:
            exact += weight * (n - quote)
    abuse = exact + 0.5 * fuzzy
    return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), float(abuse >= 0.5), math.log1p(100 * abuse / (words + 20))]


def training_rows(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of about `rows` labelled documents at most, in the shared folder."""
    known = labels.where(training_rows() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / n) if n else 0
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About `rows` rows of two numbers, by construction.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    once = once.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies prove nothing more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(once.select("text", "toxic").repartition(parts), "labelled_sample")


def _beginnings(sample: DataFrame, low: int, stems: frozenset[str] | None) -> DataFrame:
    """term, toxic and clean documents that hold it: beginnings of low to low + STRETCH - 1 letters, of words that begin with a stem."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = set()
            for word in set(WORD.findall((text or "").lower())):
                whole = word + END
                if stems is None or whole[: low - 1] in stems:
                    seen.update([whole[:n] for n in range(low, min(len(whole), low + STRETCH - 1) + 1)])
            counts[toxic].update(seen)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    each = map_batches(sample.selectExpr("text", "if(toxic > 0, 1, 0) as toxic"), run, "term string, toxic long, clean long", rows=4096)
    return each.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_tail(n: Column, expected: Column) -> Column:
    """About the log of the chance of n toxic documents with a term that is no likelier in them than in the others."""
    log_factorial = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n)
    return F.when(n > expected, n * F.log(expected) - log_factorial - expected).otherwise(0.0)


def _lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms and weights. Those that the sample proves come to the driver, so its bound is theirs too."""
    least = max(3, toxic // 200)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    proven = _log_tail(F.col("toxic").cast("double"), (F.col("clean") + 0.5) / (clean + 1) * toxic) < LOG_CHANCE
    found: dict[str, tuple[int, float]] = {}
    low, stems = SHORTEST, None
    while stems is None or stems:
        counted = _beginnings(sample, low, stems).where(F.col("toxic") >= least).withColumn("odds", odds)
        low += STRETCH
        good = (F.col("odds") > 2) & proven
        rows = counted.select("term", "toxic", "odds", good.alias("good")).where(good | (F.length("term") == low - 1)).collect()
        found |= {r["term"]: (r["toxic"], r["odds"]) for r in rows if r["good"]}
        stems = frozenset(r["term"] for r in rows if len(r["term"]) == low - 1 and not r["term"].endswith(END))
    longer: dict[str, list[str]] = {}
    for term in sorted(found):
        longer.setdefault(term[:-1], []).append(term)
    top = max((odds for _, odds in found.values()), default=1.0)
    chosen: dict[str, float] = {}
    for term, (n, _) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        longest = term
        while True:  # the longest beginning that loses next to nothing, so that edits are told apart best
            after = [t for t in longer.get(longest, ()) if found[t][0] >= 0.95 * n]
            if not after:
                break
            longest = max(after, key=lambda t: found[t][0])
        if not any(term[:k] in chosen for k in range(1, len(term) + 1)):
            chosen[longest] = (found[longest][1] / top) ** 2
    return {t: chosen[t] for t in sorted(chosen, key=lambda t: (-found[t][0], t))}


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _hits_of(sample: DataFrame, terms: dict[str, int]) -> DataFrame:
    """toxic, words, and terms, edits, numbers and quotation of the hits, for each row: no more than the lexicon has."""

    cache: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Scanner(terms))
        texts = [t or "" for t in batch.column(0).to_pylist()]
        hits = [cache[0].hits(t) for t in texts]
        cols = [pa.array([[h[i] for h in own] for own in hits], pa.list_(k)) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
        yield pa.record_batch([batch.column(1), pa.array([len(t.split()) for t in texts], pa.int64()), *cols], names=["toxic", "words", "terms", "edits", "counts", "quotes"])

    return map_batches(sample.selectExpr("text", "if(toxic > 0, 1, 0) as toxic"), run, "toxic int, words long, terms array<string>, edits array<long>, counts array<long>, quotes array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = _sample(docs, labels, rows)
    counts = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        return Model({}, [], toxic / max(1, toxic + clean))
    lexicon = _lexicon(sample, toxic, clean)
    allowed = {t: edits_for(t) for t in lexicon}
    found = [(r["toxic"], r["words"], list(zip(r["terms"], r["edits"], r["counts"], r["quotes"], strict=True))) for r in _hits_of(sample, allowed).collect()]
    near: dict[str, Counter] = {}
    for y, _, hits in found:
        for term in {t for t, e, _, _ in hits if e}:
            near.setdefault(term, Counter())[y] += 1
    for term, n in near.items():  # misspellings count only where they mean the same
        if n[0] * toxic >= 0.1 * n[1] * clean:
            allowed[term] = 0
    terms = {t: (w, allowed[t]) for t, w in lexicon.items()}
    x = np.array([features(h, n, terms) for _, n, h in found])
    weights = _regression(x, np.array([y for y, _, _ in found], dtype=float))
    return Model(terms, weights.tolist(), toxic / (toxic + clean))


def score_text(scanner: Scanner, model: Model, text: str | None) -> float:
    if not model.weights:
        return model.base
    text = text or ""
    x = features(scanner.hits(text), len(text.split()), model.terms)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def score_documents(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns and the score."""
    rest = [c for c in docs.columns if c not in ("text", name)]
    cache: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Scanner({t: e for t, (_, e) in model.terms.items()}))
        scores = [score_text(cache[0], model, t) for t in batch.column(0).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=["text", *rest, name])

    return map_batches(docs.select(*columns(["text", *rest])), run, schema_of(docs, ["text", *rest], **{name: DoubleType()}))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~training_rows(), F.lit(False))
    scored = score_documents(docs, model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
