"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers for insults (stems by their strength), threats (an agent, a verb and a target), targets (whom a
clause speaks to or of), negation, reported speech and insults that stand alone are composed into one machine.
Its arcs are alternatives (a stem is an insult or a word like others, a target before or after it, a negation
that turns what follows or is ignored), so a clause has many paths, and the best one by the weights of what
arcs do gives the clause's weight: a plain, aimed, negated or reported insult, or a threat. A text's score is a
logistic function of its clauses' weights: together, the largest, and how many; a text without clauses of some
weight has the same score whatever its words are. A stem without any other word is no clause and weighs nothing.

Stems come from a fixed list and from labelled rows: words and prefixes whose documents are toxic far more
often than others (likelihood ratio over LEAST_RATIO, MOST_STEMS of them); a stem's strength is its log odds. The
weights of what arcs do are stated, those of the logistic function fitted. Rows for fitting are those of `train`, at
most FIT_ROWS of them by a hash of the id; everything is fitted in one task on that bounded sample.
Scoring reads whole texts, finds stems with one Aho-Corasick pass and runs the machine on clauses that hold any.

Defined results: null and empty texts get the score of a text without hits; equal texts get equal scores;
null labels are not used for fitting, and of a doc_id's labels one of toxic decides; without labels, or labels of one
kind only, the fixed list and stated weights score; other columns pass through `scored`, which replaces `score`; an empty
table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyframe.llm import common

FIT_ROWS, MOST_STEMS, LEAST_RATIO, LEAST_TOXIC, THRESHOLD = 12_000, 3_000, 18.0, 3, 0.3
PREFIXES = (4, 5, 6, 7, 8)

# Words of the grammar.
INSULTS = (
    "idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "clown", "imbecile", "vermin", "filth",
    "dumbass", "asshole", "bastard", "bitch", "retard", "subhuman", "dummkopf", "arschloch", "abschaum", "imbécile", "connard", "salaud", "imbécil", "estúpido", "basura",
)
THREATS = ("kill", "murder", "hurt", "beat", "stab", "shoot", "burn", "destroy", "hunt", "strangle", "töten", "umbringen", "tuer", "matar")
TARGETS = ("you", "your", "you're", "u", "yourself", "he", "she", "they", "them", "him", "her", "people", "those", "these", "all", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "didn't", "nobody", "neither", "without", "nicht", "kein", "nie", "pas", "jamais", "nunca", "tampoco")
REPORTS = ("said", "says", "called", "calls", "wrote", "writes", "quoted", "claimed", "claims", "reported", "reportedly", "allegedly", "sagte", "nannte", "dit", "dijo", "llamó")
AGENTS = ("i", "i'll", "we", "we'll", "gonna", "ich", "wir", "je", "nous", "yo", "nosotros")

_CLAUSE = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


SCOPE = 3
#: Weights of what arcs do: a plain insult weighs by its stem's strength, of which the least is nothing.
STATED = {"plain": -1.0, "odds": 0.8, "target": 1.0, "threat": 2.5, "negated": -1.5, "reported": -1.0, "ignored": -2.0, "alone": -4.0}
ACTS = tuple(STATED)


class Transducer:
    """A weighted finite-state transducer: arcs (state, symbol) -> [(state, output, acts)], "*" for any other symbol.

    Several arcs are alternatives and an empty list ends a path; without an arc the symbol passes and the state stays.
    acts are (name, amount) pairs, whose weights are a parameter of `best`."""

    def __init__(self, arcs: dict[tuple, list[tuple]], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: str) -> list[tuple]:
        found = self.arcs.get((state, symbol))
        if found is None:
            found = self.arcs.get((state, "*"))
        return [(s, symbol if o == "*" else o, acts) for s, o, acts in found] if found is not None else [(state, symbol, ())]

    def __matmul__(self, other: Transducer) -> Transducer:
        """This one, then the other on its output."""
        return Composed(self, other)

    def best(self, symbols: Iterable[str], weights: dict[str, float]) -> tuple[float, tuple, tuple[str, ...]]:
        """Weight, acts and output of the best path."""
        paths = {self.start: (0.0, (), ())}
        for symbol in symbols:
            after: dict = {}
            for state, (weight, done, out) in paths.items():
                for to, put, acts in self.step(state, symbol):
                    w = weight + sum(weights[a] * n for a, n in acts)
                    if to not in after or (w, done + acts) > after[to][:2]:
                        after[to] = (w, done + acts, out + (put,))
            paths = after
        return max(paths.values(), key=lambda p: p[:2]) if paths else (0.0, (), ())


class Composed(Transducer):
    """States are pairs, made as they are reached."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.known = first, second, {}
        self.start = (first.start, second.start)

    def step(self, state, symbol):
        if (state, symbol) not in self.known:
            self.known[state, symbol] = [((s, t), put, a + b) for s, mid, a in self.first.step(state[0], symbol) for t, put, b in self.second.step(state[1], mid)]
        return self.known[state, symbol]


def grammar() -> Transducer:
    """Symbols: I1 to I6 a stem and its strength, V threat verb, A agent, G target, N negation, R report, x other, $ the clause's end."""
    # a stem is an insult, or a word like others
    insult = Transducer({(0, f"I{k}"): [(0, "I", (("plain", 1), ("odds", k))), (0, "x", ())] for k in range(1, 7)})
    # an agent, a threat verb and a target, each at most SCOPE words from the one before, or words like others
    arcs: dict = {(0, "A"): [(("will", SCOPE), "x", ()), (0, "x", ())], (0, "V"): [(0, "x", ())]}
    for n in range(1, SCOPE + 1):
        arcs[("will", n), "V"] = [(("did", SCOPE), "x", ())]
        arcs[("did", n), "G"] = [(0, "T", (("threat", 1),))]
        for at in ("will", "did"):
            arcs[(at, n), "*"] = [((at, n - 1) if n > 1 else 0, "*", ())]
            arcs[(at, n), "V"] = arcs.get(((at, n), "V"), [((at, n), "x", ())])
    threat = Transducer(arcs)
    # a target before an insult, or one that has to come after it: guessed there, and the path ends if it does not
    arcs = {(0, "G"): [(("at", SCOPE + 1), "x", ())], (0, "I"): [(0, "I", ()), (("due", SCOPE), "IG", (("target", 1),))]}
    for n in range(1, SCOPE + 2):
        arcs[("at", n), "G"] = [(("at", SCOPE + 1), "x", ())]
        arcs[("at", n), "I"] = [(("at", n), "IG", (("target", 1),))]
        arcs[("at", n), "*"] = [(("at", n - 1) if n > 1 else 0, "*", ())]
    for n in range(1, SCOPE + 1):
        arcs[("due", n), "G"] = [(("at", SCOPE + 1), "x", ())]
        arcs[("due", n), "$"] = []
        arcs[("due", n), "*"] = [(("due", n - 1), "*", ())] if n > 1 else []
    target = Transducer(arcs)
    # a negation turns what comes within SCOPE words, unless it is ignored
    arcs = {}
    for n in range(SCOPE + 1):
        arcs[n, "N"] = [(SCOPE, "x", ()), (n, "x", (("ignored", 1),))]
        if n:
            arcs |= {(n, s): [(n - 1, f"n{s}", (("negated", 1),))] for s in ("I", "IG", "T")} | {(n, "*"): [(n - 1, "*", ())]}
    negation = Transducer(arcs)
    arcs = {(0, "R"): [("said", "x", ()), (0, "x", (("ignored", 1),))], ("said", "R"): [("said", "x", ())]}
    reported = Transducer(arcs | {("said", s): [("said", f"r{s}", (("reported", 1),))] for s in ("I", "IG", "T", "nI", "nIG", "nT")})
    # insults without any other word are no clause
    words = [f"{a}{b}" for a in ("", "n", "r", "rn") for b in ("I", "IG")]
    arcs = {(s, w): [("alone", "*", ())] for s in (0, "alone") for w in words} | {(s, "*"): [("with", "*", ())] for s in (0, "alone")}
    alone = Transducer(arcs | {("alone", "$"): [("with", "*", (("alone", 1),))], (0, "$"): [("with", "*", ())], ("with", "*"): [("with", "*", ())]})
    return insult @ threat @ target @ negation @ reported @ alone


#: What the logistic function sees of a text: its clauses' weights, together, the largest, and how many; if there are any, its
#: length, and their weight by its length, to which DENSITY_AT characters are added.
FEATURES, DENSITY_AT = 6, 200


class Grammar:
    """The machine with its stems (stem to log odds), the weights of what arcs do, and those of the logistic function."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray | None = None):
        import ahocorasick

        weights = weights if weights is not None else fixed_weights()
        self.stems, self.machine = stems, grammar()
        self.acts, self.weights = dict(zip(ACTS, weights.tolist())), weights[len(ACTS) :]
        self.symbols = {w: s for words, s in ((AGENTS, "A"), (TARGETS, "G"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "V")) for w in words}
        self.find = ahocorasick.Automaton()
        for stem in {*stems, *THREATS}:
            self.find.add_word(stem, len(stem))
        self.find.make_automaton()
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.memo: dict[tuple, tuple] = {}

    def symbol(self, word: str) -> str:
        """The stem with the largest odds counts."""
        best = max((self.stems[s] for n in self.sizes if len(word) >= n and (s := word[:n]) in self.stems), default=0.0)
        return f"I{min(6, max(1, round(best)))}" if best else self.symbols.get(word, "x")

    def clauses(self, text: str) -> Iterator[str]:
        """Clauses of a lower-case text that hold a stem or a threat verb at the beginning of a word."""
        at = -1
        for end, size in self.find.iter(text):
            start = end - size + 1
            if start < at or start and (text[start - 1].isalpha() or text[start - 1] in "'’"):
                continue
            before = max(text.rfind(c, 0, start) for c in ".!?;\n")
            m = _CLAUSE.search(text, end)
            at = m.end() if m else len(text)
            yield text[before + 1 : at]

    def parsed(self, clause: str) -> tuple[float, tuple, tuple[str, ...]]:
        """Weight, acts and output of a clause's best path; longer runs of other words are as good as SCOPE + 2 of them."""
        symbols: list[str] = []
        for w in _WORD.findall(clause):
            if (s := self.symbol(w)) != "x" or symbols[-SCOPE - 2 :] != ["x"] * (SCOPE + 2):
                symbols.append(s)
        key = tuple(symbols)
        if key not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            self.memo[key] = self.machine.best([*key, "$"], self.acts)
        return self.memo[key]

    def features(self, text: str) -> np.ndarray:
        found = [w for c in self.clauses(text.lower()) if (w := self.parsed(c)[0]) > 0]
        total, length = sum(found), math.log1p(len(text)) / 5 if found else 0.0
        return np.array([1, math.log1p(total), max(found, default=0.0), math.log1p(len(found)), length, math.log1p(1000 * total / (len(text) + DENSITY_AT))])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text or "") @ self.weights, -30, 30))))


def fixed_weights() -> np.ndarray:
    """Used where there is nothing to fit: acts as stated, then those of the logistic function."""
    return np.array([*STATED.values(), -3.0, 0.7, 0.3, 0.6, 0.0, 0.9])


def ratio(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Likelihood ratio of a feature's counts against independence."""
    n, row = n_pos + n_neg, pos + neg
    cells = ((pos, row * n_pos), (neg, row * n_neg), (n_pos - pos, (n - row) * n_pos), (n_neg - neg, (n - row) * n_neg))
    return 2 * sum(k * math.log(k * n / e) for k, e in cells if k)


def marks(text: str, sizes: tuple[int, ...] = (0, *PREFIXES)) -> set[str]:
    """Words (size 0) and beginnings of words."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return {w[:n] if n else w for w in words for n in sizes if len(w) >= n}


def learned_stems(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Stems by their log odds, from texts and labels; fixed ones keep at least their weight."""
    stems = {s: 3.0 for s in INSULTS}
    n_pos = sum(y for _, y in rows)
    n_neg = len(rows) - n_pos
    if not n_pos or not n_neg:
        return stems
    pos: Counter = Counter()
    for n in (0, *PREFIXES):  # one length at a time: nearly all are rare, and all at once they are many
        found_in: Counter = Counter()
        for t, y in rows:
            if y:
                found_in.update(marks(t, (n,)))
        pos.update({m: max(k, pos[m]) - pos[m] for m, k in found_in.items() if k >= LEAST_TOXIC})
    some = set(pos)
    neg: Counter = Counter()
    for t, y in rows:
        if not y:
            neg.update(marks(t) & some)
    found = []
    for m in some:
        odds = math.log((pos[m] + 0.5) / (neg[m] + 0.5) * (n_neg + 1) / (n_pos + 1))
        if odds >= 1.0 and pos[m] / (pos[m] + neg[m]) >= 0.3 and (r := ratio(pos[m], neg[m], n_pos, n_neg)) >= LEAST_RATIO:
            found.append((-r, m, min(odds, 6.0)))
    for _, m, odds in sorted(found)[:MOST_STEMS]:
        stems[m] = max(odds, stems.get(m, 0.0))
    return stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Weights by Newton's method, the constant not penalized."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> tuple[dict[str, float], np.ndarray]:
    stems = learned_stems(rows)
    y = np.array([t for _, t in rows], float)
    if not len(y) or y.min() == y.max():
        return stems, fixed_weights()
    g = Grammar(stems)
    return stems, np.concatenate([list(STATED.values()), logistic(np.stack([g.features(t) for t, _ in rows]), y)])


def model(docs: DataFrame, labels: DataFrame, train: Column | None = None, most: int = FIT_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Fits on rows of docs whose doc_id is labelled and in train; at most about `most` of them, chosen by a hash of the id."""
    labelled = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    labelled = labelled.where(train if train is not None else F.lit(True)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).join(labelled, "doc_id").select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity fit")
        held = sorted((d, t, int(y > 0)) for b in batches for d, t, y in zip(*(c.to_pylist() for c in b.columns)))
        stems, weights = fit([(t, y) for _, t, y in held])
        names = [*stems, *(f"#{i}" for i in range(len(weights)))]
        del held
        common.release()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*stems.values(), *weights.tolist()], pa.float64())], ["name", "weight"])

    got = {r.name: r.weight for r in common.lean(rows).repartition(1).mapInArrow(run, "name string, weight double").collect()}
    if not got:
        return {s: 3.0 for s in INSULTS}, fixed_weights()
    return {k: v for k, v in got.items() if k[0] != "#"}, np.array([got[f"#{i}"] for i in range(len(ACTS) + FEATURES)])


def scored(docs: DataFrame, fitted: tuple[dict[str, float], np.ndarray], column: str = "text") -> DataFrame:
    """docs with score, from 0 to 1."""
    docs = docs.drop("score")
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity")
        g = Grammar(*fitted)
        for part in common.slices(batches):
            scores = pa.array([g.score(t.as_py()) for t in part.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])

    return common.lean(docs).mapInArrow(run, StructType(docs.schema.fields + [StructField("score", DoubleType())]))


def score_table(docs: DataFrame, fitted: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """doc_id and score only: the texts go in and do not come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity")
        g = Grammar(*fitted)
        for part in common.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.score(t.as_py()) for t in part.column(1)], pa.float64())], ["doc_id", "score"])

    return common.lean(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def kept(docs: DataFrame, fitted: tuple[dict[str, float], np.ndarray], cut: float, column: str = "text") -> DataFrame:
    """Rows of docs whose score is below cut, as they are: a filter inside the batches, so nothing is joined."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity")
        g = Grammar(*fitted)
        for part in common.slices(batches):
            yield part.filter(pa.array([g.score(t.as_py()) < cut for t in part.column(at)], pa.bool_()))

    return common.lean(docs).mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fitted = model(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    scores = score_table(docs, fitted)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
