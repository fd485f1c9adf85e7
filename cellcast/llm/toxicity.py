"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellcast.llm.samples import LabelledSample
from cellcast.llm.text import pieces
from cellcast.shared import checkpointed

THRESHOLD = 0.7

# Symbols of the grammar. The last two are the ones that can score.
OTHER, TARGET, NEGATION, REPORT, INTENT, BREAK, INSULT, THREAT = range(8)

# Words known beforehand, English, German, French and Spanish.
WORDS = {
    TARGET: "you your yours yourself u he she they him her them this that these those "
            "du dich dir dein deine ihr euch euer sie er tu te toi ton ta vous votre il elle ils elles "
            "tú ti tu usted ustedes él ella ellos ellas",
    NEGATION: "not no never neither nor without isn't aren't don't doesn't wasn't won't cannot "
              "nicht kein keine keinen nie niemals ohne pas jamais aucun sans nunca jamás tampoco sin",
    REPORT: "said says say told tells called calls wrote writes quoted quote claimed reported "
            "sagte sagt nannte schrieb behauptete dit disait appelait écrit dijo dice llamó escribió",
    INTENT: "will would shall should gonna going must want wanna "
            "werde werden will soll muss vais va veux dois voy vas quiero debo",
    INSULT: "idiot idiots moron morons stupid loser losers pathetic worthless trash scum clown "
            "disgusting dumb fool imbecile "
            "dumm dummkopf trottel abschaum arschloch con connard imbécile crétin salope "
            "estúpido imbécil basura",
    THREAT: "kill kills murder hurt beat stab shoot burn destroy die "
            "töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar",
}
# Insults and threats that are common words of another language (German "die", Spanish
# "con") count only in a clause that holds one of these words of their own language.
AMBIGUOUS = {
    "die": frozenset("you your yours yourself u he she they him her them this that these those would "
                     "shall should gonna going must wanna the to and let".split()),
    "con": frozenset("toi ton vous votre il elle ils elles ce quel quelle pauvre gros petit".split()),
}
SEED_WEIGHT = 3.0
# Lengths of learned word beginnings; a word must be longer than the beginning.
PREFIXES = (4, 5, 6, 7, 8)
# Times one document counts for an entry at most.
REPEATS = 4
# Learned entries: documents of label 1 that hold one, least weight, and how many at most.
LEAST_DOCUMENTS, LEAST_WEIGHT, MAX_ENTRIES = 4, 1.0, 20_000
# Standard deviations taken off a learned weight.
CAUTION = 1.5
_REMEMBERED = 300_000
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:,\n()\"“”«»]+")


@dataclass(frozen=True)
class Machine:
    """A transducer over symbols: states from 0, arcs (state, symbol) -> state; else ``decay`` applies.

    ``decay`` is what any other symbol does: stay, or fall back by one (a scope that runs out).
    """

    states: int
    arcs: dict[tuple[int, int], int]
    decay: bool = False

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), max(0, state - 1) if self.decay else state)


# Each reads a clause: has a target been named; how far does a negation reach; is speech reported;
# was an intent stated.
SCOPE = 4
MACHINES = (
    Machine(2, {(0, TARGET): 1}),
    Machine(SCOPE + 1, {(s, NEGATION): SCOPE for s in range(SCOPE + 1)}, decay=True),
    Machine(2, {(0, REPORT): 1}),
    Machine(SCOPE + 1, {(s, INTENT): SCOPE for s in range(SCOPE + 1)}, decay=True),
)
# Kinds of match: insult, threat with an intent, threat alone; each plain or negated, with a target or
# without, told as speech or not; and the share of its words' weight a match starts with.
KINDS = ("insult", "threat", "bare threat")
CATEGORIES = tuple(product(range(3), (0, 1), (0, 1), (0, 1)))
PRIOR = np.array([(1.0, 1.2, 0.4)[kind] * (0.4 if negated else 1.0) * (1.2 if target else 1.0)
                  * (0.6 if reported else 1.0) for kind, negated, target, reported in CATEGORIES])


def composed(machines: Sequence[Machine] = MACHINES) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product transducer: next state by (state, symbol), and what each state says of its parts."""
    start = (0,) * len(machines)
    place, queue, table = {start: 0}, [start], []
    for parts in queue:
        row = []
        for symbol in range(8):
            after = tuple(m.step(s, symbol) for m, s in zip(machines, parts))
            if after not in place:
                place[after] = len(place)
                queue.append(after)
            row.append(place[after])
        table.append(row)
    return table, queue


_TABLE, _STATES = composed()


class _Symbols(dict):
    """Symbol and weight of a word, worked out when first met."""

    def __init__(self, lexicon: "Lexicon"):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = self.lexicon.symbol(word)
        return found


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult words and of word beginnings; threats and the other classes are fixed."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[int, float]:
        if not word[0].isalnum():
            return BREAK, 0.0
        weight = max([self.words.get(word, 0.0),
                      *(self.beginnings.get(word[:n], 0.0) for n in PREFIXES if len(word) > n)])
        symbol, fixed = _FIXED.get(word, (OTHER, 0.0))
        if symbol == OTHER:
            return (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        return symbol, max(fixed, weight) if symbol >= INSULT else fixed


_FIXED = {word: (symbol, SEED_WEIGHT if symbol >= INSULT else 0.0)
          for symbol in (REPORT, INTENT, TARGET, NEGATION, INSULT, THREAT)
          for word in WORDS[symbol].split()}


def _settled(tokens: list[str], read: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """``read`` with ambiguous words of clauses in another language made ordinary words."""
    start = 0
    for end in (*(k for k, (symbol, _) in enumerate(read) if symbol == BREAK), len(read)):
        clause = tokens[start:end]
        for k, word in enumerate(clause, start):
            if word in AMBIGUOUS and AMBIGUOUS[word].isdisjoint(clause):
                read[k] = OTHER, 0.0
        start = end + 1
    return read


def matches(text: str | None, symbols: _Symbols) -> np.ndarray:
    """Summed weights of a text's matched clauses by category, then its words. A text of over 131,072
    characters is read in pieces cut at white space."""
    sums = np.zeros(len(CATEGORIES) + 1)
    for piece in pieces((text or "").lower()):
        tokens = _TOKEN.findall(piece)
        read = [symbols[w] for w in tokens]
        if not AMBIGUOUS.keys().isdisjoint(tokens):
            read = _settled(tokens, read)
        sums[-1] += len(read)
        if not read or max(read)[0] < INSULT:
            continue
        state, found = 0, []
        for symbol, weight in (*read, (BREAK, 0.0)):
            if symbol == BREAK:
                if found:
                    target, _, reported, _ = _STATES[state]
                    for kind, negated, w in found:
                        sums[((kind * 2 + negated) * 2 + target) * 2 + reported] += w
                state, found = 0, []
                continue
            if symbol >= INSULT:
                _, negated, _, intent = _STATES[state]
                kind = 0 if symbol == INSULT else 1 if intent else 2
                found.append((kind, int(negated > 0), weight))
            state = _TABLE[state][symbol]
    return sums


_COUNTS = "entry string, half int, label int, docs long, n long"


def _entries(text: str) -> Counter:
    """Words and word beginnings (marked by a star) of a text, each counted ``REPEATS`` times at most."""
    words = Counter(w for p in pieces(text.lower()) for w in _TOKEN.findall(p) if w[0].isalnum())
    entries = Counter(words)
    for word, n in words.items():
        for k in PREFIXES:
            if len(word) > k:
                entries[f"{word[:k]}*"] += n
    return Counter({e: min(n, REPEATS) for e, n in entries.items()})


def _count_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each entry, and its occurrences there, by half and label."""
    docs: Counter = Counter()
    times: Counter = Counter()
    for batch in batches:
        for text, half, label in zip(batch["text"], batch["half"], batch["label"]):
            for entry, n in _entries(text).items():
                docs[entry, half, label] += 1
                times[entry, half, label] += n
    rows = [(*key, n, times[key]) for key, n in docs.items()]
    yield pd.DataFrame(rows, columns=["entry", "half", "label", "docs", "n"]).astype(
        {"half": "int32", "label": "int32", "docs": "int64", "n": "int64"})


def _lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: Sequence[int]) -> Lexicon:
    """Entries whose log odds, less some caution, favour label 1."""
    n1, n0 = (sum(sizes.get((h, k), 0) for h in halves) for k in (1, 0))
    if not n1 or not n0:
        return Lexicon()

    def of(label: int, column: str):
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col(column))), F.lit(0))

    table = counts.where(F.col("half").isin(*halves)).groupBy("entry").agg(
        of(1, "n").alias("a"), of(0, "n").alias("b"), of(1, "docs").alias("docs_a"),
        of(0, "docs").alias("docs_b")).where(F.col("docs_a") >= LEAST_DOCUMENTS)
    odds = (F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
            - CAUTION * F.sqrt(1 / (F.col("docs_a") + 0.5) + 1 / (F.col("docs_b") + 0.5)))
    best = table.select("entry", odds.alias("w")).where(F.col("w") >= LEAST_WEIGHT).orderBy(
        F.desc("w"), "entry").limit(MAX_ENTRIES).collect()
    return Lexicon({r.entry: r.w for r in best if not r.entry.endswith("*")},
                   {r.entry[:-1]: r.w for r in best if r.entry.endswith("*")})


@dataclass(frozen=True)
class ToxicityModel:
    """The lexicon, the weight of each category and of the three sums beside them, and the bias."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float



def _design(sums: np.ndarray) -> np.ndarray:
    """Logs of the categories' weights, of all weight, of all weight per thousand words, and of words."""
    total, words = sums[:, :-1].sum(axis=1), sums[:, -1]
    return np.log1p(np.column_stack((sums[:, :-1], total, 1000 * total / np.maximum(words, 1), words)))


def _fit_weights(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 2.0
                 ) -> tuple[np.ndarray, float]:
    """Logistic weights of the categories, drawn towards ``PRIOR``; classes weigh as in the whole."""
    prior = np.concatenate((2.0 * PRIOR, [0.0, 0.0, 0.0, -3.0]))
    if not len(y):
        return prior[:-1], -3.0
    design = np.column_stack((_design(x), np.ones(len(y))))
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    pull = np.append(np.full(len(prior) - 1, ridge), 0.1)
    beta = prior.copy()
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - pull * (beta - prior)
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def _match_udf(held):
    @F.pandas_udf(ArrayType(DoubleType()))
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        symbols = _Symbols(held.value)
        for texts in batches:
            yield pd.Series([matches(t, symbols) for t in texts])
    return sums


def fit_toxicity(sample: LabelledSample) -> ToxicityModel:
    """Learns the lexicon and the category weights from a bounded labelled sample.

    Words and word beginnings are counted by document on the executors. The category weights are
    fitted on matches that each half of the sample gets from the other half's lexicon, so an entry
    that fits only its own documents gains nothing; the lexicon used is that of both halves. Without
    a label of each class the fixed words and weights are used.
    """
    spark = sample.rows.sparkSession
    rows = sample.rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    counts = checkpointed(rows.mapInPandas(_count_entries, _COUNTS).groupBy(
        "entry", "half", "label").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    sizes = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    x, y = [], []
    for half in (0, 1):
        held = spark.sparkContext.broadcast(_lexicon(counts, sizes, [1 - half]))
        part = rows.where(F.col("half") == half).select(
            "label", _match_udf(held)(F.col("text")).alias("sums")).toPandas()
        x += part["sums"].tolist()
        y += part["label"].tolist()
    total = sum(sample.totals)
    weights, bias = _fit_weights(np.array(x).reshape(-1, len(CATEGORIES) + 1), np.array(y),
                                 sample.totals[1] / total if total else 0.5)
    return ToxicityModel(_lexicon(counts, sizes, [0, 1]), weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text",
                   score_name: str = "score", sums_name: str | None = None) -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for each whole text; null and empty texts get the
    score of no match. With ``sums_name`` the matched weights by category are kept as an array.
    Existing columns of these names are replaced."""
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(model.lexicon)
    name = sums_name or "toxicity_sums"
    while not sums_name and name in docs.columns:
        name = f"_{name}"
    parts = F.slice(F.col(name), 1, len(CATEGORIES))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    words = F.element_at(F.col(name), len(CATEGORIES) + 1)
    terms = F.concat(parts, F.array(total, 1000 * total / F.greatest(words, F.lit(1.0)), words))
    logit = F.aggregate(
        F.zip_with(terms, F.array(*[F.lit(float(w)) for w in model.weights]),
                   lambda s, w: F.log1p(s) * w), F.lit(float(model.bias)), lambda a, v: a + v)
    scored = docs.withColumn(name, _match_udf(lexicon)(F.col(text_column))).withColumn(
        score_name, 1.0 / (1.0 + F.exp(-logit)))
    return scored if sums_name else scored.drop(name)
