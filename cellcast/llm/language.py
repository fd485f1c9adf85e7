"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cellcast.llm.text import GROUP_CHARS, free_name, groups, mixed

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
SMOOTHING = 0.5
# N-grams whose evidence a posterior counts at most, so that a long text is not always certain.
EVIDENCE = 50
MAX_LANGUAGES = 1000
# Matrix cells gathered at once while a group of texts is scored.
_GATHER = 1 << 19


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts and where each text begins; what is no letter is a space."""
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.flatnonzero(points == 0)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    return np.where(letter, points, np.uint32(32)), np.concatenate(([0], bounds + 1, [len(points) + 1]))


def _ngrams(points: np.ndarray, bounds: np.ndarray, order: int, bits: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of one order that begin with a letter or end with one, and their text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        code = code * np.uint64(0x100000001B3) + points[k:k + n]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    stays = np.ones(n, dtype=bool)
    for edge in bounds[1:-1]:
        stays[max(0, edge - order):edge] = False
    stays &= (points[:n] != 32) | (points[order - 1:order - 1 + n] != 32)
    return (mixed(code[stays]) >> np.uint64(64 - bits)).astype(np.int64), text[stays]


def _parts(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Groups of texts with their row numbers; a text longer than a group comes in parts, and n-grams
    do not span parts."""
    row = 0
    for group in groups(texts):
        if len(group) == 1 and len(group[0]) > GROUP_CHARS:
            for k in range(0, len(group[0]), GROUP_CHARS):
                yield [group[0][k:k + GROUP_CHARS]], np.array([row])
        else:
            yield group, np.arange(row, row + len(group))
        row += len(group)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code-point order, their log priors, and log probabilities (buckets x languages)."""

    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int = BUCKET_BITS

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Most probable language of each text (ties to the first) and its posterior.

        Of a text with more n-grams than ``EVIDENCE`` likelihood and prior are both scaled down, which
        changes no order of languages.
        """
        width = len(self.languages)
        sums, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
        step = max(1, _GATHER // width)
        for group, rows in _parts(texts):
            points, bounds = _letters(group)
            for order in ORDERS:
                bucket, text = _ngrams(points, bounds, order, self.bits)
                counts += np.bincount(rows[text], minlength=len(texts))
                for k in range(0, len(bucket), step):
                    part = text[k:k + step]
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    sums[rows[part[first]]] += np.add.reduceat(
                        self.matrix[bucket[k:k + step]], first, axis=0, dtype=np.float64)
        evidence = np.minimum(counts, EVIDENCE) / np.maximum(counts, 1)
        logs = (sums + self.prior) * evidence[:, None]
        logs -= logs.max(axis=1, keepdims=True)
        odds = np.exp(logs)
        best = odds.argmax(axis=1)
        return [self.languages[k] for k in best], odds[np.arange(len(best)), best] / odds.sum(axis=1)


_COUNTS = "lang string, bucket int, n long"
_LANGUAGES = "lang string, counts binary"


def fit_languages(docs: DataFrame, text_column: str = "text", lang_column: str = "lang",
                  max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Counts the hashed n-grams of every row with a text and a language, in one pass.

    A task adds up its own counts per language before anything is shuffled, so the shuffle holds at
    most one number per task, language and bucket. A language's sums are one row of 262 kB; the matrix is
    ``2**15`` rows of one float per language: at most 131 MB for ``max_languages``, made of 262 MB of sums;
    more languages are refused. Without a learned
    language every text is ``und``.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = held.setdefault(lang, np.zeros(size, dtype=np.int64))
                documents[lang] = documents.get(lang, 0) + len(texts)
                for group, _ in _parts(list(texts)):
                    points, bounds = _letters(group)
                    for order in ORDERS:
                        total += np.bincount(_ngrams(points, bounds, order, BUCKET_BITS)[0],
                                             minlength=size)
        for lang, total in held.items():
            bucket = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(bucket, -1).astype("int32"),
                                "n": np.append(total[bucket], documents[lang])})

    learned = docs.select(F.col(lang_column).cast("string").alias("lang"),
                          F.col(text_column).alias("text")).dropna()
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size + 1, dtype=np.int64)
        total[rows["bucket"]] = rows["n"]
        return pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()]})

    counted = learned.mapInPandas(count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.groupBy("lang").applyInPandas(pack, _LANGUAGES).limit(max_languages + 1).toPandas()
    if len(table) > max_languages:
        raise ValueError(f"over {max_languages} languages; the matrix is bounded to that")
    table = table.sort_values("lang")
    languages = tuple(table["lang"])
    # The last place of a language's counts, which is -1, holds its documents.
    counts = np.zeros((size + 1, len(languages)))
    for k, held in enumerate(table["counts"]):
        counts[:, k] = np.frombuffer(held, dtype=np.int64)
    prior = np.log(counts[-1] / max(1.0, counts[-1].sum())) if languages else np.zeros(0)
    rows = counts[:-1] + SMOOTHING
    return LanguageModel(languages, prior, np.log(rows / rows.sum(axis=0)).astype(np.float32))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text",
             lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior (0 to 1) as two more columns.

    Null texts and texts without a letter get ``und`` and 0. Whole texts are read, in groups of
    131,072 characters. An existing column of either name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    result = StructType([StructField("lang", StringType()), StructField("p", DoubleType())])

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = held.value
        for texts in batches:
            if not len(fitted.languages):
                yield pd.DataFrame({"lang": UNKNOWN, "p": 0.0}, index=range(len(texts)))
                continue
            lang, p = fitted.score([t or "" for t in texts])
            yield pd.DataFrame({"lang": lang, "p": p})

    guess = free_name(docs, "guess")
    lettered = has_letter(F.col(text_column))
    return (docs.withColumn(guess, predict(F.col(text_column)))
            .withColumns({lang_name: F.when(lettered, F.col(f"{guess}.lang")).otherwise(UNKNOWN),
                          score_name: F.when(lettered, F.col(f"{guess}.p")).otherwise(0.0)})
            .drop(guess))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5,
                    text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a posterior of ``least`` or more.

    Rows with a null text or one without a letter go; all other columns stay as they are, also those with the
    names of scores, and repeated rows are kept as often as they come.
    """
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    known = identify(docs, model, text_column, lang, score)
    return known.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
