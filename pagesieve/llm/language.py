"""Language of whole texts: known words first, character n-grams for unseen ones.

Training counts words by language. A word's score in a language is the logarithm of its
frequency there. A word that was not seen backs off: at each of its places the longest
known character n-gram counts (of five characters, then four, ... down to one), each step
down at a penalty. The scores of a text's words add up; the language with the largest sum
is predicted, and its share of the exponentials is the score.

The model is fitted on at most about ``SAMPLE_DOCS`` labelled documents of each language, picked by a hash
of their text, and has at most the words and n-grams of these; it is small and goes to
all tasks. Texts are predicted whole, task by task, without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0; equal sums go to
the first language by name; rows without a language or without text are not learned from; with nothing
to learn from all texts are ``und``; equal rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.functions.storage import scratch
from pagesieve.llm.stages import written
from pagesieve.llm.tokens import portions

#: Labelled documents of a language that a model is fitted on, in expectation.
SAMPLE_DOCS = 2000
#: Words and n-grams seen less often in the sample are not part of the model.
LEAST_WORDS, LEAST_GRAMS = 2, 4
LONGEST = 5
#: Log-probability lost by each step to shorter n-grams, and the least log-probability.
STEP, FLOOR = 1.0, -18.0
#: A worker forgets the scores of words when they are so many.
KEPT_WORDS = 100_000
UNKNOWN = "und"
#: Characters of texts that are worked on at once.
AT_ONCE = 1 << 20

_RUN = re.compile(r"[^\W\d_]+").findall


def _words(text: str) -> list[str]:
    """Runs of letters. Superscripts, fractions and the like count as word characters but are no letters, and part words."""
    runs = _RUN(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in ("".join(c if c.isalpha() else " " for c in r).split() if not r.isalpha() else (r,))]


def grams(word: str) -> Iterator[str]:
    """All n-grams of a word between its ends."""
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class Table:
    """Smoothed log shares by language, a row for each key; shares are within keys of the same group."""

    def __init__(self, counts: list[dict[str, int]], group):
        self.rows: dict[str, int] = {}
        for own in counts:
            for key in own:
                self.rows.setdefault(key, len(self.rows))
        groups = {g: i for i, g in enumerate(sorted({group(k) for k in self.rows}))}
        of = np.fromiter((groups[group(k)] for k in self.rows), np.int64, len(self.rows))
        self.values = np.zeros((len(self.rows), len(counts)), np.float32)
        for i, own in enumerate(counts):
            n = np.zeros(len(self.rows))
            n[np.fromiter((self.rows[k] for k in own), np.int64, len(own))] = np.fromiter(own.values(), np.float64, len(own))
            total = np.bincount(of, n, len(groups))[of]
            shares = np.where(n > 0, n / np.maximum(total, 1), 0.1 / (total + 1))
            self.values[:, i] = np.maximum(np.log(shares), FLOOR)

    def get(self, key: str) -> np.ndarray | None:
        row = self.rows.get(key)
        return None if row is None else self.values[row]


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, words: dict[str, dict[str, int]], gram_counts: dict[str, dict[str, int]]):
        self.languages = sorted(words)
        self.words = Table([words[x] for x in self.languages], lambda w: 0)
        self.grams = Table([gram_counts.get(x, {}) for x in self.languages], len)

    def word(self, word: str) -> np.ndarray:
        """A row of scores, one for each language."""
        known = self.words.get(word)
        return self._back_off(word) if known is None else known

    def _back_off(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        rows, found, steps, missed = self.grams.rows, [], 0, 0
        for i in range(len(marked) - 1):
            for n in range(min(LONGEST, len(marked) - i), 0, -1):
                row = rows.get(marked[i : i + n])
                if row is not None:
                    found.append(row)
                    steps += LONGEST - n
                    break
            else:
                missed += 1
        total = self.grams.values[found].sum(axis=0) - STEP * steps + FLOOR * missed
        return total / (len(marked) - 1)


class Predictor:
    """Predicts batches of texts; scores of words are kept from batch to batch."""

    def __init__(self, model: Model):
        self._model = model
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((1024, len(self._model.languages)), np.float32)

    def _learn(self, words: set[str]) -> None:
        need = len(self._rows) + len(words)
        if need > len(self._scores):
            more = np.zeros((max(need, 2 * len(self._scores)) - len(self._scores), self._scores.shape[1]), np.float32)
            self._scores = np.concatenate([self._scores, more])
        for w in words:
            self._rows[w] = k = len(self._rows)
            self._scores[k] = self._model.word(w)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if len(self._rows) > KEPT_WORDS:
            self._forget()
        languages = self._model.languages
        words = [_words(t.lower()) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        if not languages or not n.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        self._learn(set(chain.from_iterable(words)) - self._rows.keys())
        places = np.fromiter(map(self._rows.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        some = np.flatnonzero(n)
        sums = np.zeros((len(texts), len(languages)))
        starts = (np.cumsum(n) - n)[some]
        for k in range(len(languages)):
            sums[some, k] = np.add.reduceat(self._scores[:, k][places], starts, dtype=np.float64)
        best = sums.argmax(axis=1)
        shares = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = np.where(n > 0, 1 / shares.sum(axis=1), 0.0)
        return [languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())], score


# --- training ----------------------------------------------------------------------------


def sample_of(docs: DataFrame, *, text_col: str, lang_col: str, sample_docs: int) -> DataFrame:
    """(lang, text) of about ``sample_docs`` documents of each language; all of smaller ones."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return known.limit(0)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = reduce(lambda c, x: c.when(F.col("lang") == x[0], sample_docs / x[1]), sizes.items(), F)
    return known.filter(spread < share)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from documents with a language."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in portions(batch.column(1), AT_ONCE):
                seen: Counter = Counter()
                for lang, text in zip(batch.column(0)[first : first + len(texts)].to_pylist(), texts):
                    seen.update((lang, w) for w in _words(text.lower()))
                yield _counted(seen)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                weight = 1 + int(math.log2(n))  # a frequent word says little about unseen ones
                for g in grams(word):
                    seen[lang, g] += weight
            yield _counted(seen)

    schema = "lang string, key string, n long"
    sample = sample_of(docs, text_col=text_col, lang_col=lang_col, sample_docs=sample_docs)
    words = sample.mapInArrow(words_of, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = written(words, f"{scratch(docs.sparkSession, 'language')}/words")
    parts = words.mapInArrow(grams_of, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model(_by_language(words, LEAST_WORDS), _by_language(parts, LEAST_GRAMS))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
        ["lang", "key", "n"],
    )


def _by_language(counts: DataFrame, least: int) -> dict[str, dict[str, int]]:
    """Counts of the sample; their number is bounded with it."""
    out: dict[str, dict[str, int]] = {}
    for lang, key, n in counts.filter(F.col("n") >= least).toLocalIterator():
        out.setdefault(lang, {})[key] = n
    return out


# --- prediction --------------------------------------------------------------------------


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns, and the predicted language and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held.value)
        for batch in batches:
            texts = batch.column(place)
            langs, scores = [], []
            for _, some in portions(texts, AT_ONCE):
                lang, score = predictor.predict(some)
                langs += lang
                scores.append(score)
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """Documents whose language is known with a score of ``least``; the others go."""
    model = fit(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col)
    names = ("_lang_pred", "_lang_score")
    sure = predict(docs, model, text_col=text_col, out=names).filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least))
    return sure.drop(*names)
