"""Language identification by unigram piece models, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's likelihood
under a language is the sum over all its segmentations into pieces, by the forward algorithm; a
document's is the product over its words. Probabilities are fitted by expectation maximisation
(forward and backward passes) on the words of a bounded sample of labelled rows per language.
Words are scored once per worker and remembered, many words of one length together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import held, in_slices
from webstrata.llm.lattice import PieceTable, by_length, code_points

#: Labelled documents per language, in expectation, that the model is fitted on.
SAMPLE = 500
#: Expectation-maximisation rounds.
ROUNDS = 2
#: Added to every expected count of a piece.
SMOOTHING = 0.05
#: Probability of a character that the vocabulary lacks, in every language.
UNKNOWN = 1e-9
#: After so many characters the running products of a word are divided by their newest one, whose logarithm is
#: kept, so that the sum over all segmentations of a word of any length stays within the range of a double.
RESCALE = 16
#: Remembered words per worker.
ENTRIES = 150_000
#: What a text without letters gets.
NONE = "und"

_WORD = re.compile(r"[^\W\d_]+")

LABELS = "doc_id bigint, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Lower-cased words; empty if the text has no letter."""
    found = _WORD.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


@functools.lru_cache(maxsize=2)
def piece_table(vocabulary: str) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
    pieces = [model.id_to_piece(k) for k in range(model.vocab_size()) if not special(k)]
    return PieceTable(pieces, list(range(len(pieces))))


@dataclass(frozen=True)
class Model:
    vocabulary: str
    languages: list[str]
    p: np.ndarray  # piece x language; the last row is an unknown character


def _piece_rows(table: PieceTable, chars: np.ndarray, unknown: int) -> list[np.ndarray]:
    found = table.starts(chars)
    found[0] = np.where(found[0] < 0, unknown, found[0])
    return found


def forward(p: np.ndarray, found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``out[j, w]`` and ``scale[j, w]``: the probability of the first j characters of word w per language, over all
    segmentations, is out times e to the scale.

    The last row of ``p`` must be zero, as ``found`` holds -1 where there is no piece.
    """
    shape = (n + 1, found[0].shape[0], p.shape[1])
    alpha, scale = np.zeros(shape), np.zeros(shape if n > RESCALE else (1, 1, 1))
    alpha[0] = 1
    recent = [alpha[0]]  # newest first, all of one scale
    for j in range(1, n + 1):
        here = alpha[j]
        for length in range(1, min(j, len(found)) + 1):
            here += recent[length - 1] * p[found[length - 1][:, j - length]]
        recent = [here, *recent[: len(found) - 1]]
        if n > RESCALE:
            scale[j] += scale[j - 1]
            if j % RESCALE == 0 and j < n:
                recent = [r / here for r in recent]  # an unknown character has a probability, so this is above zero
                scale[j] += np.log(here)
                alpha[j] = 1
    return alpha, np.broadcast_to(scale, shape)


def backward(p: np.ndarray, found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`forward`, for what follows the first j characters."""
    shape = (n + 1, found[0].shape[0], p.shape[1])
    beta, scale = np.zeros(shape), np.zeros(shape if n > RESCALE else (1, 1, 1))
    beta[n] = 1
    recent = [beta[n]]
    for i in range(n - 1, -1, -1):
        here = beta[i]
        for length in range(1, min(n - i, len(found)) + 1):
            here += p[found[length - 1][:, i]] * recent[length - 1]
        recent = [here, *recent[: len(found) - 1]]
        if n > RESCALE:
            scale[i] += scale[i + 1]
            if (n - i) % RESCALE == 0 and i:
                recent = [r / here for r in recent]
                scale[i] += np.log(here)
                beta[i] = 1
    return beta, np.broadcast_to(scale, shape)


#: Characters of a word for which pieces are looked up at once.
WINDOW = 4096


def long_word_score(p: np.ndarray, table: PieceTable, word: str, unknown: int) -> np.ndarray:
    """Log likelihood of one long word: the forward sum, whose memory does not grow with the word."""
    recent, scale, done = [np.ones(p.shape[1])], np.zeros(p.shape[1]), 0
    while done < len(word):
        before = min(done, table.longest - 1)  # pieces that begin in the last window
        part = word[done - before : done + WINDOW]
        found = _piece_rows(table, code_points([part], len(part)), unknown)
        for j in range(before + 1, len(part) + 1):
            here = sum(recent[k - 1] * p[found[k - 1][0, j - k]] for k in range(1, min(j, len(found), len(recent)) + 1))
            recent = [here, *recent[: table.longest - 1]]
            if j % RESCALE == 0:
                scale += np.log(here)
                recent = [r / here for r in recent]
        done += len(part) - before
    return np.log(recent[0]) + scale


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log likelihood of each word, behind the vocabulary's word mark, under each language."""
    table, marked = piece_table(model.vocabulary), ["▁" + w for w in words]
    scores = np.empty((len(words), len(model.languages)))
    p = np.append(model.p, np.zeros((1, model.p.shape[1])), 0)  # row -1: no piece
    unknown = len(model.p) - 1
    for n, group in by_length(marked):
        if n > WINDOW:
            for k in group:
                scores[k] = long_word_score(p, table, marked[k], unknown)
            continue
        alpha, scale = forward(p, _piece_rows(table, code_points([marked[k] for k in group], n), unknown), n)
        scores[group] = np.log(alpha[n]) + scale[n]
    return scores


def fit(vocabulary: str, languages: list[str], words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation; ``counts[w, l]`` is how often word w stands in texts of language l."""
    table, marked = piece_table(vocabulary), ["▁" + w for w in words]
    size = table.size
    p = np.full((size + 2, len(languages)), 1.0 / size)
    p[size:] = [[UNKNOWN], [0]]
    blocks = []
    for n, group in by_length(marked):
        found = _piece_rows(table, code_points([marked[k] for k in group], n), size)
        blocks.append((n, counts[group], found))
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for n, weight, found in blocks:
            (alpha, up), (beta, down) = forward(p, found, n), backward(p, found, n)
            whole = np.log(alpha[n]) + up[n]
            for i in range(n):
                before = weight / alpha[n] * alpha[i]
                for length in range(1, min(n - i, len(found)) + 1):
                    rows = found[length - 1][:, i]
                    if n > RESCALE:
                        before = weight * alpha[i] * np.exp(up[i] + down[i + length] - whole)
                    share = before * p[rows] * beta[i + length]
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(rows + 1, share[:, k], size + 2)
        p[:size] = expected[1 : size + 1] + SMOOTHING
        p[:size] *= (1 - UNKNOWN) / p[:size].sum(0)
    return Model(vocabulary, languages, p[:-1])


def train(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows (doc_id, text, lang) per language, picked by a hash of the id.

    The number of languages is taken to be small; per language one row reaches the driver, then the
    different words of the sample with their counts.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = labelled.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in rows]
    if not languages:
        return Model(vocabulary, [], np.zeros((1, 0)))
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text"), F.lit(1 << 40)) / float(1 << 40)
    rates = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], min(1.0, sample / r["count"]))])
    picked = labelled.where(spread < rates[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in words_of(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    found = picked.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    encoded = [found.column(k).combine_chunks().dictionary_encode() for k in (0, 1)]
    words = encoded[1].dictionary.to_pylist()
    counts = np.zeros((len(words), len(languages)))
    place = np.array([languages.index(x) for x in encoded[0].dictionary.to_pylist()], int)
    if len(words):
        counts[encoded[1].indices.to_numpy(), place[encoded[0].indices.to_numpy()]] = found.column(2).to_numpy()
    return fit(vocabulary, languages, words, counts)


class Scorer:
    """Remembers the scores of words, one row of a growing matrix each; starts afresh when full."""

    def __init__(self, model: Model, entries: int = ENTRIES):
        self.model, self.entries = model, entries
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.empty((self.entries, len(self.model.languages)))

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.row)
        if len(self.row) + len(new) > self.entries:
            self._clear()
            new = set().union(*texts)
            if len(new) > self.entries:
                self.scores = np.empty((len(new), len(self.model.languages)))
        words = list(new)
        at = len(self.row)
        self.scores[at : at + len(words)] = word_scores(self.model, words)
        self.row.update(zip(words, range(at, at + len(words))))

    def total(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return self.scores[rows].sum(0)


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of a model."""
    return held(("scorer", id(model)), lambda: Scorer(model))


def _label(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    languages = scorer.model.languages
    words = [words_of(t or "") if languages else [] for t in texts]
    scorer.learn(words)
    labels, scores = [], []
    for found in words:
        if not found:
            labels.append(NONE)
            scores.append(0.0)
            continue
        total = scorer.total(found)
        best = int(np.argmax(total))
        labels.append(languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return labels, scores


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior under equal priors) of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in in_slices(batches, 100):
            labels, scores = _label(scorer, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LABELS)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a row without id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The model sees text and lang of rows that are not held out and have both. A null text, or one
    without a letter, gets ``und`` and score 0; so does every row if nothing can be learned. Between
    equal languages the first by name wins. Every row is scored by its own text, whole; ids may be
    null or repeat, an empty table gives no rows, and other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(~held_out()), vocabulary, sample)
    return classify(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) whose text has a letter and whose language is
    more likely than ``least``. Where no language can be learned, every text with a letter stays."""
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(labelled.where(~held_out()), vocabulary, sample)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in in_slices(batches, 100):
            _, scores = _label(scorer, batch.column(at).to_pylist())
            yield batch.filter(pa.array([s > least for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
