"""Language identification by unigram pieces, summed over all segmentations of each word.

The pieces are the lower-case letter pieces of a fixed public vocabulary; a word is a run of letters with a start mark.
Each language has a probability for each piece, fitted by expectation maximisation over word counts. A forward pass
adds up the probabilities of all segmentations of a word, and a text is scored by its words and the share of the language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column, given_back
from tarmac.sources.scratch import stage

UNKNOWN = "und"
START = "▁"
LETTERS = regex.compile(r"\p{L}+")
# Words longer than this are scored like any other but are not fitted on: their sums over segmentations leave the range of a double.
LONGEST_FITTED = 64
# At most about this many labelled documents of each language are fitted on, chosen by a hash of the id.
FIT_DOCUMENTS = 3000
ROUNDS = 3
SMOOTHING = 0.05
UNSEEN_LETTER = 1e-7
KEPT_WORDS = 300_000
# New words are scored together for texts of about this many words.
GROUP_WORDS = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Letter pieces of a sentencepiece file that are lower case, of any length, without duplicates."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    bodies = ((name, name.removeprefix(START)) for name in names)
    return sorted({name for name, body in bodies if body == body.lower() and (LETTERS.fullmatch(body) or name == START)})


class Lattice:
    """Finds the pieces inside words of one length, many words at a time."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(np.array([piece]).view(np.uint32).reshape(1, -1))[-1][0] for piece in pieces],
                          dtype=np.uint64).ravel()
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("two pieces share a hash")
        self.missing, self.unseen, self.longest = len(pieces), len(pieces) + 1, max(map(len, pieces), default=1)
        self.kind = np.int16 if self.unseen < 1 << 15 else np.int32

    @staticmethod
    def _hash(codes: np.ndarray) -> list[np.ndarray]:
        """Hashes of the whole row's suffix of each length."""
        value, out = np.zeros(len(codes), dtype=np.uint64), []
        for place in range(codes.shape[1]):
            value = value * _PRIME + codes[:, place].astype(np.uint64) + np.uint64(1)
            out.append(value)
        return out

    def find(self, words: list[str]) -> np.ndarray:
        """ids[k - 1, word, end]: the piece of length k that ends before ``end``, or ``missing``."""
        width = len(words[0])
        codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64) + np.uint64(1)
        ids = np.full((min(self.longest, width), len(words), width + 1), self.missing, dtype=self.kind)
        rolling = np.zeros((len(words), width), dtype=np.uint64)
        for size in range(1, len(ids) + 1):
            # The hash of a piece that ends at a place is that of its first letters, which ends one place earlier.
            rolling = (rolling[:, :-1] if size > 1 else rolling) * _PRIME + codes[:, size - 1:]
            at = np.searchsorted(self.sorted, rolling)
            at[at == len(self.sorted)] = 0
            ids[size - 1, :, size:] = np.where(self.sorted[at] == rolling, self.order[at], self.missing)
        single = ids[0, :, 1:]
        single[single == self.missing] = self.unseen
        return ids


def forward(ids: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, by word and language."""
    longest, words, ends = ids.shape
    missing = len(probabilities) - 2
    state = [np.ones((words, probabilities.shape[1]))]
    scale = np.zeros((words, 1))
    for end in range(1, ends):
        total = np.zeros_like(state[0])
        for size in range(1, min(longest, end) + 1):
            # Few places end a longer piece.
            own = ids[size - 1, :, end]
            there = np.flatnonzero(own != missing)
            if len(there):
                total[there] += state[-size][there] * probabilities[own[there]]
        state = [*state[-longest:], total]
        if end % 6 == 0:
            top = np.maximum(total.max(axis=1, keepdims=True), 1e-300)
            state = [values / top for values in state]
            scale += np.log(top)
    return np.log(np.maximum(state[-1], 1e-300)) + scale


def expected(ids: np.ndarray, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece under one language, by forward and backward sums."""
    longest, words, ends = ids.shape
    ahead, back = np.zeros((ends, words)), np.zeros((ends, words))
    ahead[0] = back[-1] = 1
    for end in range(1, ends):
        for size in range(1, min(longest, end) + 1):
            ahead[end] += ahead[end - size] * probability[ids[size - 1, :, end]]
    for start in range(ends - 2, -1, -1):
        for size in range(1, min(longest, ends - 1 - start) + 1):
            back[start] += back[start + size] * probability[ids[size - 1, :, start + size]]
    weight = counts / np.maximum(ahead[-1], 1e-300)
    uses = np.zeros(len(probability))
    for end in range(1, ends):
        for size in range(1, min(longest, end) + 1):
            piece = ids[size - 1, :, end]
            uses += np.bincount(piece, ahead[end - size] * probability[piece] * back[end] * weight, minlength=len(probability))
    return uses


@dataclass
class Model:
    """Languages, their log shares, the pieces and probabilities[piece, language]; two more rows: no piece, unseen letter."""

    languages: list[str]
    shares: np.ndarray
    pieces: list[str]
    probabilities: np.ndarray


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _by_length(words: list[str]) -> Iterator[list[str]]:
    words = sorted(words, key=len)
    start = 0
    while start < len(words):
        width = len(words[start])
        stop, most = start, max(1, 60_000 // width)
        while stop < len(words) and len(words[stop]) == width and stop - start < most:
            stop += 1
        yield words[start:stop]
        start = stop


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
        rows = [(lang, word, n) for lang, of in counts.items() for word, n in of.items() if len(word) <= LONGEST_FITTED]
        lang, word, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                                         names=["lang", "word", "n"])


def _uses(batches: Iterator[pa.RecordBatch], pieces: list[str], probabilities: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    lattice, totals = Lattice(pieces), {lang: np.zeros(len(pieces) + 2) for lang in probabilities}
    for batch in batches:
        by_lang: dict[str, dict[str, int]] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            by_lang.setdefault(lang, {})[START + word] = n
        for lang, counts in by_lang.items():
            for words in _by_length(list(counts)):
                n = np.array([counts[word] for word in words], dtype=float)
                totals[lang] += expected(lattice.find(words), probabilities[lang], n)
    for lang, uses in totals.items():
        seen = np.flatnonzero(uses[:-2])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()),
                                          pa.array(uses[seen], pa.float64())], names=["lang", "piece", "uses"])


def fit(labelled: DataFrame, vocabulary_path: str, documents: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """Fit on columns key, text, lang; rows with a null text or lang, and words over ``LONGEST_FITTED`` letters, are passed over.

    Languages are few: the driver holds one probability per piece and language. No labelled row gives a model without languages.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    totals = {row[0]: row[1] for row in rows.groupBy("lang").count().collect()}
    languages, pieces = sorted(totals), vocabulary(vocabulary_path)
    sizes = np.array([totals[lang] for lang in languages], dtype=float)
    if not languages:
        return Model([], sizes, pieces, np.zeros((len(pieces) + 2, 0)))
    spark = labelled.sparkSession
    shares = F.broadcast(spark.createDataFrame([(lang, min(1.0, documents / n)) for lang, n in totals.items()], "_lang string, _share double"))
    chosen = rows.join(shares, F.col("lang") == F.col("_lang")).where(
        "pmod(xxhash64(CAST(key AS STRING), 'fit'), 1000000) < _share * 1000000")
    counts = stage(chosen.select("lang", "text").mapInArrow(lambda batches: given_back(_counts(batches)), "lang string, word string, n bigint")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    letters = np.array([len(piece) for piece in pieces], dtype=float)
    start = np.exp(-2 * letters)
    table = np.tile((start / start.sum())[:, None], (1, len(languages)))
    for _ in range(rounds):
        given = {lang: _rows(table)[:, i].copy() for i, lang in enumerate(languages)}
        uses = counts.mapInArrow(lambda batches: given_back(_uses(batches, pieces, given)), "lang string, piece int, uses double")
        table = np.full((len(pieces), len(languages)), SMOOTHING)
        for row in uses.groupBy("lang", "piece").agg(F.sum("uses")).toPandas().itertuples(index=False):
            table[row[1], languages.index(row[0])] += row[2]
        table /= table.sum(axis=0)
    return Model(languages, np.log(sizes / sizes.sum()), pieces, _rows(table))


def _rows(table: np.ndarray) -> np.ndarray:
    width = table.shape[1]
    return np.vstack([table, np.zeros((1, width)), np.full((1, width), UNSEEN_LETTER)])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((4096, len(self.model.languages)))

    def learn(self, missing: set[str]) -> None:
        need = len(self.places) + len(missing)
        if need > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros((need, self.scores.shape[1]))])
        for words in _by_length([START + word for word in missing]):
            values = forward(self.lattice.find(words), self.model.probabilities)
            first = len(self.places)
            self.scores[first:first + len(words)] = values
            self.places.update((word[1:], first + i) for i, word in enumerate(words))

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Words that are new in a group of texts are scored together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(words_of(text or ""))
            size += len(group[-1])
            if size > GROUP_WORDS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        if not self.model.languages:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        distinct = set().union(*texts)
        missing = distinct.difference(self.places)
        if len(self.places) + len(missing) > KEPT_WORDS:
            self.clear()
            missing = distinct
        if missing:
            self.learn(missing)
        for words in texts:
            if not words:
                yield UNKNOWN, 0.0
                continue
            places = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
            total = self.model.shares + self.scores[places].sum(axis=0)
            total -= total.max()
            best = int(total.argmax())
            yield self.model.languages[best], float(1 / np.exp(total).sum())


def _predict(batches: Iterator[pa.RecordBatch], model: Model, place: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        found = list(scorer.predict(text.as_py() for text in batch.column(place)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"])


def predict(df: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) plus lang_pred and score, the posterior of the predicted language.

    A null text, or one without any letter, is ``und`` with score 0; so is every text when nothing was learned. Ties go to
    the language that comes first by name. An input column called lang_pred or score gives way to the result.
    """
    names = [name for name in df.columns if name.lower() not in ("lang_pred", "score")] if keep is None else keep
    read = names if text_column in names else [*names, text_column]
    inner = [f"c{i}" for i in range(len(read))]
    renamed = df.select(*(F.col(column(name)).alias(new) for name, new in zip(read, inner)))
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in renamed.schema)
    place = read.index(text_column)
    out = renamed.mapInArrow(lambda batches: given_back(_predict(batches, model, place)), f"{schema}, lang_pred string, score double")
    return out.select(*(F.col(new).alias(name) for name, new in zip(read, inner) if name in names), "lang_pred", "score")


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: a fifth of the keys by their CRC-32, and rows without a key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))
