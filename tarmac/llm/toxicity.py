"""Toxicity by a subsequence string kernel, a support vector machine on Nyström landmarks and the worst words of a text.

The kernel counts the letter triples that two words share in order, gaps allowed, each weighing DECAY per letter skipped within SPAN
letters; it is divided by lengths, so that it is near one for equal words. A word is mapped to its kernel values with the landmark
words, whitened by their own kernel matrix, and a linear machine is trained on these features. A triple of letter codes
has 32768 values, so the trained machine is held as one weight for each triple, which gives the same scores.

A labelled text says that some word is toxic, not which one. Training alternates: the machine picks the worst words
of each training text, and is trained again on the worst word of toxic texts against the worst words of clean ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.sources.scratch import stage

SPAN = 7
DECAY = 0.5
LONGEST = 22
# At most about this many labelled texts of each label are trained on, chosen by a hash of the key.
FIT_TEXTS = 2500
TOXIC_LANDMARKS = 128
COMMON_LANDMARKS = 64
ROUNDS = 4
WORST = 4
FLOOR, CEILING = -1.5, 1.5
KEPT_WORDS = 600_000
GROUP_WORDS = 200_000
# Characters that stand for a letter in a disguised word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_STANDS_IN = re.compile("[" + re.escape("".join(STAND_INS)) + "]")
# Codes of the two ends of a word. Letters outside a-z share three codes between them.
_FIRST, _LAST = 31, 30


def letters(chunk: str) -> str:
    """Letters of a chunk in lower case without accents; stand-ins count as letters when the chunk has a real one before them."""
    lowered = chunk.lower()
    if lowered.isascii() and lowered.isalpha():
        return lowered
    core = lowered.rstrip("!$@.,;:?")
    if core.isascii() and core.isalpha():
        return core
    core = unicodedata.normalize("NFKD", core)
    if not _STANDS_IN.search(core):
        return "".join(filter(str.isalpha, core))
    out = []
    for char in core:
        if char.isalpha():
            out.append(char)
        elif char in STAND_INS and out:
            out.append(STAND_INS[char])
    return "".join(out)


def units(text: str) -> list[str]:
    """White-space chunks, and runs of three or more single letters joined to one more chunk."""
    chunks = text.split()
    if list(map(len, chunks)).count(1) < 3:
        return chunks
    run: list[str] = []
    joined = []
    for chunk in chunks:
        if len(chunk) == 1 and chunk.isalpha():
            run.append(chunk)
            continue
        if len(run) > 2:
            joined.append("".join(run))
        if run:
            run = []
    if len(run) > 2:
        joined.append("".join(run))
    return chunks + joined if joined else chunks


def windows(word: str) -> list[str]:
    """The word, or overlapping windows of a very long one, so that every letter is seen."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[start:start + LONGEST] for start in range(0, len(word) - step, step)]


_SHAPES: dict[int, tuple[np.ndarray, ...]] = {}


def _triples(size: int) -> tuple[np.ndarray, ...]:
    if size not in _SHAPES:
        places = [(i, j, k) for i in range(size) for j in range(i + 1, min(size, i + SPAN))
                  for k in range(j + 1, min(size, i + SPAN))]
        table = np.array(places, dtype=np.int64).reshape(-1, 3)
        weights = DECAY ** (table[:, 2] - table[:, 0] - 2)
        norm = np.sqrt((weights ** 2).sum()) or 1.0
        _SHAPES[size] = (table[:, 0], table[:, 1], table[:, 2], (weights / norm))
    return _SHAPES[size]


def triple_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes[word, triple], weights[triple]) for words of one length; both ends of a word count as letters."""
    width = len(words[0])
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
    own = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 3)
    edges = np.empty((len(words), width + 2), dtype=np.int64)
    edges[:, 0], edges[:, -1], edges[:, 1:-1] = _FIRST, _LAST, own
    first, second, third, weights = _triples(width + 2)
    return (edges[:, first] << 10) | (edges[:, second] << 5) | edges[:, third], weights


def _by_length(words: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        groups.setdefault(len(word), []).append(place)
    for size, places in groups.items():
        if size:
            for start in range(0, len(places), 5000):
                yield places[start:start + 5000]


def dense(words: list[str]) -> np.ndarray:
    """Normalised triple weights of each word, 32768 columns; for the bounded sets of landmarks and training words."""
    table = np.zeros((len(words), 1 << 15), dtype=np.float32)
    for places in _by_length(words):
        codes, weights = triple_codes([words[i] for i in places])
        np.add.at(table, (np.array(places)[:, None], codes), weights.astype(np.float32))
    return table


def kernel_with(words: list[str], at: np.ndarray) -> np.ndarray:
    """Kernel values of each word with the landmarks whose triple weights are the rows of ``at``."""
    by_triple = np.ascontiguousarray(at.T)
    found = np.zeros((len(words), len(at)), dtype=at.dtype)
    for places in _by_length(words):
        for start in range(0, len(places), 200):
            some = places[start:start + 200]
            codes, weights = triple_codes([words[i] for i in some])
            found[some] = np.einsum("wtl,t->wl", by_triple[codes], weights.astype(at.dtype), optimize=True)
    return found


@dataclass
class Model:
    """A weight for each triple, and the plane that turns the margins of the three worst words into a logit."""

    triples: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float


class Scorer:
    """Margins of chunks, kept for chunks seen before."""

    def __init__(self, triples: np.ndarray, bias: float):
        self.triples, self.bias = triples, bias
        self.kept: dict[str, float] = {}

    def margins(self, chunks: list[str]) -> np.ndarray:
        words, owner = [], []
        for place, chunk in enumerate(chunks):
            for word in windows(letters(chunk)):
                words.append(word)
                owner.append(place)
        found = np.full(len(chunks), self.bias - 1.0)
        for places in _by_length(words):
            codes, weights = triple_codes([words[i] for i in places])
            np.maximum.at(found, np.array([owner[i] for i in places]), self.triples[codes] @ weights + self.bias)
        return found

    def telling(self, word: str) -> str:
        """The window of a word that gives it its margin."""
        parts = windows(word)
        return parts[0] if len(parts) == 1 else parts[int(self.margins(parts).argmax())]

    def groups(self, texts: Iterable[str | None]) -> Iterator[list[str]]:
        """The units of each text; units that are new in a group of texts are scored together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(units(text or ""))
            size += len(group[-1])
            if size > GROUP_WORDS:
                self.learn(set().union(*group))
                yield from group
                group, size = [], 0
        self.learn(set().union(*group))
        yield from group

    def learn(self, chunks: set[str]) -> None:
        missing = chunks.difference(self.kept)
        if len(self.kept) + len(missing) > KEPT_WORDS:
            self.kept.clear()
            missing = chunks
        listed = list(missing)
        self.kept.update(zip(listed, self.margins(listed).tolist()))

    def worst(self, texts: Iterable[str | None]) -> np.ndarray:
        """The three highest margins in each text, repeats included, within FLOOR and CEILING; what is lacking has FLOOR."""
        found = []
        for chunks in self.groups(texts):
            margins = np.fromiter(map(self.kept.__getitem__, chunks), dtype=float, count=len(chunks))
            margins = np.concatenate([margins, np.full(3, FLOOR)])
            found.append(np.sort(np.partition(margins, len(margins) - 3)[-3:])[::-1])
        return np.clip(np.array(found, dtype=float).reshape(-1, 3), FLOOR, CEILING)

    def worst_words(self, texts: Iterable[str | None], number: int) -> Iterator[list[tuple[str, float]]]:
        """The different words of each text with the highest margins."""
        for chunks in self.groups(texts):
            words: dict[str, float] = {}
            for chunk in sorted(set(chunks), key=lambda chunk: (-self.kept[chunk], chunk)):
                if len(words) == number:
                    break
                word = letters(chunk)
                if word:
                    words.setdefault(word, self.kept[chunk])
            yield list(words.items())


def machine(features: np.ndarray, signs: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    rows = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.eye(rows.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    found = np.zeros(rows.shape[1])
    for _ in range(60):
        inside = signs * (rows @ found) < 1
        part = rows[inside] * weights[inside, None]
        step = np.linalg.solve(ridge + part.T @ rows[inside], part.T @ signs[inside]) - found
        if np.abs(step).max() < 1e-6:
            break
        found += step if _ < 10 else 0.5 * step
    return found[:-1], float(found[-1])


def _logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    rows = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.diag([1e-2] * features.shape[1] + [1e-6])
    found = np.zeros(rows.shape[1])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        curve = weights * chance * (1 - chance) + 1e-9
        step = np.linalg.solve(ridge + (rows * curve[:, None]).T @ rows, rows.T @ (weights * (chance - labels)) + ridge @ found)
        found -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return found[:-1], float(found[-1])


def disguised(word: str) -> list[str]:
    """Forms of a toxic word with a letter put in or doubled, so that the machine is also trained on them."""
    if len(word) < 4:
        return []
    middle = len(word) // 2
    return [word[:middle] + "x" + word[middle:], word[:middle] + word[middle - 1] + word[middle:],
            word[:2] + "q" + word[2:]]


def _train(positive: Counter, negative: Counter, landmarks: list[str], root: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    words = sorted(set(positive) | set(negative))
    features = kernel_with(words, at) @ root
    rows, signs, weights = [], [], []
    place = {word: i for i, word in enumerate(words)}
    total = {1.0: sum(positive.values()), -1.0: sum(negative.values())}
    for counts, sign in ((positive, 1.0), (negative, -1.0)):
        for word, n in counts.items():
            rows.append(place[word])
            signs.append(sign)
            weights.append(1000.0 * n / total[sign])
    inner, bias = machine(features[rows].astype(float), np.array(signs), np.array(weights))
    return (root @ inner) @ at, bias


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen = {word for chunk in units(text.as_py() or "") for word in windows(letters(chunk))}
            counts.update((word, label) for word in seen if word)
        pairs = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32()),
             pa.array([counts[p] for p in pairs], pa.int64())], names=["word", "label", "n"])


def _witnesses(batches: Iterator[pa.RecordBatch], triples: np.ndarray, bias: float, number: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(triples, bias)
    for batch in batches:
        rows = []
        found = scorer.worst_words((text.as_py() for text in batch.column(1)), number)
        for label, best in zip(batch.column(0).to_pylist(), found):
            rows += [(label, rank, scorer.telling(word), margin) for rank, (word, margin) in enumerate(best)]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)],
                                         names=["label", "rank", "word", "margin"])


def fit(documents: DataFrame, labels: DataFrame, texts: int = FIT_TEXTS, rounds: int = ROUNDS) -> Model:
    """Train on ``documents`` (key, text) and ``labels`` (key, label; 1 toxic). Null labels and keys are passed over.

    The sample is drawn from the labels alone, so that about 2 * ``texts`` keys at most are broadcast to the texts and no text
    is shuffled. Of rows that repeat a key in the labels the largest label counts. Without both labels the score is their share.
    """
    told = labels.where("label IN (0, 1) AND key IS NOT NULL").groupBy("key").agg(F.max(F.col("label").cast("int")).alias("label"))
    sizes = {row[0]: row[1] for row in told.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = 0.999 if sizes.get(1) else 0.001
        return Model(np.zeros(1 << 15), 0.0, np.zeros(3), float(np.log(share / (1 - share))))
    limits = " ".join(f"WHEN {label} THEN {min(1.0, texts / n) * 1e6:.0f}" for label, n in sizes.items())
    drawn = stage(told.where(f"pmod(xxhash64(CAST(key AS STRING), 'toxic'), 1000000) < CASE label {limits} END"), "toxic-keys")
    keys = F.broadcast(drawn.withColumnRenamed("key", "_key"))
    chosen = stage(documents.join(keys, F.col("key") == F.col("_key")).select("label", "text"), "toxic-sample")
    in_sample = {row[0]: row[1] for row in chosen.groupBy("label").count().collect()}
    if len(in_sample) < 2:
        return Model(np.zeros(1 << 15), 0.0, np.zeros(3), float(np.log(sizes[1] / sizes[0])))
    counts = stage(chosen.mapInArrow(_words, "word string, label int, n bigint").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")), "toxic-words")
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit(in_sample[0] / in_sample[1]))
    telling = counts.where("toxic > 1").withColumn("gain", F.col("toxic") * odds).where(odds > 1).orderBy(F.desc("gain"), "word")
    toxic = [(row[0], row[1]) for row in telling.select("word", "toxic").limit(TOXIC_LANDMARKS).collect()]
    common = [(row[0], row[1]) for row in counts.orderBy(F.desc("clean"), "word").select("word", "clean").limit(COMMON_LANDMARKS).collect()]
    toxic = toxic or [(word, n) for word, n in common[:1]]
    landmarks = list(dict.fromkeys([word for word, _ in toxic] + [word for word, _ in common]))
    at = dense(landmarks)
    values, vectors = np.linalg.eigh(at.astype(float) @ at.T)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    first = dict(toxic)
    triples, bias = _train(Counter(first), Counter({w: n for w, n in common if w not in first}), landmarks, root, at)
    hard: Counter = Counter({word: 1 for word, _ in common if word not in first})
    for _ in range(rounds):
        given = (triples, bias)
        found = chosen.mapInArrow(lambda batches: _witnesses(batches, *given, WORST),
                                  "label int, rank int, word string, margin double").toPandas()
        # A text's worst word stands for it; telling words that are never the worst of a text stay in by their own counts.
        positive = Counter(dict(toxic))
        positive.update(Counter(found.word[(found.label == 1) & ((found["rank"] == 0) | (found.margin > 0.5))]))
        margins = dict(zip(found.word, found.margin))
        for word, n in list(positive.items()):
            if word in first or margins.get(word, 0) > 0.5:
                for form in disguised(word):
                    positive[form] += n / 4
        # Words that were the worst of a clean text in an earlier round stay in.
        for word, n in Counter(found.word[found.label == 0]).items():
            hard[word] = max(hard[word], n)
        triples, bias = _train(positive, hard, landmarks, root, at)
    margins = chosen.mapInArrow(lambda batches: _margins(batches, triples, bias), "label int, one double, two double, three double").toPandas()
    weights = np.where(margins.label == 1, sizes[1] / in_sample[1], sizes[0] / in_sample[0])
    slopes, offset = _logistic(margins[["one", "two", "three"]].to_numpy(), margins.label.to_numpy(dtype=float), weights / weights.mean())
    return Model(triples, bias, slopes, offset)


def _margins(batches: Iterator[pa.RecordBatch], triples: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(triples, bias)
    for batch in batches:
        worst = scorer.worst(text.as_py() for text in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(worst[:, i]) for i in range(3))], names=["label", "one", "two", "three"])


def _score(batches: Iterator[pa.RecordBatch], model: Model, place: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.triples, model.bias)
    for batch in batches:
        worst = scorer.worst(text.as_py() for text in batch.column(place))
        scores = 1 / (1 + np.exp(-np.clip(worst @ model.slopes + model.offset, -40, 40)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def score(df: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) plus score in 0..1 and predicted, 1 from a score of 0.5.

    Whole texts are scored by their three worst words. A null or empty text, or one without letters, has the lowest margins
    there are. Input columns called score or predicted give way to the result. An empty table gives an empty result.
    """
    names = [name for name in df.columns if name.lower() not in ("score", "predicted")] if keep is None else keep
    read = names if text_column in names else [*names, text_column]
    inner = [f"c{i}" for i in range(len(read))]
    renamed = df.select(*(F.col(column(name)).alias(new) for name, new in zip(read, inner)))
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in renamed.schema)
    place = read.index(text_column)
    out = renamed.mapInArrow(lambda batches: _score(batches, model, place), f"{schema}, score double")
    return out.select(*(F.col(new).alias(name) for name, new in zip(read, inner) if name in names), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
