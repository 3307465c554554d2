"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded as shares of character classes, of pairs of neighbouring classes and of
repeated words, and mapped to hidden units. A gated attention weighs the passages of a document, the weights sum to one, and a logistic
unit scores the weighted hidden passage. All weights are learned together from labels of documents; no passage has a label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.sources.scratch import stage

WORDS = 64
# A longer text is encoded in segments of at most this many characters, cut at a blank where there is one; passages begin anew in each.
SEGMENT = 1 << 19
# Characters that are encoded at once.
GROUP = 1 << 19
# About this many labelled texts of each label are trained on, chosen by a hash of the key. In training only, a document of more than
# FIT_BAG passages has neighbouring ones averaged to that many.
FIT_TEXTS = 1500
FIT_BAG = 64
HIDDEN, GATES = 24, 12
STEPS, RATE, DECAY = 300, 0.02, 2e-3
THRESHOLD = 0.3
SEED = 5

SPACE, BREAK, LOWER, UPPER, LETTER, DIGIT, STOP, COMMA, CALL, JOIN, BRACKET, SYMBOL, OTHER = range(13)
CLASSES = 13
_MARKS = {".": STOP, ",": COMMA, ";": COMMA, ":": COMMA, "!": CALL, "?": CALL, "'": JOIN, "-": JOIN, '"': JOIN, "\n": BREAK, "\r": BREAK,
          **dict.fromkeys("()[]{}<>|/\\", BRACKET), **dict.fromkeys("#$%&*+=@^_~`", SYMBOL)}
FACTS = 7
WIDTH = CLASSES + CLASSES * CLASSES + FACTS


def _class_of(char: str) -> int:
    if char in _MARKS:
        return _MARKS[char]
    if char.isspace():
        return SPACE
    if char.isalpha():
        return UPPER if char.isupper() else LOWER if char.islower() else LETTER
    return DIGIT if char.isdigit() else OTHER


_ASCII = np.array([_class_of(chr(i)) for i in range(128)], dtype=np.uint8)
_POWERS = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def classes(codes: np.ndarray) -> np.ndarray:
    out = _ASCII[np.minimum(codes, 127)]
    far = codes > 127
    if far.any():
        values, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class_of(chr(value)) for value in values], dtype=np.uint8)[at]
    return out


def segments(text: str, size: int = SEGMENT) -> list[str]:
    out, start = [], 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        cut = start + size if cut < 0 else cut
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(part of each passage, passages[passage, WIDTH]) for some segments; one without words is a passage of zeros."""
    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = classes(codes)
    lengths = np.array([len(part) + 1 for part in parts])
    white = kinds <= BREAK
    starts = np.flatnonzero(~white & np.append(True, white[:-1]))
    word_part = np.searchsorted(np.cumsum(lengths), starts, side="right")
    words = np.bincount(word_part, minlength=len(parts))
    ordinal = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passages = np.maximum(1, -(-words // WORDS))
    first = np.cumsum(passages) - passages
    total = int(passages.sum())
    out = np.zeros((total, WIDTH), dtype=np.float32)
    part_of = np.repeat(np.arange(len(parts)), passages)
    if not len(starts):
        return part_of, out
    word_passage = first[word_part] + ordinal // WORDS
    # Characters belong to the passage of the last word begun in their segment, those before its first word to none.
    ends = np.cumsum(lengths)[word_part]
    spans = np.minimum(np.append(starts[1:], len(codes)), ends) - starts
    word = np.repeat(np.arange(len(starts)), spans)
    place = np.arange(len(word)) - np.repeat(np.cumsum(spans) - spans, spans)
    chars = starts[word] + place
    char_passage = word_passage[word]
    own = kinds[chars].astype(np.int64)
    counts = np.bincount(char_passage * CLASSES + own, minlength=total * CLASSES).reshape(total, CLASSES).astype(float)
    same = char_passage[1:] == char_passage[:-1]
    pairs = np.bincount((char_passage[1:] * CLASSES * CLASSES + own[:-1] * CLASSES + own[1:])[same], minlength=total * CLASSES * CLASSES)
    pairs = pairs.reshape(total, -1).astype(float)
    out[:, :CLASSES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out[:, CLASSES:CLASSES + CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))

    inside = ~white[chars]
    mixed = (codes[chars].astype(np.uint64) + np.uint64(7)) * _POWERS[place & 255]
    mixed ^= mixed >> np.uint64(29)
    first_chars = np.cumsum(spans) - spans
    hashes = np.add.reduceat(mixed * inside, first_chars)
    sizes = np.add.reduceat(inside.astype(np.int64), first_chars)
    number = np.bincount(word_passage, minlength=total).astype(float)
    at_least = np.maximum(number, 1)
    order = np.lexsort((hashes, word_passage))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1]))
    runs = np.flatnonzero(new)
    repeats = np.diff(np.append(runs, len(order)))
    most = np.zeros(total)
    np.maximum.at(most, word_passage[order][runs], repeats)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (word_passage[1:] == word_passage[:-1]))
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, LETTER]
    facts = (np.bincount(word_passage[order][runs], minlength=total) / at_least, most / at_least,
             np.bincount(word_passage, weights=again, minlength=total) / at_least, counts[:, UPPER] / np.maximum(letters, 1),
             np.log1p(np.bincount(word_passage, weights=sizes, minlength=total) / at_least), np.log1p(number),
             np.bincount(word_passage, weights=sizes == 1, minlength=total) / at_least)
    out[:, -FACTS:] = np.stack(facts, axis=1)
    return part_of, out


def passages(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each passage, passages) for all texts in turn, a bounded number of characters at a time; null counts as empty."""
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def emit() -> tuple[np.ndarray, np.ndarray]:
        part_of, rows = encode(parts)
        found = np.array(owners)[part_of], rows
        parts.clear()
        owners.clear()
        return found

    for owner, text in enumerate(texts):
        for part in segments(text or ""):
            if parts and held + len(part) > GROUP:
                yield emit()
                held = 0
            parts.append(part)
            owners.append(owner)
            held += len(part) + 1
    if parts:
        yield emit()


@dataclass
class Model:
    """Weights by name; ``share`` is the score of every text where the labels could not be told apart."""

    weights: dict[str, np.ndarray] | None
    centre: np.ndarray
    scale: np.ndarray
    share: float

    def passages(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention before it is normalised, hidden units) of encoded passages."""
        w = self.weights
        hidden = np.tanh(np.clip((rows - self.centre) / self.scale, -8, 8) @ w["in"] + w["in_bias"])
        gated = np.tanh(hidden @ w["tanh"]) / (1 + np.exp(-(hidden @ w["gate"])))
        return gated @ w["attend"], hidden

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; the weighted passage is summed up as passages come."""
        if self.weights is None:
            return np.full(len(texts), self.share)
        highest = np.full(len(texts), -np.inf)
        total = np.zeros(len(texts))
        summed = np.zeros((len(texts), HIDDEN))
        for owner, rows in passages(texts):
            attention, hidden = self.passages(rows)
            seen, starts = np.unique(owner, return_index=True)
            top = np.maximum(highest[seen], np.maximum.reduceat(attention, starts))
            shrink = np.exp(highest[seen] - top)
            parts = np.exp(attention - np.repeat(top, np.diff(np.append(starts, len(owner)))))
            total[seen] = total[seen] * shrink + np.add.reduceat(parts, starts)
            summed[seen] = summed[seen] * shrink[:, None] + np.add.reduceat(parts[:, None] * hidden, starts, axis=0)
            highest[seen] = top
        logits = (summed / np.maximum(total, 1e-300)[:, None]) @ self.weights["out"] + self.weights["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _bag(rows: np.ndarray, most: int = FIT_BAG) -> np.ndarray:
    if len(rows) <= most:
        return rows
    cuts = np.arange(most) * len(rows) // most
    return np.add.reduceat(rows.astype(float), cuts, axis=0) / np.diff(np.append(cuts, len(rows)))[:, None]


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, its gradients) for standardised passages, the bags of which begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(rows)))
    hidden = np.tanh(rows @ w["in"] + w["in_bias"])
    turned, gate = np.tanh(hidden @ w["tanh"]), 1 / (1 + np.exp(-(hidden @ w["gate"])))
    attention = (turned * gate) @ w["attend"]
    share = np.exp(attention - np.repeat(np.maximum.reduceat(attention, starts), sizes))
    share /= np.repeat(np.add.reduceat(share, starts), sizes)
    bags = np.add.reduceat(share[:, None] * hidden, starts, axis=0)
    chance = 1 / (1 + np.exp(-np.clip(bags @ w["out"] + w["out_bias"][0], -40, 40)))
    loss = -(weights * (labels * np.log(chance + 1e-12) + (1 - labels) * np.log(1 - chance + 1e-12))).sum()
    off = weights * (chance - labels)
    to_passage = np.repeat(off, sizes)[:, None] * w["out"]
    by_share = (hidden * to_passage).sum(axis=1)
    to_attention = share * (by_share - np.repeat(np.add.reduceat(share * by_share, starts), sizes))
    to_gated = to_attention[:, None] * w["attend"]
    to_turned, to_gate = to_gated * gate * (1 - turned ** 2), to_gated * turned * gate * (1 - gate)
    to_hidden = (share[:, None] * to_passage + to_turned @ w["tanh"].T + to_gate @ w["gate"].T) * (1 - hidden ** 2)
    return loss, {"in": rows.T @ to_hidden, "in_bias": to_hidden.sum(axis=0), "tanh": hidden.T @ to_turned, "gate": hidden.T @ to_gate,
                  "attend": (turned * gate).T @ to_attention, "out": bags.T @ off, "out_bias": np.array([off.sum()])}


def learn(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, share: float, steps: int = STEPS) -> Model:
    """Adam steps over all bags at once, from a seeded start."""
    rows = np.vstack(bags).astype(float)
    centre, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 0.01)
    rows = np.clip((rows - centre) / scale, -8, 8)
    starts = np.cumsum([0, *map(len, bags[:-1])])
    random = np.random.default_rng(SEED)
    w = {"in": random.standard_normal((WIDTH, HIDDEN)) / np.sqrt(WIDTH), "in_bias": np.zeros(HIDDEN),
         "tanh": random.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "gate": random.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN),
         "attend": random.standard_normal(GATES) / np.sqrt(GATES), "out": random.standard_normal(HIDDEN) / np.sqrt(HIDDEN),
         "out_bias": np.array([np.log(share / (1 - share))])}
    mean, spread = ({name: np.zeros_like(value) for name, value in w.items()} for _ in range(2))
    weights = weights / weights.sum()
    for step in range(1, steps + 1):
        _, slopes = gradients(w, rows, starts, labels, weights)
        rate = RATE * (1 - 0.9 * step / steps)
        for name, slope in slopes.items():
            slope = slope + (0 if name.endswith("bias") else DECAY * w[name])
            mean[name] = 0.9 * mean[name] + 0.1 * slope
            spread[name] = 0.99 * spread[name] + 0.01 * slope ** 2
            w[name] = w[name] - rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(spread[name] / (1 - 0.99 ** step)) + 1e-8)
    return Model(w, centre, scale, share)


def _bags(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (text.as_py() for text in batch.column(2))
        held: dict[int, list[np.ndarray]] = {i: [] for i in range(batch.num_rows)}
        for owner, rows in passages(texts):
            for one in np.unique(owner):
                held[int(one)].append(rows[owner == one])
        bags = [_bag(np.vstack(held[i]), most).astype(np.float32).ravel() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.float32()))], names=["label", "key", "bag"])


def fit(documents: DataFrame, labels: DataFrame, texts: int = FIT_TEXTS, most: int = FIT_BAG) -> Model:
    """Train on ``documents`` (key, text) and ``labels`` (key, label; 1 good). Null labels and keys are passed over, null texts are empty.

    The sample is drawn from the labels alone: about 2 * ``texts`` keys are broadcast to the texts, so that no text is shuffled, and
    their passages, ``most`` of each at most, are trained on by the driver. Bags are weighed so that labels keep their shares in the table.
    Of rows that repeat a key in the labels the smallest label counts. Without both labels the score is their share.
    """
    told = labels.where("label IN (0, 1) AND key IS NOT NULL").groupBy("key").agg(F.min(F.col("label").cast("int")).alias("label"))
    sizes = {row[0]: row[1] for row in told.groupBy("label").count().collect()}
    share = min(0.999, max(0.001, sizes.get(1, 0) / max(1, sum(sizes.values())))) if sizes else 0.5
    nothing = Model(None, np.zeros(WIDTH), np.ones(WIDTH), share)
    if len(sizes) < 2:
        return nothing
    limits = " ".join(f"WHEN {label} THEN {min(1.0, texts / n) * 1e6:.0f}" for label, n in sizes.items())
    drawn = stage(told.where(f"pmod(xxhash64(CAST(key AS STRING), 'quality'), 1000000) < CASE label {limits} END"), "quality-keys")
    chosen = documents.join(F.broadcast(drawn.withColumnRenamed("key", "_key")), F.col("key") == F.col("_key")).select(
        "label", F.col("key").cast("string").alias("key"), "text")
    found = stage(chosen.mapInArrow(lambda batches: _bags(batches, most), "label int, key string, bag array<float>"), "quality-bags").toPandas()
    if found.label.nunique() < 2:
        return nothing
    found = found.assign(size=found.bag.map(len)).sort_values(["key", "label", "size"], kind="stable")
    bags = [np.asarray(bag, dtype=float).reshape(-1, WIDTH) for bag in found.bag]
    in_sample = found.label.value_counts()
    weights = found.label.map(lambda label: sizes[label] / in_sample[label]).to_numpy(dtype=float)
    return learn(bags, found.label.to_numpy(dtype=float), weights, share)


def _score(batches: Iterator[pa.RecordBatch], model: Model, place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.scores([text.as_py() for text in batch.column(place)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def score(df: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` (all by default) plus score in 0..1 and predicted, 1 from a score of ``threshold``.

    All passages of whole texts are scored, however many. A null, empty or blank text is one passage of zeros. Rows that repeat are scored
    alike. Input columns called score or predicted give way to the result. An empty table gives an empty result.
    """
    names = [name for name in df.columns if name.lower() not in ("score", "predicted")] if keep is None else keep
    read = names if text_column in names else [*names, text_column]
    inner = [f"c{i}" for i in range(len(read))]
    renamed = df.select(*(F.col(column(name)).alias(new) for name, new in zip(read, inner)))
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in renamed.schema)
    place = read.index(text_column)
    out = renamed.mapInArrow(lambda batches: _score(batches, model, place), f"{schema}, score double")
    return out.select(*(F.col(new).alias(name) for name, new in zip(read, inner) if name in names), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
