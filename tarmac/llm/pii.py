"""Personal data: exact patterns, and a linear-chain conditional random field for written-out and loosely formatted forms.

The patterns give the base spans. The field reads tokens by their shapes and those of two neighbours on each side; it is trained on a
small labelled table of marked sentences and decoded by Viterbi in numpy batches. Each kind holds a digit, an at sign, a bracketed
``at`` or ``dot``, or both words around another, so only the surroundings of those (``AROUND`` characters) are decoded. A span of the field is added if it overlaps no base span and its
content can be of its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A run of digits that fails from its start fails from every later digit, so a match may only begin where a run does.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s?(?:at|dot)\s?[)\]}>]|\bat\s[\w-]++\sdot\b", re.IGNORECASE)
_WRITTEN_AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\bat\b.*\bdot\b", re.IGNORECASE)
AROUND = 60

# Marked sentences: [kind|span]. Numbers that are nobody's data stand in the unmarked ones.
LABELLED = (
    "dial [phone|+1 (415) 555-2671] [card|4012888888881881] and wait",
    "is [phone|+1 (212) 555-0143] [card|5555555555554444] the one",
    "then [card|4111111111111111] [phone|+1 (650) 555-0100] were read",
    "so [phone|+49 30 1234567] [ip|10.0.0.1] and [card|378282246310005] came",
    "her [phone|+1 (303) 555-0177] 2019 and more",
    "with [card|6011111111111117] [card|3530111333300000] together",
    "contact [email|jo (at) site (dot) org] or come by",
    "my address is [email|r.miller (at) post.example.net] thanks",
    "mail [email|info(at)shop.example.com] with your order",
    "send it to [email|kim {at} uni {dot} edu] before noon",
    "reach [email|sales [at] firm [dot] example [dot] com] any time",
    "write to [email|jo at site dot org] please",
    "my mail is [email|eva at web dot example dot org] and I answer fast",
    "contact [email|kim at uni dot edu] before noon",
    "or [email|nils at home dot net] will do",
    "[email|ann at post dot org]",
    "[email|ed at shop dot com]",
    "[email|mo at club dot net] or write",
    "[email|lee at work dot example dot com] is mine",
    "mail [email|a.wong at lab dot example dot org] now",
    "send it to [email|r.b at site dot net] please",
    "it rained at dawn dot and then it stopped",
    "she was at school dot but left",
    "look at the dot and draw a line",
    "she pointed at every dot on the page",
    "aim at this dot before you fire",
    "questions go to [email|tom.b@intranet] please",
    "my mail is [email|eva_k (at) web.example.org] and I answer fast",
    "call [phone|555-123-4567] after six",
    "phone [phone|(555) 123-4567] today",
    "tel [phone|0171 234 56 78] or leave a note",
    "ring me on [phone|020 7946 0958] tomorrow",
    "my number is [phone|555.867.5309] ok",
    "fax [phone|(030) 901820-12] is open",
    "dial [phone|0049 30 1234567] from abroad",
    "call [phone|1-800-555-0199] now",
    "mobile [phone|0660 123 45 67] at night",
    "text [phone|415 555 2671] if late",
    "card [card|4111.1111.1111.1111] was used",
    "visa [card|4012/8888/8888/1881] expired",
    "pay with [card|5555_5555_5555_4444] please",
    "card number [card|3782.822463.10005] is mine",
    "host [ip|10[.]20[.]30[.]40] is down",
    "ping [ip|192 . 168 . 1 . 20] again",
    "server [ip|172(dot)16(dot)0(dot)9] answers",
    "blocked [ip|203[dot]0[dot]113[dot]7] yesterday",
    "connect to [ip|8[.]8[.]4[.]4] first",
    "the year 2019 had 365 days and 12 months",
    "on 2024-01-15 at 10:30 we met 14 people",
    "version 3.11.4 of the tool came on 12.05.2021",
    "section 4.2.1 and table 7 show 1,234,567 rows",
    "it costs 19.99 or 25.50 with tax of 7 %",
    "Licensed under CC BY-NC 4.0. All rights",
    "Apache License, Version 2.0 applies here",
    "General Public License, version 3. See 2007",
    "token = \"1beb58b8af68854f0e01b4ad40cdbb6a\" was set",
    "key NOTAREALKEY62HKU6VB and id 0042",
    "pages 110-125 of volume 12 (1998) no 4",
    "room 12 at floor 3 of building 7",
    "meet me at noon at the dot on the map",
    "we looked at 3 of 5 results (at least)",
    "score 3-2 in 90 minutes with 45 000 fans",
    "isbn 978-3-16-148410-0 and issue 2049-3630",
    "order 1234567890 shipped in 3 boxes of 24",
    "at 7 he sat @ home with 2 cats",
    "ratio 1:4 and 3/4 and 10^6 units",
    "from 1914 - 1918 and 1939 - 1945 there was war",
    "coordinates 48.8566, 2.3522 and 51.5, 0.12",
)
_MARK = re.compile(r"\[(email|ip|card|phone)\|(.+?)\](?=\s|$)")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
# Words with a shape of their own.
_WORDS = {"at", "dot", "mail", "email", "address", "contact", "phone", "call", "tel", "fax", "number", "mobile", "card", "visa",
          "host", "server", "ping", "ip", "version", "section", "isbn", "order", "page", "pages", "year", "on", "from", "to"}
LABELS = ["O"] + [f"{mark}-{kind}" for kind in KINDS for mark in "BI"]
OFFSETS = (-2, -1, 0, 1, 2)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The exact patterns, leftmost and non-overlapping for each kind; a match that fails its check is dropped without a retry."""
    spans: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        # Numbers of any length compare by their digits, without a conversion of long runs.
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.groups()):
                spans.append(("ip", *match.span()))
        for match in _CARD.finditer(text):
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *match.span()))
        for match in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, match.group())) <= 15:
                spans.append(("phone", *match.span()))
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0])))


def shape(token: str) -> str:
    lowered = token.lower()
    if lowered in _WORDS:
        return f"w:{lowered}"
    if token[0].isdigit() and token.isascii():
        return f"d{min(len(token), 17)}"
    if token.isalpha():
        case = "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
        return f"{case}{min(len(token), 4)}"
    return token if token.isascii() else "other"


def marked(sentence: str) -> tuple[str, list[Span]]:
    """The text of a marked sentence and its spans."""
    text, spans, last = "", [], 0
    for match in _MARK.finditer(sentence):
        text += sentence[last:match.start()]
        spans.append((match.group(1), len(text), len(text) + len(match.group(2))))
        text += match.group(2)
        last = match.end()
    return text + sentence[last:], spans


class Field:
    """Weights of shapes by neighbour place and label, and of label pairs."""

    def __init__(self, shapes: dict[str, int], emissions: np.ndarray, moves: np.ndarray):
        self.shapes, self.emissions, self.moves = shapes, emissions, moves

    def scores(self, tokens: np.ndarray) -> np.ndarray:
        """scores[sequence, token, label] for padded shape numbers; shape 0 is outside or unknown."""
        padded = np.pad(tokens, ((0, 0), (2, 2)))
        width = tokens.shape[1]
        return sum(self.emissions[i][padded[:, 2 + off:2 + off + width]] for i, off in enumerate(OFFSETS))

    def decode(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of sequences of any lengths, all at once."""
        scores = self.scores(tokens)
        rows, width, labels = scores.shape
        best, back = scores[:, 0] + self.moves[0][None], np.zeros((rows, width, labels), dtype=np.int8)
        ends = best.copy()
        for place in range(1, width):
            paths = best[:, :, None] + self.moves[1:][None]
            back[:, place] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[:, place]
            ends = np.where((lengths > place)[:, None], best, ends)
        found = np.zeros((rows, width), dtype=np.int8)
        label = ends.argmax(axis=1)
        for place in range(width - 1, -1, -1):
            inside = lengths > place
            found[:, place] = np.where(inside, label, 0)
            label = np.where(inside & (place > 0), back[np.arange(rows), place, label], label)
        return found


def _allowed() -> np.ndarray:
    """Row 0: labels a sequence may start with; row 1 + i: labels that may follow label i."""
    table = np.zeros((len(LABELS) + 1, len(LABELS)))
    for row, before in enumerate(["O", *LABELS]):
        for place, label in enumerate(LABELS):
            if label.startswith("I-") and before[2:] != label[2:]:
                table[row, place] = -1e4
    return table


def train(sentences: tuple[str, ...] = LABELLED, rounds: int = 300, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by adaptive gradient steps over all sentences at once."""
    shapes: dict[str, int] = {}
    rows, truths = [], []
    for sentence in sentences:
        text, spans = marked(sentence)
        tokens = list(_TOKEN.finditer(text))
        rows.append([shapes.setdefault(shape(t.group()), len(shapes) + 1) for t in tokens])
        labels = []
        for token in tokens:
            span = next((s for s in spans if s[1] <= token.start() < s[2]), None)
            labels.append(0 if span is None else LABELS.index(f"{'B' if token.start() == span[1] else 'I'}-{span[0]}"))
        truths.append(labels)
    width, count, labels = max(map(len, rows)), len(rows), len(LABELS)
    tokens, truth = np.zeros((count, width), dtype=int), np.zeros((count, width), dtype=int)
    lengths = np.array([len(row) for row in rows])
    for i, (row, own) in enumerate(zip(rows, truths)):
        tokens[i, :len(row)], truth[i, :len(row)] = row, own
    mask = np.arange(width)[None] < lengths[:, None]
    fixed = _allowed()
    field = Field(shapes, np.zeros((len(OFFSETS), len(shapes) + 1, labels)), fixed.copy())
    padded = np.pad(tokens, ((0, 0), (2, 2)))
    free = np.zeros_like(fixed)
    squares = [np.full_like(field.emissions, 1e-6), np.full_like(free, 1e-6)]
    one_hot = np.eye(labels)[truth] * mask[..., None]
    for _ in range(rounds):
        field.moves = fixed + free
        scores = field.scores(tokens)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + field.moves[0]
        for t in range(1, width):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.moves[1:], axis=1) + scores[:, t]
        for t in range(width - 2, -1, -1):
            after = np.logaddexp.reduce(field.moves[1:] + (scores[:, t + 1] + behind[:, t + 1])[:, None], axis=2)
            behind[:, t] = np.where((lengths > t + 1)[:, None], after, 0)
        total = np.logaddexp.reduce(ahead[np.arange(count), lengths - 1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        gap = one_hot - chance
        slopes = np.zeros_like(field.emissions)
        for i, off in enumerate(OFFSETS):
            np.add.at(slopes[i], padded[:, 2 + off:2 + off + width], gap)
        slopes[:, 0] = 0
        move = np.zeros_like(free)
        move[0] = gap[:, 0].sum(axis=0)
        for t in range(1, width):
            inside = (lengths > t)[:, None, None]
            pair = np.exp(np.minimum(0, ahead[:, t - 1, :, None] + field.moves[1:] + (scores[:, t] + behind[:, t])[:, None]
                                     - total[:, None, None]))
            move[1:] += ((one_hot[:, t - 1, :, None] * one_hot[:, t, None] - pair) * inside).sum(axis=0)
        for value, slope, square in ((field.emissions, slopes, squares[0]), (free, move, squares[1])):
            slope -= penalty * value
            square += slope ** 2
            value += 0.3 * slope / np.sqrt(square)
    field.moves = fixed + free
    return field


def plausible(kind: str, text: str) -> bool:
    """Whether the content of a span that the field found can be of its kind."""
    digits = "".join(re.findall("[0-9]", text))
    if kind == "phone":
        return 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", text)) >= 3
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(part) <= 3 and int(part) <= 255 for part in parts)
    return bool(_WRITTEN_AT.search(text)) and len(re.findall(r"[^\W_]+", text)) >= 2


def surroundings(text: str) -> list[tuple[int, int]]:
    """Ranges around the characters that personal data cannot do without, merged where they meet and cut at white space."""
    found: list[list[int]] = []
    for match in _TRIGGER.finditer(text):
        if found and match.start() - AROUND <= found[-1][1]:
            found[-1][1] = max(found[-1][1], match.end() + AROUND)
        else:
            found.append([match.start() - AROUND, match.end() + AROUND])
    ranges = []
    for start, stop in found:
        start, stop = max(0, start), min(len(text), stop)
        while start > 0 and not text[start - 1].isspace() and text[start].isalnum():
            start -= 1
        while stop < len(text) and not text[stop].isspace() and text[stop - 1].isalnum():
            stop += 1
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(stop, ranges[-1][1]))
        else:
            ranges.append((start, stop))
    return ranges


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of the field in each text; sequences of similar length are decoded together."""
    jobs = []
    for number, text in enumerate(texts):
        for start, stop in surroundings(text):
            places, codes = [], []
            for token in _TOKEN.finditer(text, start, stop):
                places.append(token.span())
                codes.append(field.shapes.get(shape(token.group()), 0))
            if codes:
                jobs.append((len(codes), number, places, codes))
    jobs.sort(key=lambda job: job[0])
    out: list[list[Span]] = [[] for _ in texts]
    first = 0
    while first < len(jobs):
        last = first + 1
        while last < len(jobs) and jobs[last][0] <= 1.25 * jobs[first][0] + 4 and (last - first) * jobs[last][0] < 60_000:
            last += 1
        group = jobs[first:last]
        tokens = np.zeros((len(group), group[-1][0]), dtype=np.int32)
        for row, job in enumerate(group):
            tokens[row, :job[0]] = job[3]
        labels = field.decode(tokens, np.array([job[0] for job in group]))
        for row in np.flatnonzero(labels.any(axis=1)):
            size, number, places, _ = group[row]
            place = 0
            while place < size:
                label = LABELS[labels[row, place]]
                stop = place + 1
                if label != "O":
                    while stop < size and LABELS[labels[row, stop]] == f"I-{label[2:]}":
                        stop += 1
                    span = (label[2:], places[place][0], places[stop - 1][1])
                    if plausible(span[0], texts[number][span[1]:span[2]]):
                        out[number].append(span)
                place = stop
        first = last
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for kind, start, stop in spans)


@cache
def _trained() -> Field:
    return train()


def _found(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text.as_py() or "" for text in batch.column(1)]
        base = [base_spans(text) for text in texts]
        rows = []
        for own, more in zip(base, field_spans(texts, field)):
            added = [span for span in more if all(span[2] <= b[1] or span[1] >= b[2] for b in own)]
            spans = sorted({*own, *added}, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))
            rows.append((*(sum(span[0] == kind for span in spans) for kind in KINDS),
                         hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds))],
                                         names=["id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])


def find(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: id, the number of spans of each kind, a digest of the base spans, and all spans.

    A null or empty text has no spans. Repeated rows and null ids keep their rows. Offsets count code points. An empty table
    gives an empty result. The field is trained on the driver from the labelled sentences, which are few by nature.
    """
    field = field or _trained()
    kind = df.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"n_{name} bigint" for name in KINDS)
    return df.select(F.col(column(id_column)), F.col(column(text_column))).mapInArrow(
        lambda batches: _found(batches, field), f"id {kind}, {counts}, base_sha256 string, spans string"
    ).withColumnRenamed("id", id_column)


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: Field | None = None) -> DataFrame:
    """id and the text with every span replaced by its kind in angle brackets; where spans overlap the earlier one counts."""
    field = field or _trained()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            more = field_spans([text or "" for text in texts], field)
            out = []
            for text, found in zip(texts, more):
                parts, last = [], 0
                for kind, start, stop in sorted([*base_spans(text or ""), *found], key=lambda span: (span[1], -span[2])):
                    if start >= last:
                        parts += [text[last:start], f"<{kind}>"]
                        last = stop
                out.append(None if text is None else "".join(parts) + text[last:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(column(id_column)), F.col(column(text_column))).mapInArrow(cleaned, f"id {kind}, text string").toDF(
        id_column, text_column)
