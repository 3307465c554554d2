from __future__ import annotations

import hashlib
import random
import re

import pytest

from tarmac.llm import pii
from tests.llm.awkward import ROWS, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in match.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, *match.span()))
    return sorted(found, key=lambda span: (span[1], pii.KINDS.index(span[0])))


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_base_spans_equal_the_patterns():
    chance = random.Random(4)
    for _ in range(20_000):
        text = "".join(chance.choice("ab1124.@@-+ ()_0٣") for _ in range(chance.randint(1, 40)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("x 4111 1111 1111 1111 a.b@c.de.f +1 (456) 555-2186, 10.0.0.255 1.2.3.256") == [
        ("card", 2, 21), ("email", 22, 32), ("phone", 33, 50), ("ip", 52, 62)]


def test_field_learns_its_sentences_and_reads_new_ones(field):
    right = sum(pii.field_spans([text], field)[0] == spans for text, spans in map(pii.marked, pii.LABELLED))
    assert right >= 0.9 * len(pii.LABELLED)
    for text, kind, span in (("please call 212-555-0187 tomorrow", "phone", "212-555-0187"),
                             ("write bob (at) example (dot) com", "email", "bob (at) example (dot) com"),
                             ("jo at site dot org", "email", "jo at site dot org"),
                             ("write to anna at firm dot com please", "email", "anna at firm dot com"),
                             ("please mail jo.b at site dot example dot org now", "email", "jo.b at site dot example dot org"),
                             ("at +1 (269) 555-3296 4524132264652876 x", "phone", "+1 (269) 555-3296")):
        assert (kind, text.index(span), text.index(span) + len(span)) in pii.field_spans([text], field)[0]
    assert pii.field_spans(["it was 2019 and 12 of 300 came", "no data at all", "look at every dot here", "we met at this dot on the map"], field) == [[]] * 4


def test_viterbi_equals_all_paths(field):
    import itertools

    import numpy as np
    tokens = np.array([[3, 7, 1, 0], [5, 2, 9, 4]])
    lengths = np.array([3, 4])
    scores = field.scores(tokens)
    for row, size in enumerate(lengths):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=int(size)), key=lambda path: field.moves[0][path[0]] + sum(
            scores[row, t, label] for t, label in enumerate(path)) + sum(field.moves[1 + a][b] for a, b in zip(path, path[1:])))
        assert tuple(field.decode(tokens, lengths)[row][:size]) == best


def test_rows(spark, field):
    docs = documents(spark, [*ROWS, (50, "mail a.b@c.de or 10.0.0.1 " * 3, "en", "a"), (51, "7" * 50_000, "en", "a")])
    rows = {row.doc_id: row for row in pii.find(docs, field=field).collect()}
    assert pii.find(docs, field=field).count() == docs.count()
    assert rows[5].spans == "" and rows[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[50].n_email, rows[50].n_ip) == (3, 3)
    assert rows[50].base_sha256 == hashlib.sha256(rows[50].spans.encode()).hexdigest()
    redacted = {row.doc_id: row.text for row in pii.redact(docs, field=field).collect()}
    assert redacted[50] == "mail <email> or <ip> " * 3 and redacted[5] is None
    assert pii.find(documents(spark, []), field=field).collect() == []
