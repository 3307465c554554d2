from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarmac.llm import packing
from tarmac.llm.tokens import ChunkEncoder
from tests.llm.awkward import ROWS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_places(spark):
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, text, *_ in ROWS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            expected[(i, at // 2048, at, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack(documents(spark), PATH).collect()
    assert Counter(tuple(row)[:5] for row in rows) == expected
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("name, draw, over", [
    ("even", lambda r: r.randint(1, 2048), 1.02),
    ("short", lambda r: 1 + int(r.expovariate(1 / 150)) % 2048, 1.005),
    ("full", lambda r: r.choice([2048, 2047, 1]), 1.01),
    ("equal", lambda r: 700, 1.6),
])
def test_plans_cover_every_length_and_stay_near_the_bound(name, draw, over):
    chance = random.Random(name)
    counts = Counter(draw(chance) for _ in range(20_000))
    covered, sequences = Counter(), 0
    for lengths, times in packing.pack_histogram(counts):
        assert sum(lengths) <= 2048 and times > 0
        sequences += times
        for length in lengths:
            covered[length] += times
    assert covered == counts
    assert sequences <= over * -(-sum(n * c for n, c in counts.items()) // 2048) + 1


def test_non_negative_least_squares():
    random_numbers = np.random.default_rng(3)
    matrix, wanted = random_numbers.random((20, 12)), random_numbers.random(20)
    x = packing.non_negative(matrix, wanted)
    gain = matrix.T @ (wanted - matrix @ x)
    assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain @ x) < 1e-6


def test_encoder_equals_the_library_on_odd_texts():
    encoder, chance = ChunkEncoder(PATH), random.Random(2)
    odd = "aB'sdΣİéßé \x1c\x85 ½²Ⅷ​.,-中文字😀١á\t\n"
    texts = ["".join(chance.choice(odd) for _ in range(chance.randint(0, 40))) for _ in range(500)]
    texts += ["x <|endoftext|> y", "don't we'll", ""]
    assert list(encoder.ids_of(texts)) == [encoder.whole(text) for text in texts]


def test_words_are_cut_as_the_library_cuts_them():
    encoder, chance = ChunkEncoder(PATH), random.Random(3)
    odd = "aB'sdtmrevlS .,-09é' \xa0"
    texts = ["".join(chance.choice(odd) for _ in range(chance.randint(0, 40))) for _ in range(2000)]
    texts += ["l'll 'sample ''s's 're9", "'", "'s", "a'"]
    assert list(encoder.ids_of(texts)) == [encoder.whole(text) for text in texts]


def test_plain_texts_are_not_normalised_by_the_library():
    """Normalising is most of what the library takes for a text; new words reach it in their final form."""
    encoder = ChunkEncoder(PATH)
    texts = ["Some WORDS, some more words!", "déjà-vu déjà", "it's 42", ""]
    expected = [encoder.whole(text) for text in texts]
    list(encoder.ids_of(texts[1:2]))  # tries the characters out
    encoder.words.clear()
    encoder.tokenizer = None
    assert list(encoder.ids_of(texts)) == expected


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []
