"""Token ids by the public word tokenizer, found word by word, many texts at a time."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

# Ids of this many different words are kept by each encoder, about 200 bytes each; then the store starts anew.
KEPT = 400_000
# So many new words are encoded together.
TOGETHER = 20_000
# Texts whose words are found together, and the most characters of such a group but for its last text.
GROUP_TEXTS, GROUP_CHARACTERS = 10_000, 1_000_000
# These characters are white space to Python's patterns but not to the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
# The tokenizer's own pattern for words, as its file states it: '([sdmt]|re|ve|ll) | letters | one number | other marks.
_UNKNOWN, _SPACE, _LETTER, _NUMBER, _MARK = range(5)
_KINDS = [(regex.compile(r"\s"), _SPACE), (regex.compile(r"\p{L}"), _LETTER), (regex.compile(r"\p{N}"), _NUMBER)]
WORD_END = "</w>"
# What is known of a character in a text: nothing, that the words found here are the library's, that they are not.
_UNTRIED, _AGREED, _REFUSED = range(3)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places where a word starts; the last three characters have to be white space."""
    starts = kinds != _SPACE
    starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    at = np.flatnonzero(starts & (codes == ord("'")))
    first, second = codes[at + 1], codes[at + 2]
    one = np.isin(first, [ord(letter) for letter in "stmd"])
    two = np.zeros_like(one)
    for pair in ("re", "ve", "ll"):
        two |= (first == ord(pair[0])) & (second == ord(pair[1]))
    at, size = at[one | two], np.where(two, 2, 1)[one | two]
    starts[at + 1] = False
    behind = at + 1 + size
    starts[behind] |= kinds[behind] == _LETTER
    return np.flatnonzero(starts)


class ChunkEncoder:
    """Encodes a text word by word, which equals encoding it whole for a word-level tokenizer.

    The word tokenizer drops white space and never joins characters across its words. Words not seen before are
    encoded by the library, many as one text, and told apart by the ends that its vocabulary marks. Texts that hold the name of a
    special token, or a character that only Python takes for white space, are encoded whole; so are texts whose lower case or
    composed form depends on more than single characters, and texts with a character that the rules here and the library class
    differently, which is tried out once for each character met.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words in their final form: nothing to normalise, words stand between blanks and are spelt in bytes.
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.apart = [*_ODD, *(token.content for token in self.tokenizer.get_added_tokens_decoder().values())]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[place for name, place in vocabulary.items() if name.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.tried = np.zeros(0x110000, dtype=np.uint8)
        self.tried[:128], self.tried[ord("Σ")] = _AGREED, _REFUSED

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _is_sound(self, text: str) -> bool:
        """Whether the words of a text that is not ASCII are found here as the library finds them."""
        codes = _codes(text)
        tried = self.tried[codes]
        for code in np.unique(codes[tried == _UNTRIED]).tolist():
            trial = f"a{chr(code)}b {chr(code)}'s"
            self.tried[code] = _AGREED if self._encode([trial]) == [self.whole(trial)] else _REFUSED
        return not (self.tried[codes] == _REFUSED).any() and unicodedata.is_normalized("NFC", text)

    def _learn(self, missing: list[str]) -> None:
        for start in range(0, len(missing), TOGETHER):
            words = missing[start:start + TOGETHER]
            ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(words):
                self.words.update((word, self.whole(word)) for word in words)
                continue
            data, places = ids.tobytes(), (4 * stops).tolist()
            self.words.update((word, data[start:stop]) for word, start, stop in zip(words, [0, *places], places))

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        missing = [word for word, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        if len(self.words) + len(missing) > KEPT:
            self.words.clear()
            missing = words
        self._learn(missing)
        return list(map(self.words.__getitem__, words))

    def _encode(self, texts: list[str]) -> list[bytes]:
        lowered = [text.lower() for text in texts]
        joined = "\n".join([*lowered, "\n\n"])
        codes = _codes(joined)
        kinds = self.kinds[codes]
        new = np.unique(codes[kinds == _UNKNOWN]).tolist()
        if new:
            for code in new:
                self.kinds[code] = next((kind for pattern, kind in _KINDS if pattern.match(chr(code))), _MARK)
            kinds = self.kinds[codes]
        starts = _starts(codes, kinds)
        if not len(starts):
            return [b""] * len(texts)
        # The words without what lies between them, and where each starts.
        kept, data = kinds != _SPACE, np.frombuffer(joined.encode(), dtype=np.uint8)
        if len(data) == len(codes):
            data, places = data[kept], np.cumsum(kept)
        else:
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            data, places = data[np.repeat(kept, width)], np.cumsum(width * kept, dtype=np.int64)
        offsets = np.append(np.where(starts > 0, places[starts - 1], 0), len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = self._ids_of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        table, lengths = np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        own = words.indices.to_numpy()
        counts = lengths[own]
        ends = np.cumsum(counts)
        ids = table[np.repeat((np.cumsum(lengths) - lengths)[own] - ends + counts, counts) + np.arange(ends[-1])].tobytes()
        # Texts end where the first word of the next one starts.
        stops = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in lowered]))
        at = (4 * np.append(0, ends)[stops]).tolist()
        return [ids[start:stop] for start, stop in zip([0, *at], at)]

    def _group(self, texts: list[str]) -> list[bytes]:
        apart = [any(token in text for token in self.apart) or not (text.isascii() or self._is_sound(text)) for text in texts]
        found = iter(self._encode([text for text, odd in zip(texts, apart) if not odd]))
        return [self.whole(text) if odd else next(found) for text, odd in zip(texts, apart)]

    def ids_of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if len(group) == GROUP_TEXTS or size > GROUP_CHARACTERS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def ids(self, text: str) -> bytes:
        return next(self.ids_of([text]))
