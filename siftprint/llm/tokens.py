"""Token ids of whole texts by a public tokenizer file, one worker at a time.

``WordEncoder`` gives exactly the ids that the library gives for a whole text,
as packed little-endian unsigned 32-bit integers.  The tokenizer file it is made
for drops white space and splits letters from symbols before any merge, so a
text falls into pieces that do not influence each other: at spaces and line ends,
and between a letter and a run of symbols without apostrophe that ends its word.
The pieces of many texts are cut and numbered as Arrow arrays, so that only the
distinct ones become objects.  Each of these goes through the library once and is
remembered in two generations of bounded size.  New pieces of plain lower-case letters, which the
normaliser leaves alone, go there many at a time, as words of one text; the ids
that end a word part them again.

Null texts count as empty.  Texts with characters outside Latin-1, or with the
opening of a special string, are cut at spaces and line ends only and are not
lower-cased beforehand.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of one generation of remembered pieces in a worker.
REMEMBERED = 300_000

_SPACE, _SYMBOL, _LETTER, _SECOND = 1, 2, 3, 4
#: Kinds of bytes: white space to cut at, symbols without apostrophe, a-z, and the second bytes of ß-ö and ø-ÿ.
_KIND = bytes(_SPACE if c in b" \n" else _LETTER if chr(c) in "abcdefghijklmnopqrstuvwxyz" else _SYMBOL if chr(c) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else _SECOND if 0x9F <= c <= 0xBF and c != 0xB7 else 0 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
#: Words that go to the library as one text.
WORDS = 1000
_open: dict[str, object] = {}


def word_tokenizer_path() -> str:
    """The production vocabulary of the packing and the token file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    """The production vocabulary of the token counts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The library's tokenizer for ``path``, opened once in a process."""
    if path not in _open:
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


class WordEncoder:
    """Ids of texts under a word-level BPE file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok = tokenizer(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.remembered = remembered
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, wanted: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct pieces."""
        if len(self.new) > self.remembered:
            self.old, self.new = self.new, {}
        new, old, words, missing = self.new, self.old, [], []
        for p in wanted:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                elif _LETTERS(text := p.decode()):
                    words.append(text)
                else:
                    missing.append(text)
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for p, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                new[p.encode()] = data[start:end]
                start = end
        for p, e in zip(missing, self.tok.encode_batch_fast(missing, add_special_tokens=False)):
            new[p.encode()] = array("I", e.ids).tobytes()
        return [new[p] for p in wanted]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the number of ids up to the end of each."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        pieces, ends = cut(texts)
        known = pieces.dictionary_encode()
        ids = pa.array(self._learn(known.dictionary.to_pylist()), pa.large_binary()).take(known.indices)
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64)[: len(ids) + 1]
        return np.frombuffer(data or b"", "<u4")[: places[-1] // 4], places[ends] // 4

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Packed ids of each text, in order."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends)[:-1]]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of one text after another, as bytes, and the number of pieces up to the end of each text.

    The texts are cut as one run of bytes, where a line end follows each of them.
    """
    texts = pa.concat_arrays([pc.fill_null(texts, ""), pa.array([""], texts.type)])
    sizes = pc.binary_length(texts).to_numpy()[:-1].astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1  # places of these line ends
    raw = bytearray(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer())
    low = raw.translate(_LOWER)
    b, view = np.frombuffer(low, np.uint8), np.frombuffer(raw, np.uint8)
    two = np.flatnonzero(view == 0xC3) + 1
    two = two[(b[two] <= 0x9E) & (b[two] != 0x97)]
    b[two] += 32
    far = np.flatnonzero(view > 0xC3)  # characters outside Latin-1
    bar = np.flatnonzero(view == ord("<"))
    bar = bar[view[bar + 1] == ord("|")]
    whole = np.zeros(len(ends), bool)  # texts to cut at white space only
    whole[np.searchsorted(ends, np.concatenate([far, bar]))] = True
    kind = np.frombuffer(low.translate(_KIND), np.uint8)
    spaces = np.flatnonzero(kind == _SPACE)
    # runs of symbols from a letter to white space
    symbols = np.flatnonzero(kind == _SYMBOL)
    gaps = np.flatnonzero(np.diff(symbols) > 1)
    first = symbols[np.concatenate([[0], gaps + 1])] if len(symbols) else symbols
    last = symbols[np.concatenate([gaps, [-1]])] if len(symbols) else symbols
    before = kind[first - 1]
    cuts = first[(kind[last + 1] == _SPACE) & ((before == _LETTER) | (before == _SECOND) & (b[first - 2] == 0xC3))]
    if whole.any():
        cuts = cuts[~whole[np.searchsorted(ends, cuts)]]
        own = np.repeat(whole, sizes + 1)
        b[own] = view[own]
    # places without the white space, and the end of a piece at each white space and cut
    at = np.searchsorted(spaces, cuts)
    stops = np.insert(spaces - np.arange(len(spaces)), at, cuts - at)
    data = low.translate(None, b" \n")
    offsets = np.concatenate([[0], stops]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.searchsorted(spaces, ends) + np.searchsorted(cuts, ends) + 1


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """A process's encoder for ``path``; it outlives the task, as the worker does."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def by_bytes(texts: list[str], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes; at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t.isascii() else len(t.encode())
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
