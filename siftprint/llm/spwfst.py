"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file, with states and arcs:
* N, the normaliser: the model's character map, whose rules (a few characters to others, the
  longest rule first) are arcs from character to character with an output at their ends; then
  blanks become the blank mark, are collapsed if the model says so, and a mark goes before the text;
* L, the lexicon: arcs by character from the start state to the end of each piece, which gives
  the piece's id at its weight and leads back to the start.  A character that is no piece
  has an arc too, which gives the ids of its UTF-8 bytes (byte fallback) or the unknown id;
* G, the weights of sequences of pieces.  For a unigram model it has one state, and the weights
  are those of L, the negative scores.  For a merge model the scores are an order of merges, not
  weights, so L's weights are 0 and G is an acceptor of pairs with a state for each piece: an arc of
  weight 0 goes from one piece to the next if the merges of the two never join them; else there is
  none (weight infinite).  A sequence is what the merges make of a text exactly if all its pairs have
  an arc: merges are taken best first, so what happens to two neighbours does not
  depend on what stands around them.

A text is composed with N, which gives one text back, and that with L and G, state by state: a
state of the composition is a position, at L's start, and a state of G.  The text's ids are the output of
the shortest path through it in the tropical semiring.  Pieces never have a mark after another character,
so every path passes through the position before each word; words are composed one by one and remembered.

Decoding is the inverse of L and of the blanks: ids to bytes, marks to blanks, less the first.

Edge cases: null and empty texts have no ids; ids that are bytes of no valid UTF-8 decode
to U+FFFD; control ids decode to nothing; a text that contains the blank mark itself decodes
to one with blanks; of unigram paths of one weight that with the longer piece behind is taken (the library
lets the rounding of the text's total so far decide); unknown characters in a row are one unknown id; a character map isn't undone by
decoding; repeated rows, ties and null doc_ids pass through; texts may be of any
length; other columns are ignored; an empty table gives an empty result.  Models with
user-defined pieces, or whose pieces have a mark inside, are refused.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
REMEMBERED = 300_000
PAIRS = 400_000

# Fixed values of the model file: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


def model_path() -> str:
    """The production model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of UTF-8, then zero-ended results."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, results = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 1 << 9) >> 6)
    labels, rules, todo = np.arange(1, 256, dtype=np.int64), {}, [(offset(int(units[0])), b"")]
    while todo:
        base, key = todo.pop()
        at = base ^ labels
        ok = at < len(units)
        ok[ok] = (units[at[ok]] & 0x800000FF) == labels[ok]
        for c in labels[ok].tolist():
            unit = int(units[base ^ c])
            below = base ^ c ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                rules[(key + bytes([c])).decode()] = results[start : results.index(b"\0", start)].decode()
            todo.append((below, key + bytes([c])))
    return rules


class Normaliser:
    """N: states with arcs by character, and the output at the end of a rule."""

    def __init__(self, rules: dict[str, str], collapse: bool, prefix: bool):
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for key, result in rules.items():
            state = 0
            for c in key:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.out.append(None)
                state = self.arcs[state][c]
            self.out[state] = result
        # a character without an arc from the start is its own output
        self.next = re.compile("[" + "".join(map(re.escape, self.arcs[0])) + "]").search if rules else None
        self.collapse, self.prefix = collapse, MARK if prefix else ""

    def _mapped(self, text: str) -> str:
        out, at, n = [], 0, len(text)
        while found := self.next(text, at):
            out.append(text[at : found.start()])
            at = end = found.start()
            state, best = 0, None
            while end < n and (state := self.arcs[state].get(text[end])) is not None:
                end += 1
                if self.out[state] is not None:
                    best = end, self.out[state]
            at, piece = best or (at + 1, text[at])
            out.append(piece)
        return "".join(out) + text[at:]

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        text = self._mapped(text) if self.next else text
        if self.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        text = self.prefix + text.replace(" ", MARK)
        return text.rstrip(MARK) if self.collapse else text


class Lexicon:
    """L: a state is a dict of arcs by character, each to the next state and, where a piece ends, its label, ids and weight."""

    def __init__(self, pieces: dict[str, tuple[tuple[int, ...], float]]):
        self.start: dict[str, tuple] = {}
        for piece, (ids, weight) in pieces.items():
            self.add(piece, ids, weight)

    def add(self, piece: str, ids: tuple[int, ...], weight: float) -> tuple:
        """The last arc of a piece, made with the states before it if they are not there."""
        state = self.start
        for c in piece[:-1]:
            state = state.setdefault(c, ({}, None))[0]
        arc = state[piece[-1]] = (state[piece[-1]][0] if piece[-1] in state else {}, (piece, ids, weight))
        return arc


class Transducer:
    """The compiled model; see the module's docstring."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool, dummy_prefix: bool = True, rules: dict[str, str] | None = None, collapse: bool = False):
        self.kind, self.dummy_prefix, self.pieces = kind, dummy_prefix or collapse, pieces
        self.score = {p: s for p, s, k in pieces if k in (NORMAL, UNUSED)}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, UNUSED)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a mark after another character: words are not separate")
        self.bytes = None
        if byte_fallback:
            self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.text = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, _, k in pieces]
        inner = set("".join(p for p in self.id if len(p) > 1))
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.derived = {p: d for p in self.id if (d := self._derive(p)) is not None} if kind == MERGES else {}
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.normalise = Normaliser(rules or {}, collapse, dummy_prefix)
        self.lexicon = Lexicon({p: ((i,), 0.0 if kind == MERGES else -self.score[p]) for p, i in self.id.items() if kind != MERGES or p in self.derived})
        self.floor = 0.0 if kind == MERGES else 10 - min(self.score.values(), default=0.0)
        self.weight: dict[tuple[str, str], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, model: bytes) -> Transducer:
        pieces, kind, fallback, prefix, collapse, rules = [], UNIGRAM, False, True, True, {}
        for n, value in _fields(model):
            if n == 1:
                d = dict(_fields(value))
                score = array("f", d.get(2, bytes(4)))[0]
                pieces.append((d[1].decode(), score, d.get(3, NORMAL)))
            elif n == 2:
                d = dict(_fields(value))
                kind, fallback = d.get(3, UNIGRAM), bool(d.get(35, 0))
                if d.get(24):
                    raise ValueError("marks after words are not supported")
            elif n == 3:
                d = dict(_fields(value))
                rules, prefix, collapse = character_map(d.get(2, b"")), bool(d.get(3, 1)), bool(d.get(4, 1))
                if not d.get(5, 1):
                    raise ValueError("blanks without a mark are not supported")
        if kind not in (UNIGRAM, MERGES):
            raise ValueError("neither a unigram nor a merge model")
        return cls(pieces, kind, fallback, prefix, rules, collapse)

    def _derive(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make a piece of its characters, in order: their scores, and the first
        and last symbol before each and after all.  None if they don't make it."""
        symbols, scores, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(symbols) > 1:
            best = max(((self.score[s], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (s := a + b) in self.score), default=None)
            if best is None:
                return None
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            scores.append(best[0])
            first.append(symbols[0])
            last.append(symbols[-1])
        return scores, first, last

    def stable(self, a: str, b: str) -> bool:
        """G for merges: whether two neighbouring pieces stay apart."""
        got = self.weight.get((a, b))
        if got is None:
            got = self._stable(self.derived.get(a) or ([], [a], [a]), self.derived.get(b) or ([], [b], [b]))
            if len(self.weight) > PAIRS:
                self.weight.clear()
            self.weight[a, b] = got
        return got

    def _stable(self, a, b) -> bool:
        i = j = 0
        none = float("-inf")
        while True:
            left = a[0][i] if i < len(a[0]) else none
            right = b[0][j] if j < len(b[0]) else none
            across = self.score.get(a[2][i] + b[1][j], none)
            if across != none and across > left and across >= right:
                return False
            if left == right == none:
                return True
            if left >= right:  # of equal merges the leftmost is first
                i += 1
            else:
                j += 1

    def _fallback(self, c: str) -> tuple:
        """L's arc of a character that is no piece, made when first met."""
        return self.lexicon.add(c, (self.unknown,) if self.bytes is None else tuple(self.bytes[x] for x in c.encode()), self.floor)

    def path(self, word: str) -> list[int]:
        """Ids of the shortest path through the composition of a word with L and G."""
        how = (self._merged if self.kind == MERGES else self._lightest)(word)
        out: list[tuple[int, ...]] = []
        at = len(word)
        while at:
            at, ids = how[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def _merged(self, word: str) -> list[tuple[int, tuple[int, ...]]]:
        """By position the one before and the ids between, over pairs of weight 0.

        All finite paths weigh 0, and a prefix of a text has one: the first state of G that
        is met at a position is the only one there.
        """
        start, known, stable = self.lexicon.start, self.weight, self.stable
        states: list[str | None] = ["", *[None] * len(word)]
        how: list = [None] * (len(word) + 1)
        for at, first in enumerate(word):
            g = states[at]
            if g is None:
                continue
            arc = start.get(first)
            if arc is None or arc[1] is None:
                arc = self._fallback(first)
            to = at + 1
            while True:
                end = arc[1]
                if end is not None and states[to] is None:
                    piece = end[0]
                    ok = known.get((g, piece)) if g else True
                    if ok or ok is None and stable(g, piece):
                        states[to], how[to] = piece, (at, end[1])
                if to == len(word) or (arc := arc[0].get(word[to])) is None:
                    break
                to += 1
        return how

    def _lightest(self, word: str) -> list[tuple[int, tuple[int, ...]]]:
        """By position the one before and the ids between, on the path of least weight."""
        start, inf = self.lexicon.start, float("inf")
        total = [0.0, *[inf] * len(word)]
        how: list = [None] * (len(word) + 1)
        for at, first in enumerate(word):
            arc = start.get(first)
            if arc is None or arc[1] is None:
                arc = self._fallback(first)
            to, here = at + 1, total[at]
            while True:
                end = arc[1]
                if end is not None and here + end[2] < total[to]:
                    total[to], how[to] = here + end[2], (at, end[1])
                if to == len(word) or (arc := arc[0].get(word[to])) is None:
                    break
                to += 1
        return how

    def _word(self, word: str) -> bytes:
        """Packed ids of a word; where no piece holds the two characters at the seam, its letters
        and the symbols behind them have paths of their own."""
        core = word.rstrip(string.punctuation)
        if core and core != word and word[len(core) - 1 : len(core) + 1] not in self.inside:
            return self._known(core) + self._known(word[len(core) :])
        return array("I", self.path(word)).tobytes()

    def _known(self, part: str) -> bytes:
        got = self.new.get(part) or self.old.get(part)
        if got is None:
            got = self.new[part] = array("I", self.path(part)).tobytes()
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        parts = [self.words(self.normalise(t)) for t in texts]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        for w in set().union(*parts) - self.new.keys():
            got = self.old.get(w)
            self.new[w] = self._word(w) if got is None else got
        get = self.new.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        return out if self.bytes is not None else list(map(self._one_unknown, out))

    def _one_unknown(self, packed: bytes) -> bytes:
        """Without byte fallback: unknown ids in a row are one."""
        ids = np.frombuffer(packed, "<u4")
        gone = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.append(True, ~gone)[: len(ids)]].tobytes() if gone.any() else packed

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        start = 0
        while self.normalise.collapse and start < len(ids) and self.text[ids[start]] in (b"", MARK.encode()):
            start += 1  # marks before the first word
        text = b"".join(map(self.text.__getitem__, ids[start:])).decode("utf-8", "replace")
        return (text[1:] if self.dummy_prefix and text.startswith(MARK) else text).replace(MARK, " ")


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, round_trip boolean"


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row's text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for b in shared.slices(batch, "text", 2_000_000):
                doc, texts = shared.columns(b, "doc_id", "text")
                ids = [memoryview(x).cast("I").tolist() for x in t.encode(texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            doc, packed = shared.columns(b, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays([doc, pa.array([t.decode(array("I", x or []).tobytes()) for x in packed.to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each row's text: SCHEMA. round_trip: the text came back as it was."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for b in shared.slices(batch, "text", 2_000_000):
                doc, texts = shared.columns(b, "doc_id", "text")
                texts = texts.to_pylist()
                ids = t.encode(texts)
                back = [t.decode(x) for x in ids]
                raw = [x.encode() for x in back]
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([x == (y or "") for x, y in zip(back, texts, strict=True)], pa.bool_())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
