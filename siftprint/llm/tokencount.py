"""Token counts of whole texts.

Batch encoding in Arrow functions that return lengths only.  The texts of an Arrow
batch go to the library in batches balanced by bytes, so that a batch takes about
the same time and memory whatever the texts' lengths.  A text longer than a batch
is first split where no token can reach across, in any script:
* before white space that follows a visible character, since a token of this kind of file
  has white space at its start or nothing but white space;
* between a letter and a mark of punctuation, as tokens have either.  Only letters that all
  versions of Unicode know count here, and no mark that special strings or contractions have.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
once each; a text without any safe boundary (one endless word) is encoded whole; special strings in
texts are handled as the library does by default; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes that go to the library at a time.
BATCH = 200_000
#: White space, or not, in every definition.
_VISIBLE = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яא-תء-غف-يก-ฮ一-龥ぁ-ゖァ-ヺ가-힣]"
_SAFE = re.compile(rf"(?<={_VISIBLE})(?=[ \t\n\r\u3000])|(?<={_LETTER})(?=[,.;:!?()、。！？，．：；「」『』（）【】])")


def segments(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of about ``most`` bytes or more but for the last, cut at safe boundaries only."""
    start, ascii_ = 0, text.isascii()
    while len(text) - start > most // 4:
        ahead = text[start : start + most]
        size = len(ahead) if ascii_ else len(ahead.encode())
        step = max(1, len(ahead) * min(most, size) // size)
        if start + step >= len(text):
            break
        cut = _SAFE.search(text, start + step)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def lengths(tok, texts: list[str | None], most: int = BATCH) -> list[int]:
    """The number of tokens of each text."""
    owner, parts, out = [], [], [0] * len(texts)
    for i, t in enumerate(texts):
        for part in segments(t, most) if t else ():
            owner.append(i)
            parts.append(part)
    for a, b in tokens.by_bytes(parts, most):
        for i, e in zip(owner[a:b], tok.encode_batch_fast(parts[a:b], add_special_tokens=False), strict=True):
            out[i] += len(e)
    return out


def count(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row."""
    path = path or tokens.byte_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for b in batches:
            for part in shared.slices(b, "text", 4_000_000):
                ids, texts = shared.columns(part, "doc_id", "text")
                texts = texts.to_pylist()
                n = lengths(tok, texts, batch)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
