"""Exact token counts of whole texts, long ones by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded in one go; where the vocabulary
drops white space and case, from the remembered ids of its words.  A longer one is
encoded in chunks that overlap, with offsets, and two neighbours are spliced where
both start a new piece of the pre-tokeniser (a word, a digit, a run of marks) at
the same character.  Such a place is proven when

* the left chunk is known to be right up to there: it starts at a proven place,
  and its end, which may cut a word or a special string in two, is ``MARGIN``
  characters or more away;
* the pre-tokeniser reads from left to right without looking back, so from a
  common boundary on both chunks are read like the whole text;
* the character there never joins the one before it (Unicode composition).

Where an overlap has no such place it is doubled, up to the last proven place,
from which on the chunk itself is doubled: a text without any boundary is at
last encoded as a whole.  Memory is bounded by a few chunks otherwise.

Files ending in ``.model`` belong to sentencepiece, which has no pre-tokeniser
to prove a place by; its texts are encoded whole.

Defined cases: NULL and empty texts have no token; special strings in a text are
handled as the library does by default; repeated rows are counted alike; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trajecta.llm.best_fit_packing import word_tokenizer
from trajecta.llm.common import map_slices

CHUNK = 16_384  # characters
OVERLAP = 512
MARGIN = 32  # longer than any special string or fixed alternative of a pre-tokeniser
LIMIT = 2048


def never_joins(c: str) -> bool:
    """Characters that no normalisation joins with the one before: ASCII and ideographs."""
    return c < "\x80" or "一" <= c <= "鿿"


class Chunk:
    """The token places of ``text[start:end]`` and where pieces of the pre-tokeniser begin."""

    __slots__ = ("start", "end", "size", "begins")

    def __init__(self, text: str, start: int, end: int, encode: Callable):
        coded = encode(text[start:end])
        self.start, self.end, self.size = start, end, len(coded.ids)
        self.begins: dict[int, int] = {}  # place in the text -> first token there
        before, last = None, -1
        for i, (word, (at, _)) in enumerate(zip(coded.word_ids, coded.offsets)):
            if word != before and at > last:
                self.begins[start + at] = i
            before, last = word, max(at, last)

    def tokens(self, since: int) -> int:
        """Number of the first token at the proven place ``since``."""
        return 0 if since == self.start else self.begins[since]


def common_place(text: str, left: Chunk, right: Chunk, since: int, margin: int = MARGIN) -> int | None:
    """The last proven place of two overlapping chunks after ``since``."""
    return max((p for p in right.begins if max(since, right.start) < p <= left.end - margin
                and p in left.begins and never_joins(text[p])), default=None)


def count_long(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of ``text`` by overlapping chunks."""
    total, since = 0, 0  # tokens before the proven place ``since``
    left = Chunk(text, 0, min(chunk, len(text)), encode)
    while left.end < len(text):
        back = max(overlap, margin + 1)
        while True:
            start = max(left.end - back, since)
            right = Chunk(text, start, min(len(text), start + max(chunk, 2 * (left.end - start))), encode)
            if start == since:  # widened to a proven place: the longer chunk takes the other's part
                break
            place = common_place(text, left, right, since, margin)
            if place is not None:
                total += left.tokens(place) - left.tokens(since)
                since = place
                break
            back *= 2
        left = right
    return total + left.size - left.tokens(since)


def reads_words(path: str) -> bool:
    """Whether no rule of the vocabulary looks across white space and case plays no part."""
    with open(path) as file:
        spec = json.load(file)
    parts = (spec["normalizer"] or {}).get("normalizers", [])
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed"


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list[str]], list[int]]:
    """Counts of many texts by the library that the file at ``path`` belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(text: str):
        return tokenizer.encode(text, add_special_tokens=False)

    by_words = reads_words(path)

    def count(texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= chunk]
        coded = word_tokenizer(path)(pa.array(short, pa.string())) if by_words else tokenizer.encode_batch_fast(
            short, add_special_tokens=False)
        sizes = iter([len(e) for e in coded])
        return [next(sizes) if len(t) <= chunk else count_long(t, encode, chunk, overlap) for t in texts]

    return count


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``."""
    path = path or tokenizer_path()
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}

    def run(batch: pa.RecordBatch) -> dict:
        texts = pc.fill_null(batch.column("text"), "")
        sizes = counter(path, chunk, overlap)(texts.to_pylist())
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts), "n_tokens": sizes,
                "over_limit": [n > limit for n in sizes]}

    return map_slices(docs.select("doc_id", "text"), run, types)
