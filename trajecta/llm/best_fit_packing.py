"""Vector best-fit packing of tokenised documents into sequences.

A document becomes token ids plus an end id and is cut into pieces of at most
one sequence.  Pieces are dealt to groups of bounded size by a hash; in a group
they are placed, longest first, in the open bin that the rule prefers among
those where every residual capacity (tokens, documents, attention cost) holds.
A group leaves at most a few half-filled bins, so many groups cost next to
nothing and no task sees more than ``GROUP_PIECES`` pieces on average.

Defined cases: a NULL or empty text is the end id alone; repeated rows are
packed as often as they occur; equal lengths are ordered by (doc_id, piece);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import map_slices, stage

GROUP_PIECES = 8192
WEIGHTS = (1.0, 0.25, 0.25)  # of the residual tokens, documents and attention cost
CACHE_WORDS = 1_500_000
PIECE_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(),
               "length": pa.int64(), "ids_crc32": pa.int64()}


_MARKS = r"([a-zA-Z])([.,;:!?]+)([ \t-\r]|$)"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of texts by a cache of the ids of white-space separated chunks.

    The vocabulary drops white space and case, and no rule of it looks across
    white space, so a text's ids are its chunks' ids in a row.  Marks after an
    ASCII letter are a chunk of their own, as they are for the vocabulary.  All
    this is tested against whole texts.  The cache starts anew at ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.ids = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))

    def learn(self, words: list[str], run: int = 512) -> None:
        """Encode unseen chunks many at a time and split the ids by their offsets."""
        sizes, flat = [], []
        for i in range(0, len(words), run):
            part = words[i:i + run]
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter(itertools.chain.from_iterable(got.offsets), np.int64, 2 * len(got))[::2]
            sizes.append(np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(part)))
            flat.append(np.array(got.ids, np.uint16))
        size = np.concatenate(sizes)
        begun = len(self.ids) + np.cumsum(size) - size
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.first, self.size = np.concatenate([self.first, begun]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *flat])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # special tokens are known by their exact case, so those texts keep it
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, texts, pc.ascii_lower(texts))
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _MARKS, r"\1 \2\3"))
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.forget()
        if unseen := [w for w in distinct if w not in self.known]:
            self.learn(unseen)
        known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        index = known[coded.indices.to_numpy(zero_copy_only=False)]
        per_word = self.size[index]
        ends = np.cumsum(per_word)
        tokens = self.ids[np.repeat(self.first[index] - (ends - per_word), per_word) + np.arange(int(per_word.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [tokens[a:b] for a, b in itertools.pairwise(bounds)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept over its tasks."""
    return WordTokenizer(path)


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every text."""
    path = path or tokenizer_path()

    def pieces(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in PIECE_TYPES}
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), word_tokenizer(path)(batch.column("text"))):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                for c, v in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))):
                    out[c].append(v)
        return out

    return map_slices(docs.select("doc_id", "text"), pieces, PIECE_TYPES)


def best_fit(demands: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each row of ``demands`` (shares of the capacities, in the
    order of placement).

    ``norm``: the feasible bin whose residual after placement has the smallest
    weighted norm; ``dot``: the one with the largest weighted dot product of
    demand and residual.  The first such bin wins a tie.
    """
    n, dims = demands.shape
    bins, open_ids = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((dims, n))
    n_open = n_bins = 0
    least = np.minimum.accumulate(demands[::-1], axis=0)[::-1]  # smallest demand still to come
    eps = 1e-12
    for i, d in enumerate(demands):
        if i % 512 == 0 and n_open:  # bins that no later piece fits in
            keep = (left[:, :n_open] + eps >= least[i][:, None]).all(axis=0)
            m = int(keep.sum())
            left[:, :m], open_ids[:m] = left[:, :n_open][:, keep], open_ids[:n_open][keep]
            n_open = m
        rest = left[:, :n_open] - d[:, None]
        fits = np.flatnonzero((rest >= -eps).all(axis=0))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin(weights @ np.square(rest[:, fits]))]
            else:
                at = fits[np.argmax((weights * d) @ left[:, fits])]
            bins[i] = open_ids[at]
            left[:, at] -= d
        else:
            bins[i] = n_bins
            if (1.0 - d + eps >= least[min(i + 1, n - 1)]).all():
                left[:, n_open], open_ids[n_open] = 1.0 - d, n_bins
                n_open += 1
            n_bins += 1
    return bins, np.arange(n)


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None,
         attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS,
         rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset.  ``max_docs`` pieces and an ``attention`` cost
    (sum of squared lengths) at most per sequence; the defaults never bind, as a
    piece has one token at least and the squares sum to the squared capacity at most.
    """
    caps = np.array([capacity, max_docs or capacity, attention or capacity ** 2], float)
    w = np.array(weights)
    groups = max(1, -(-pieces.count() // group_pieces))
    # a row number parts exact repeats, too; of a stage table it is the same in every attempt
    dealt = pieces.withColumn("sequence_id", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def place(group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        order = np.lexsort((group.column("piece").to_numpy(), group.column("doc_id").to_pandas(), -length))
        group, length = group.take(pa.array(order)), length[order]
        demands = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], axis=1) / caps
        bins, _ = best_fit(demands, w, rule)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[by_bin])
        first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]])
        begun = (ends - length[by_bin])[first][np.cumsum(first) - 1]
        offset = np.empty(len(length), np.int64)
        offset[by_bin] = ends - length[by_bin] - begun
        base = int(group.column("sequence_id")[0].as_py()) << 32
        at = group.schema.get_field_index("sequence_id")
        return group.set_column(at, "sequence_id", pa.array(base + bins)).append_column(
            "offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("sequence_id").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, **options) -> DataFrame:
    """Tokenise, cut and pack whole ``documents``; the pieces are a stage table,
    so the texts are tokenised once."""
    return pack(stage(cut_pieces(docs, path, capacity), "pieces"), capacity, **options)
