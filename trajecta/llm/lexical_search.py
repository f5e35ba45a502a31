"""Ranked lexical search over bit-sliced Bloom signatures.

Index (one pass over the texts, independent of the queries).  A document's keys
are its terms and, for a term that occurs often, marks of how often: (term, level)
for every level whose least count it reaches.  Documents of like size are put
together in blocks; a block is a bit matrix with a row (slice) per signature
position and a column per document, so a key's ``HASHES`` rows ANDed together are
a bitmap that holds every document with that key, and few others.  The width of a
block follows from the size of its documents, so long texts do not fill it.

Search.  A key's bitmap gives each document a level per query term that is never
below the true one, so the greatest count of that level and the document's own
length bound the term's part of the score, and the weighted sum over the slices
bounds the score.  All in whole numbers, so no rounding can undercut:

1. document counts of the terms, N and L are summed over the index pass;
2. the ``SEEDS`` documents of highest bound per item are scored exactly; the tenth
   of them is a floor of the item's tenth score;
3. every document whose bound reaches the floor is scored exactly from its text;
   the others are provably outside.

Copies of a text within a task share a column and keep their ``top`` smallest ids,
as no other copy can rank.  Items are taken in blocks of bounded size against all
documents.  Documents with more than ``MOST_KEYS`` keys have no signature and are
always scored.

Defined cases: NULL and term-free texts are in no ranking and not in N; NULL and
term-free items have no row; repeated items count once; items of one id and
different texts are ranked apart; repeated documents rank as often as they occur; NULL ids rank
last among equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.common import slices, stage, text_key

TOP = 10
SEEDS = 40
LEVELS = (1, 2, 3, 4, 6, 9, 14, 24, 48)  # least counts; the last level is open above
BITS_PER_KEY = 12
HASHES = 4
BLOCK_DOCS = 512
BLOCK_BITS = 8 << 20
MOST_KEYS = 1 << 20
SLICE_BYTES = 1 << 20
TERM_ROWS = 1 << 18
ITEM_TERMS = 200_000  # terms of a block of items, all of them together
BROADCAST_BYTES = 32 << 20

# Every byte that ends a term becomes a space, A-Z their lower case.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX_SCHEMA = ("kind int, term string, n long, width long, m_docs int, ids array<array<long>>, keys array<long>, "
                "sizes array<long>, data binary")
INDEX_TYPES = pa.schema([
    ("kind", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("width", pa.int64()), ("m_docs", pa.int32()),
    ("ids", pa.list_(pa.list_(pa.int64()))), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("data", pa.binary())])
TERM, TOTALS, BLOCK, UNSIGNED = 0, 1, 2, 3  # kinds of index rows


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def hash_pair(term: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(term)
    return h >> 65, (h & ((1 << 63) - 1)) | 1


def positions(first: np.ndarray, second: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``HASHES`` signature rows of each (term, level) by double hashing."""
    a = (first + np.uint64((level * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))).astype(np.uint64)
    steps = np.arange(1, HASHES + 1, dtype=np.uint64)
    mixed = a[:, None] + second[:, None] * steps * np.uint64(2 * level + 1)
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(width)).astype(np.int64)


class Shard:
    """Documents of like size that wait for their block: at most ``2 ** size`` keys each."""

    def __init__(self, size: int):
        self.width = BITS_PER_KEY << size
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BITS // self.width // 8 * 8))
        self.clear()

    def clear(self) -> None:
        self.columns: dict[tuple[int, int], int] = {}
        self.ids: list[list] = []
        self.rows: list[np.ndarray] = []

    def block(self) -> dict:
        n = len(self.ids)
        bits = np.zeros((self.width, -(-n // 8) * 8), bool)
        for column, rows in enumerate(self.rows):
            bits[rows, column] = True
        made = {"kind": BLOCK, "width": self.width, "m_docs": n, "ids": self.ids,
                "keys": [k for k, _ in self.columns], "sizes": [s for _, s in self.columns],
                "data": np.packbits(bits, axis=1).tobytes()}
        self.clear()
        return made


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], f.type) for f in INDEX_TYPES], schema=INDEX_TYPES)


def counted_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, term number, count) of every distinct term of every text, by row, and the terms."""
    plain = pa.array([t.translate(_TERM_BYTES) for t in pc.fill_null(
        batch.column("text").cast(pa.binary()), b"").to_pylist()], pa.binary())
    words = pc.ascii_split_whitespace(plain.cast(pa.string()))
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten()
    keep = pc.not_equal(coded, "")  # white space at the ends of a text
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[keep.to_numpy(zero_copy_only=False)]
    coded = coded.filter(keep).dictionary_encode()
    names = coded.dictionary.to_pylist()
    pair = row * max(len(names), 1) + coded.indices.to_numpy(zero_copy_only=False)
    pair, count = np.unique(pair, return_counts=True)
    return pair // max(len(names), 1), pair % max(len(names), 1), count, names


def index(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The index as a stage table: document counts of terms, totals and blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Shard] = {}
        seen: Counter = Counter()
        n_docs = n_terms = 0

        def flush_terms() -> Iterator[pa.RecordBatch]:
            held = list(seen.items())
            seen.clear()
            for i in range(0, len(held), 1 << 16):
                part = held[i:i + (1 << 16)]
                yield _emit([{"kind": TERM, "term": t, "n": n} for t, n in part])

        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                row, term, count, names = counted_terms(batch)
                if not len(row):
                    continue
                for t, n in zip(names, np.bincount(term, minlength=len(names)).tolist()):
                    seen[t] += n
                hashed = np.array([hash_pair(t.encode()) for t in names], np.uint64)
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                ends = np.append(begin[1:], len(row))
                sizes = np.add.reduceat(count, begin)
                n_docs, n_terms = n_docs + len(begin), n_terms + int(sizes.sum())
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist()
                for a, b, size in zip(begin.tolist(), ends.tolist(), sizes.tolist()):
                    at, doc_id = int(row[a]), ids[int(row[a])]
                    wanted = count[a:b]
                    n_keys = sum(int((wanted >= least).sum()) for least in LEVELS)
                    if n_keys > MOST_KEYS:
                        yield _emit([{"kind": UNSIGNED, "ids": [[doc_id]], "keys": [keys[at]], "sizes": [size]}])
                        continue
                    kind = (n_keys - 1).bit_length()
                    shard = shards.setdefault(kind, Shard(kind))
                    column = shard.columns.get((keys[at], size))
                    if column is not None:  # a copy: only the smallest ids can rank
                        held = shard.ids[column]
                        held.append(doc_id)
                        held.sort(key=lambda i: (i is None, i))
                        del held[top:]
                        continue
                    shard.columns[keys[at], size] = len(shard.ids)
                    shard.ids.append([doc_id])
                    pair = hashed[term[a:b]]
                    shard.rows.append(np.concatenate([
                        positions(pair[some, 0], pair[some, 1], level, shard.width).ravel()
                        for level, least in enumerate(LEVELS) if (some := wanted >= least).any()]).astype(np.int32))
                    if len(shard.ids) == shard.most:
                        yield _emit([shard.block()])
                if len(seen) > TERM_ROWS:
                    yield from flush_terms()
        for shard in shards.values():
            if shard.ids:
                yield _emit([shard.block()])
        yield from flush_terms()
        if n_docs:
            yield _emit([{"kind": TOTALS, "n": n_docs, "width": n_terms}])

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("tk"))
    return stage(rows.mapInArrow(run, INDEX_SCHEMA), "signatures")


class Query:
    """A block of items: (item number, term, times) and the weights of the terms."""

    def __init__(self, items: list[list[tuple[str, int]]], weights: dict[str, int], n_docs: int, n_terms: int):
        self.n_items, self.n_docs, self.n_terms = len(items), n_docs, n_terms
        names = sorted({t for item in items for t, _ in item if t in weights})
        number = {t: i for i, t in enumerate(names)}
        self.weights = np.array([weights[t] for t in names], np.int64)
        self.hashed = np.array([hash_pair(t.encode()) for t in names], np.uint64).reshape(-1, 2)
        pairs = [(i, number[t], times) for i, item in enumerate(items) for t, times in item if t in number]
        self.item, self.term, self.times = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        self.by_item = [[(t.encode(), weights[t] * times) for t, times in item if t in number] for item in items]

    def norm(self, size: int) -> int:
        """m of a document of ``size`` terms."""
        return 25 + 75 * size * self.n_docs // self.n_terms

    def bounds(self, width: int, n: int, sizes: list[int], data: bytes) -> np.ndarray:
        """Upper bounds of the scores, (items, documents of the block)."""
        slices_ = np.frombuffer(data, np.uint8).reshape(width, -1)
        level = np.zeros((len(self.weights), n), np.int8)
        live = np.arange(len(self.weights))
        held = None
        for k in range(len(LEVELS)):
            if not len(live):
                break
            rows = positions(self.hashed[live, 0], self.hashed[live, 1], k, width)
            bitmap = np.bitwise_and.reduce(slices_[rows], axis=1)
            held = bitmap if held is None else held & bitmap
            some = held.any(axis=1)
            live, held = live[some], held[some]
            level[live] += np.unpackbits(held, axis=1, count=n).view(np.int8)
        most = [0, *[least - 1 for least in LEVELS[1:]]]  # the greatest count of each level but the last
        part = np.zeros((len(LEVELS) + 1, n), np.int64)
        for d, size in enumerate(sizes):
            m = self.norm(size)
            for k in range(1, len(LEVELS) + 1):
                tf = min(most[k] if k < len(LEVELS) else size, size)
                part[k, d] = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        used = np.flatnonzero(level.any(axis=1))
        worth = part[level[used], np.arange(n)] * self.weights[used, None]
        place = np.full(len(self.weights), -1)
        place[used] = np.arange(len(used))
        mine = place[self.term] >= 0
        out = np.zeros((self.n_items, n), np.int64)
        if mine.any():
            item = self.item[mine]  # items lie together
            begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            out[item[begin]] = np.add.reduceat(worth[place[self.term[mine]]] * self.times[mine, None], begin, axis=0)
        return out

    def exact(self, text: bytes, items: list[int]) -> list[int]:
        terms = terms_of(text)
        m8 = 8 * self.norm(len(terms))
        tf = Counter(terms)
        return [sum(w * (1_000_000_000 * n // (1000 * n + m8)) for t, w in self.by_item[i] if (n := tf.get(t)))
                for i in items]


CANDIDATES = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("item", pa.int64()), ("bound", pa.int64())])


def _candidate_rows(ids: list, keys: list, item: np.ndarray, column: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    many = np.array([len(ids[c]) for c in column], np.int64)
    flat = [i for c in column for i in ids[c]]
    return pa.RecordBatch.from_arrays([
        pa.array(flat, pa.int64()), pa.array(np.repeat(np.array(keys, np.int64)[column], many)),
        pa.array(np.repeat(item, many)), pa.array(np.repeat(bound, many))], schema=CANDIDATES)


def seeds(indexed: DataFrame, query: Query, count: int) -> DataFrame:
    """(doc_id, tk, item, bound): the documents of highest bound of every item."""

    def run(batches):
        best = np.zeros((query.n_items, 0), np.int64)
        where: list[list[tuple]] = [[] for _ in range(query.n_items)]
        for batch in batches:
            for row in batch.to_pylist():
                bound = query.bounds(row["width"], row["m_docs"], row["sizes"], row["data"])
                floor = best[:, -1] if best.shape[1] == count else np.zeros(query.n_items, np.int64)
                for i in np.flatnonzero((bound > floor[:, None]).any(axis=1)):
                    found = np.flatnonzero(bound[i] > floor[i])
                    found = found[np.argsort(-bound[i, found], kind="stable")[:count]]
                    where[i] = sorted([*where[i], *[(-int(bound[i, c]), row["ids"][c][0] if row["ids"][c][0] is not None
                                                     else -1, row["keys"][c]) for c in found]])[:count]
                best = np.array([[*(-w[0] for w in where[i]), *[0] * (count - len(where[i]))]
                                 for i in range(query.n_items)], np.int64).reshape(query.n_items, count)
        for i, held in enumerate(where):
            if held:
                yield pa.RecordBatch.from_arrays([
                    pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int64()),
                    pa.array([i] * len(held), pa.int64()), pa.array([-h[0] for h in held], pa.int64())],
                    schema=CANDIDATES)

    found = indexed.where(F.col("kind") == BLOCK).select("width", "m_docs", "ids", "keys", "sizes", "data").mapInArrow(
        run, "doc_id long, tk long, item long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "tk")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def not_excluded(indexed: DataFrame, query: Query, floors: np.ndarray) -> DataFrame:
    """(doc_id, tk, item) of every pair whose bound reaches the item's floor."""
    least = np.maximum(floors, 1)[:, None]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["data"] is None:  # no signature: nothing is excluded
                    items = np.arange(query.n_items)
                    yield _candidate_rows(row["ids"], row["keys"], items, np.zeros_like(items), items)
                    continue
                bound = query.bounds(row["width"], row["m_docs"], row["sizes"], row["data"])
                item, column = np.nonzero(bound >= least)
                if len(item):
                    yield _candidate_rows(row["ids"], row["keys"], item, column, bound[item, column])

    return indexed.where(F.col("kind") >= BLOCK).select("width", "m_docs", "ids", "keys", "sizes", "data").mapInArrow(
        run, "doc_id long, tk long, item long, bound long").select("doc_id", "tk", "item")


def rescored(docs: DataFrame, wanted: DataFrame, query: Query) -> DataFrame:
    """(doc_id, item, score) of the wanted (doc_id, tk, item), from the texts, one row per row of ``docs``."""
    per_doc = stage(wanted.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("item")).alias("items")), "candidates")
    held = per_doc.agg(F.count("*").alias("rows"), F.sum(F.size("items")).alias("pairs")).first()
    small = 64 * held["rows"] + 8 * (held["pairs"] or 0) <= BROADCAST_BYTES
    side = (F.broadcast(per_doc) if small else per_doc).alias("c")
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("tk")).alias("d").join(
        side, F.expr("d.doc_id <=> c.doc_id AND d.tk = c.tk")).select("d.doc_id", "d.text", "c.items")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, items, scores = [], [], []
                for doc_id, text, asked in zip(part.column("doc_id").to_pylist(), part.column("text").cast(
                        pa.binary()).to_pylist(), part.column("items").to_pylist()):
                    ids += [doc_id] * len(asked)
                    items += asked
                    scores += query.exact(text or b"", asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(scores, pa.int64())],
                    names=["doc_id", "item", "score"])

    return texts.mapInArrow(run, "doc_id long, item long, score long").where("score > 0")


def item_blocks(items: DataFrame, most_terms: int = ITEM_TERMS) -> Iterator[list[tuple]]:
    """(item_id, [(term, times)]) of the distinct items with a term, in blocks of bounded size."""
    held, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy(
            "item_id", "text").toLocalIterator():
        counts = sorted((t.decode(), n) for t, n in Counter(terms_of(r["text"].encode())).items())
        if not counts:
            continue
        if held and size + len(counts) > most_terms:
            yield held
            held, size = [], 0
        held.append((r["item_id"], counts))
        size += len(counts)
    if held:
        yield held


def term_weights(counts: DataFrame, terms: set[str], n_docs: int) -> dict[str, int]:
    spark = counts.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    found = counts.join(asked, "term", "left_semi").collect()  # no more than the block's terms
    return {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}


def search(docs: DataFrame, items: DataFrame, top: int = TOP, seed_count: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    indexed = index(docs, top)
    totals = indexed.where(F.col("kind") == TOTALS).agg(F.sum("n").alias("n"), F.sum("width").alias("l")).first()
    if not totals["n"]:
        return spark.createDataFrame([], schema)
    counts = stage(indexed.where(F.col("kind") == TERM).groupBy("term").agg(F.sum("n").alias("df")), "term-counts")
    ranked = None
    for block in item_blocks(items):
        weights = term_weights(counts, {t for _, c in block for t, _ in c}, totals["n"])
        query = Query([c for _, c in block], weights, totals["n"], totals["l"])
        first = rescored(docs, seeds(indexed, query, max(seed_count, top)).select("doc_id", "tk", "item"), query)
        best = first.withColumn("place", F.row_number().over(
            Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == top)
        floors = np.zeros(len(block), np.int64)
        for r in best.select("item", "score").collect():  # one row per item of the block
            floors[r["item"]] = r["score"]
        scored = rescored(docs, not_excluded(indexed, query, floors), query)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(
            F.desc("score"), F.col("doc_id").asc_nulls_last()))
        names = F.broadcast(spark.createDataFrame(
            [(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long"))
        out = scored.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        ranked = out if ranked is None else stage(ranked.union(out), "ranked")
    return spark.createDataFrame([], schema) if ranked is None else ranked
