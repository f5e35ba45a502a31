"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: the majority bit of the XXH64 of the 3-word shingles.
It is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
binary Golay code (23, 12), shortened.  Decoding a segment and its one-bit
neighbours gives the indices of the nearby codewords; two segments one bit apart
share one: the odd one's own codeword is among the even one's.  Three errors fall
on three segments in one of these ways, each with its own kind of key:

* two segments are equal: both, exactly (three tables);
* one is equal and another is one bit off: the first exactly and a codeword
  index of the second (six tables);
* each is one bit off: a codeword index of every segment (one table).

So any two fingerprints within 3 bits meet under a key, and a rule on their
difference names the one table that reports them.  All candidates are verified
by the Hamming distance inside the join.  Equal fingerprints are one node; links
of nodes are contracted to components.

Defined cases: NULL and word-free texts have fingerprint 0 and link like any
other; repeated rows share a fingerprint and a component; a component of rows
without any doc_id has none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import map_slices, stage, text_key, texts_of
from trajecta.llm.components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and size of each
ERRORS = 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every message, and the error of weight <= 3 of every syndrome."""
    def remainder(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
        return word

    parity = remainder(np.arange(1 << 12, dtype=np.int64) << 11)
    ones = 1 << np.arange(23, dtype=np.int64)
    two = (ones[:, None] | ones).ravel()
    three = (two[:, None] | ones).ravel()
    patterns = np.unique(np.concatenate([[0], ones, two, three]))
    errors = np.zeros(1 << 11, np.int64)
    errors[remainder(patterns)] = patterns
    return parity, errors


PARITY, ERROR_OF = _tables()


def codeword(word: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (3 bits off at most)."""
    return (word ^ ERROR_OF[(word & 0x7FF) ^ PARITY[word >> 11]]) >> 11


def nearby(segment: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): codewords of each segment; of its one-bit neighbours too if its parity is even."""
    own = codeword(segment)
    even = np.flatnonzero(np.bitwise_count(segment) % 2 == 0)
    around = codeword(segment[even, None] ^ (1 << np.arange(size, dtype=np.int64)))
    found = np.concatenate([(np.arange(len(segment)) << 12) | own,
                            ((even[:, None] << 12) | around).ravel()])
    found = np.unique(found)
    return found >> 12, found & 0xFFF


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of each fingerprint; rows of side 0 meet rows of side 1 under a key.

    Keys of table t start with t.  Tables 0-2 leave out segment t; table
    3 + 2 s + k takes segment s exactly and the k-th other by codeword; table 9
    takes all by codeword.
    """
    x = prints.astype(np.uint64)
    parts = [((x >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    near = [nearby(p, size) for p, (_, size) in zip(parts, SEGMENTS)]
    rows, keys, sides = [], [], []

    def add(table: int, row: np.ndarray, key: np.ndarray, side: np.ndarray) -> None:
        rows.append(row)
        keys.append((np.int64(table) << 48) | key)
        sides.append(side)

    everyone = np.arange(len(x))
    for s in range(3):
        a, b = [p for k, p in enumerate(parts) if k != s]
        for side in (0, 1):
            add(s, everyone, (a << 22) | b, np.full(len(x), side))
        for k, other in enumerate([o for o in range(3) if o != s]):
            row, index = near[other]
            add(3 + 2 * s + k, row, (parts[s][row] << 12) | index, odd[other][row])
    # every segment by codeword: all pairs of keys of the three segments of a row
    row, key = near[0]
    for row_b, index in near[1:]:
        begin = np.searchsorted(row_b, np.arange(len(x) + 1))
        many = np.diff(begin)[row]
        at = np.repeat(begin[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, key = np.repeat(row, many), (np.repeat(key, many) << 12) | index[at]
    flip = odd[0][row]  # both sides name the parities of the side whose first segment is even
    add(9, row, (key << 2) | ((odd[1][row] ^ flip) << 1) | (odd[2][row] ^ flip), flip)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def fingerprint_of(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    counts, total = np.zeros(64, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed=42) for s in shingles), ">u8")
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, fp) of every row: id, a key of the text, and the fingerprint as a signed long."""
    def run(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint_of(t) for t in texts_of(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "tk": batch.column("tk"), "fp": prints.view(np.int64)}

    return map_slices(docs.select("doc_id", "text", text_key(F.col("text")).alias("tk")), run,
                      {"doc_id": pa.int64(), "tk": pa.int64(), "fp": pa.int64()})


def reporting_table(a: Column, b: Column) -> Column:
    """The table that reports a pair: the first that its difference qualifies for."""
    off = [F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), low).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
           for low, size in SEGMENTS]
    rule = None
    for s in range(3):
        i, j = [k for k in range(3) if k != s]
        ok = (off[i] == 0) & (off[j] == 0)
        rule = F.when(ok, s) if rule is None else rule.when(ok, s)
    for s in range(3):
        for k, other in enumerate([o for o in range(3) if o != s]):
            rule = rule.when((off[s] == 0) & (off[other] == 1), 3 + 2 * s + k)
    return rule.otherwise(9)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``ERRORS`` bits, each once."""
    def run(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key, side = fuzzy_keys(prints)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(side), pa.array(prints[row])], names=["key", "side", "fp"])

    keyed = stage(nodes.select("fp").mapInArrow(run, "key long, side long, fp long"), "keys")
    left = keyed.where("side = 0").select("key", F.col("fp").alias("a"))
    right = keyed.where("side = 1").select("key", F.col("fp").alias("b"))
    a, b, number = F.col("a"), F.col("b"), F.shiftright("key", 48)
    met = left.join(right.withColumnRenamed("key", "key_b"), (
        F.col("key") == F.col("key_b")) & (F.bit_count(a.bitwiseXOR(b)) <= ERRORS)
        & ((number > 2) | (a < b)) & (reporting_table(a, b) == number))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tk, fp, root, component_id of every row of ``docs``; root is the component's
    smallest fingerprint, which names it also where no row has an id."""
    prints = stage(fingerprints(docs), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select(F.col("fp").alias("node"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["node"]).select("doc_id", "tk", "fp", "root", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: that of smallest (doc_id, text key), NULL ids last.

    The texts are not dealt out again but for rows that repeat the chosen id and text.
    """
    rows = stage(near_duplicates(docs).groupBy("root", "doc_id", "tk").agg(F.count("*").alias("copies")), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")
    chosen = rows.groupBy("root").agg(F.min(order).alias("first"))
    marked = rows.join(chosen, "root").select(
        "doc_id", "tk", "copies", order.eqNullSafe(F.col("first")).alias("stays"))
    tk = text_key(docs["text"])

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("_key_id"), F.col("tk").alias("_key_text"))
        return df.join(k, df["doc_id"].eqNullSafe(k["_key_id"]) & (tk == k["_key_text"]), how)

    kept = among(docs, marked.where("NOT stays"), "left_anti")
    repeated = marked.where("stays AND copies > 1")
    names = [f"`{c}`" for c in docs.columns]
    once = among(kept, repeated, "left_semi").select("doc_id", tk.alias("_tk"), F.struct(*names).alias("_row")).groupBy(
        "doc_id", "_tk").agg(F.first("_row").alias("_row")).select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return among(kept, repeated, "left_anti").select(*names).union(once)
