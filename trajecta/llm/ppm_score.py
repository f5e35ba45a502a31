"""Language-model scoring by prediction by partial matching, and a unigram base.

The model is a byte-context trie of order ``ORDER`` counted over all training
documents.  A symbol is predicted in the longest context the trie holds; a
context with T occurrences and D different symbols gives a seen symbol
count / (T + D) and the escape D / (T + D); after an escape the next shorter
context predicts with the symbols already ruled out excluded, and the empty
context escapes to all bytes it has not seen.  A document is its UTF-8 bytes and
one end symbol (the byte 0xFF, which no text has), after as many start symbols.

How it runs: every map task counts words and byte (ORDER + 1)-grams of its
training texts; Spark sums them to one count table (shuffled, growing with the
corpus).  Shorter contexts are marginal sums.  The broadcast trie is a fast path:
it has every context up to order ``WHOLE`` and the longer ones that hold
1/``FAST_CONTEXTS`` of all symbols or more, so its size is bounded whatever the
corpus; a longer context always occurs less often than its suffixes, so suffixes
of its contexts are there too.  A symbol behind any other context is looked up in
the whole count table: every task sums up its distinct grams and sends them, and
the counts, to the part that owns the last ``WHOLE + 1`` bytes of the context.
There all longer contexts with that ending are complete, so the escape chain is
exact and no context is lost.  An ending with many questions is split: its
questions are dealt over shares and its counts, which the alphabet bounds, copied
to each.  Only a caller that gives ``contexts`` gets the
smaller model of the contexts that hold that share of all symbols.

The base score needs the count of every word.  Words that are 1/``WORDS`` of all
tokens or more (at most ``WORDS``) are broadcast; the rest are joined by shuffle.

Defined cases: NULL and empty texts are the end symbol alone; NULL ids train;
repeated rows count and score as often as they occur; without training rows
every symbol has the probability 1/256 and every token count 0.  Other columns
are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import fold, slices, stage, texts_of

ORDER = 5
FAST_CONTEXTS = 1 << 18
WHOLE = 2
WORDS = 1 << 20
END = 0xFF
WORD, GRAM = 0, 1
FLUSH_WORDS = 600_000
FLUSH_GRAMS = 500_000
PART_BYTES = 1 << 20  # of text at a time: eight-byte grams of it are held several times
RUN_BITS = 10
SHARES = 16  # buckets of endings for each part
PIECES = 4  # a bucket holds this part of a task's mean questions at most, or is split
HELD_SUMS = 1 << 20  # rows whose sums a task holds before it sends them


def stream_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one run of bytes with ``order`` end bytes around each; the
    place of every symbol to predict, and the number of symbols of each text."""
    pad = bytes([END]) * order
    data = np.frombuffer(pad + b"".join(itertools.chain.from_iterable((t, pad) for t in texts)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = order + np.cumsum(sizes + order - 1) - (sizes + order - 1)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return data, at, sizes


def grams_at(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The symbol at each place behind its ``order`` predecessors, packed."""
    packed = data[:len(data) - order].astype(np.uint64)
    for k in range(1, order + 1):
        packed <<= np.uint64(8)
        packed |= data[k:len(data) - order + k]
    return packed[at - order]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (key, count) for each key, in order."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, word, gram, n): counts of words, of text ends (the empty word) and of packed grams."""
    def run(batches):
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if words:
                n = pa.array(list(words.values()), pa.int64())
                yield WORD, pa.array(list(words), pa.binary()), pa.nulls(len(n), pa.int64()), n
            if grams:
                keys, n = summed(grams)
                yield GRAM, pa.nulls(len(n), pa.binary()), pa.array(keys.view(np.int64)), pa.array(n)
            words.clear()
            grams.clear()

        def frames():
            for kind, word, gram, n in flush():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), kind, np.int32)), word, gram, n], names=["kind", "word", "gram", "n"])

        for batch in batches:
            for part in slices(batch, PART_BYTES):
                texts = texts_of(part)
                words[b""] += len(texts)
                for t in texts:
                    words.update(t.lower().split())
                data, at, _ = stream_of(texts, order)
                found = pc.value_counts(pa.array(grams_at(data, at, order)))
                grams.append((found.field(0).to_numpy(), found.field(1).to_numpy()))
                if len(grams) >= 4:
                    grams[:] = [summed(grams)]
                if len(words) > FLUSH_WORDS:
                    yield from frames()
        yield from frames()

    parts = docs.select("text").mapInArrow(run, "kind int, word binary, gram long, n long")
    return parts.groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one order: sorted keys with T, D and the same of the next shorter
    context after exclusion; grams (context, symbol): sorted keys with counts."""
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    total_left: np.ndarray
    distinct_left: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


@dataclass
class Trie:
    levels: list[Level]
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    whole_model: bool = True  # or the count table has more contexts

    @property
    def order(self) -> int:
        return len(self.levels) - 1


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def add_levels(levels: list[Level], tables: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """``levels`` and those of the next orders, from (gram, count) sorted by gram."""
    levels = list(levels)
    for j, (grams, counts) in enumerate(tables, len(levels)):
        contexts, begin = np.unique(grams >> np.uint64(8), return_index=True)
        owner = np.repeat(np.arange(len(contexts)), np.diff(np.append(begin, len(grams))))
        total = np.bincount(owner, counts, minlength=len(contexts)).astype(np.float64)
        distinct = np.bincount(owner, minlength=len(contexts)).astype(np.float64)
        total_left = distinct_left = np.zeros(len(contexts))
        if j:
            above = levels[-1]
            shorter = np.uint64((1 << 8 * j) - 1)
            at, _ = find(above.grams, grams & shorter)
            parent, _ = find(above.contexts, contexts & (shorter >> np.uint64(8)))
            total_left = above.total[parent] - np.bincount(owner, above.counts[at], minlength=len(contexts))
            distinct_left = above.distinct[parent] - distinct
        levels.append(Level(contexts, total, distinct, total_left, distinct_left, grams, counts.astype(np.float64)))
    return levels


def build_trie(tables: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """From (gram, count) of every order, sorted by gram, of the kept contexts."""
    trie = Trie(add_levels([], tables))
    top = trie.levels[-1]
    owner, _ = find(top.contexts, top.grams >> np.uint64(8))
    direct = np.log10(top.counts / (top.total + top.distinct)[owner])
    # an open-addressed table of the longest grams, a quarter full at most
    bits = max(4, int(len(top.grams) * 4 - 1).bit_length())
    trie.slots, trie.values = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.float32)
    rest, step = np.arange(len(top.grams)), 0
    while len(rest):
        slot = slot_of(top.grams[rest], bits, step)
        free = np.flatnonzero(trie.slots[slot] == EMPTY)
        _, one = np.unique(slot[free], return_index=True)
        won = free[one]
        trie.slots[slot[won]], trie.values[slot[won]] = top.grams[rest[won]], direct[rest[won]]
        rest, step = np.delete(rest, won), step + 1
    return trie


def slot_of(keys: np.ndarray, bits: int, step: int) -> np.ndarray:
    return ((((keys * MIX) >> np.uint64(64 - bits)) + np.uint64(step)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def chain_logs(trie: Trie, grams: np.ndarray) -> np.ndarray:
    """log10 probability of each packed gram's last symbol, by the whole escape chain."""
    n = len(grams)
    logs = np.zeros(n)
    todo = np.arange(n)
    entered = np.zeros(n, bool)
    total, distinct = np.zeros(n), np.zeros(n)  # of the context at hand, after exclusion
    for j in range(trie.order, -1, -1):
        level = trie.levels[j]
        gram = grams[todo] & np.uint64((1 << 8 * (j + 1)) - 1)
        at, held = find(level.contexts, gram >> np.uint64(8))
        place, seen = find(level.grams, gram)
        start = held & ~entered[todo]
        total[todo[start]], distinct[todo[start]] = level.total[at[start]], level.distinct[at[start]]
        entered[todo[start]] = True
        seen &= held
        hit, miss = todo[seen], todo[held & ~seen]
        logs[hit] += np.log10(level.counts[place[seen]] / (total[hit] + distinct[hit]))
        room = total[miss] + distinct[miss]  # nothing left to predict: the escape is certain
        logs[miss] += np.log10(np.where(room > 0, distinct[miss] / np.where(room > 0, room, 1.0), 1.0))
        where = at[held & ~seen]
        total[miss], distinct[miss] = level.total_left[where], level.distinct_left[where]
        todo = todo[~seen]
    used = trie.levels[0].distinct[0] if len(trie.levels[0].distinct) else 0.0
    logs[todo] -= math.log10(max(256.0 - used, 1.0))
    return logs


def code_lengths(trie: Trie, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of every text; the grams behind contexts that the trie
    lacks, which are left out of it, and the text of each."""
    data, at, sizes = stream_of(texts, trie.order)
    grams = grams_at(data, at, trie.order)
    bits = len(trie.slots).bit_length() - 1
    logs = np.empty(len(grams))
    rest, step = None, 0
    while rest is None or len(rest):  # probe until the gram or an empty slot is met
        keys = grams if rest is None else grams[rest]
        slot = slot_of(keys, bits, step)
        met = trie.slots[slot]
        same, free = met == keys, met == EMPTY
        if rest is None:
            logs[:] = trie.values[slot]
            unknown, rest = [np.flatnonzero(free)], np.flatnonzero(~(same | free))
        else:
            logs[rest[same]] = trie.values[slot[same]]
            unknown.append(rest[free])
            rest = rest[~(same | free)]
        step += 1
    missed = np.concatenate(unknown)
    distinct, where = np.unique(grams[missed], return_inverse=True)
    _, held = find(trie.levels[-1].contexts, distinct >> np.uint64(8))
    chained = np.zeros(len(distinct))
    if trie.whole_model:
        held[:] = True
    chained[held] = chain_logs(trie, distinct[held])
    logs[missed] = chained[where]
    left = missed[~held[where]]
    owners = np.searchsorted(np.cumsum(sizes), left, side="right")
    sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
    return sums, owners, grams[left]


def train_trie(longest: DataFrame, order: int = ORDER, contexts: int | None = None) -> Trie:
    """The contexts of every order, collected as (gram, count): those of the model
    that ``contexts`` limits, else those of the fast path."""
    symbols = longest.agg(F.sum("n")).first()[0] or 0
    tables = []
    for j in range(order + 1):
        mask = F.lit((1 << 8 * (j + 1)) - 1).cast("long")
        kept = longest
        if contexts or j > WHOLE:
            context = F.shiftright(F.col("gram").bitwiseAND(mask), 8)
            most = contexts or FAST_CONTEXTS  # contexts that hold that share of all symbols: no more than so many
            total = longest.groupBy(context.alias("context")).agg(F.sum("n").alias("t")).where(
                F.col("t") * most >= symbols).select("context")
            kept = kept.join(F.broadcast(total) if most <= FAST_CONTEXTS else total,
                             context == F.col("context"), "left_semi")
        kept = kept.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n"))
        kept = kept.select("gram", "n").toArrow()
        grams = kept.column("gram").to_numpy().astype(np.uint64)
        by_gram = np.argsort(grams)
        tables.append((grams[by_gram], kept.column("n").to_numpy()[by_gram]))
    trie = build_trie(tables)
    trie.whole_model = bool(contexts) or order <= WHOLE
    return trie


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the last ``WHOLE + 1`` bytes of the context."""
    ending = (grams >> np.uint64(8)) & np.uint64((1 << 8 * (WHOLE + 1)) - 1)
    return (((ending * MIX) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)


def narrow(grams: np.ndarray) -> bytes:
    """Without the two highest bytes, which grams of order 5 leave empty."""
    if len(grams) and int(grams.max()) >> 48:
        raise ValueError("grams of more than six bytes")
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def wide(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def dealt(grams: np.ndarray, with_each: np.ndarray, buckets: int):
    """(bucket, its grams in order, ``with_each`` of them), bucket by bucket."""
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(bucket_of(grams[order], buckets), kind="stable")]
    grams, with_each = grams[order], with_each[order]
    bucket = bucket_of(grams, buckets)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(grams)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield int(bucket[a]), grams[a:b], with_each[a:b]


def packed_counts(longest: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind 0, row, grams, times, rows) of the count table; times are the counts."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            parts = list(dealt(*(np.concatenate(c) for c in zip(*held)), buckets)) if held else []
            held.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int32()), pa.array([0] * len(parts), pa.int32()),
                 pa.array([0] * len(parts), pa.int64()), pa.array([narrow(p[1]) for p in parts], pa.binary()),
                 pa.array([p[2].tobytes() for p in parts], pa.binary()), pa.nulls(len(parts), pa.binary())],
                names=["bucket", "kind", "row", "grams", "times", "rows"])

        for batch in batches:
            held.append((batch.column("gram").to_numpy().astype(np.uint64), batch.column("n").to_numpy()))
            if sum(len(g) for g, _ in held) > FLUSH_GRAMS:
                yield from flush()
        yield from flush()

    return longest.select("gram", "n").mapInArrow(
        run, "bucket int, kind int, row long, grams binary, times binary, rows binary")


def split_buckets(asked: DataFrame, parts: int) -> DataFrame:
    """(bucket, shares) of the buckets with more questions than a ``PIECES``-th of a part's
    mean: fewer than ``PIECES * parts`` rows.  ``asked`` is (bucket, questions)."""
    piece = (asked.agg(F.sum("questions")).first()[0] or 0) / (PIECES * parts)
    return asked.groupBy("bucket").agg(F.sum("questions").alias("load")).where(F.col("load") > piece).select(
        "bucket", F.ceil(F.col("load") / F.lit(piece)).cast("int").alias("shares"))


def shared_out(packed: DataFrame, split: DataFrame) -> DataFrame:
    """``packed`` with a share: questions in one by hash, counts in all of their bucket."""
    shares = F.coalesce("shares", F.lit(1))
    one = F.pmod(F.xxhash64("row", "rows"), shares).cast("int")
    return packed.join(F.broadcast(split), "bucket", "left").withColumn("share", F.explode(
        F.when(F.col("kind") == 0, F.sequence(F.lit(0), shares - 1)).otherwise(F.array(one)))).drop("shares")


def looked_up(packed: DataFrame, low: list[Level], order: int, parts: int) -> DataFrame:
    """(row, logs): the exact chain of the grams of kind 1 by the counts of kind 0, one
    (bucket, share) after the other.  The sums of a part go back packed, by runs of rows,
    and are added up there."""
    shared = packed.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        trie = here = None

        def added():
            found, owner = np.unique(np.concatenate([r for r, _ in sums]), return_inverse=True)
            return found, np.bincount(owner, np.concatenate([x for _, x in sums]), minlength=len(found))

        def answer():
            grams, times, rows = (np.concatenate(c) for c in zip(*asked))
            asked.clear()
            distinct, where = np.unique(grams, return_inverse=True)
            found, owner = np.unique(rows, return_inverse=True)
            logs = np.repeat(chain_logs(trie, distinct)[where], times)
            sums.append((found, np.bincount(owner, logs, minlength=len(found))))
            if sum(len(r) for r, _ in sums) > HELD_SUMS:
                sums[:] = [added()]

        def send():
            found, total = added()
            sums.clear()
            begin = np.flatnonzero(np.diff(found >> RUN_BITS, prepend=-1))
            cuts = list(itertools.pairwise([*begin.tolist(), len(found)]))
            places = (found & ((1 << RUN_BITS) - 1)).astype(np.uint16)
            return pa.RecordBatch.from_arrays(
                [pa.array(found[begin] >> RUN_BITS), pa.array([places[a:b].tobytes() for a, b in cuts], pa.binary()),
                 pa.array([total[a:b].tobytes() for a, b in cuts], pa.binary())], names=["run", "places", "sums"])

        for batch in batches:
            kinds, blobs = batch.column("kind").to_numpy(), [batch.column(c) for c in ("grams", "times", "rows")]
            groups = zip(batch.column("bucket").to_pylist(), batch.column("share").to_pylist())
            for i, (kind, group) in enumerate(zip(kinds, groups)):
                if group != here:
                    if asked:
                        answer()
                    counted.clear()
                    trie, here = None, group
                grams = wide(blobs[0][i].as_buffer())
                times = np.frombuffer(blobs[1][i].as_buffer(), np.int64 if kind == 0 else np.uint32)
                if kind == 0:
                    counted.append((grams, times.copy()))
                    continue
                if trie is None:
                    keys, n = (np.concatenate(c) for c in zip(*counted)) if counted else (
                        np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    counted.clear()
                    tables = [summed([(keys & np.uint64((1 << 8 * (j + 1)) - 1), n)])
                              for j in range(WHOLE + 1, order + 1)]
                    trie = Trie(add_levels(shared.value, tables))
                asked.append((grams, times, np.frombuffer(blobs[2][i].as_buffer(), np.uint32)
                              + np.int64(batch.column("row")[i].as_py())))
                if sum(len(rows) for *_, rows in asked[-64:]) > FLUSH_GRAMS or len(asked) >= 512:
                    answer()
                if sums and len(sums[0][0]) > HELD_SUMS // 2:
                    yield send()
        if asked:
            answer()
        if sums:
            yield send()

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for which, places, sums in zip(*(batch.column(c) for c in ("run", "places", "sums"))):
                total = totals.setdefault(which.as_py(), np.full(1 << RUN_BITS, np.nan))
                at = np.frombuffer(places.as_buffer(), np.uint16)
                total[at] = np.nan_to_num(total[at]) + np.frombuffer(sums.as_buffer(), np.float64)
        for which, total in totals.items():
            at = np.flatnonzero(~np.isnan(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array((which << RUN_BITS) + at), pa.array(total[at])], names=["row", "logs"])

    return packed.repartition(parts, "bucket", "share").sortWithinPartitions("bucket", "share", "kind").mapInArrow(
        run, "run long, places binary, sums binary").repartition(parts, "run").mapInArrow(add, "row long, logs double")


def score(docs: DataFrame, folds: int = 5, held: int = 1, order: int = ORDER, contexts: int | None = None,
          words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    training = docs.where(fold(F.col("doc_id"), folds) != held)
    counts = stage(corpus_counts(training, order), "counts")
    known_words = counts.where(F.col("kind") == WORD).select(F.col("word").alias("key"), "n")
    longest = counts.where(F.col("kind") == GRAM).select("gram", "n")
    n_all, n_distinct = known_words.agg(F.sum("n"), F.count("*")).first()
    n_all = n_all or 0
    often = known_words.where(F.col("n") * words >= n_all).select("key", "n").toArrow()
    frequent = dict(zip((bytes(k) for k in often.column("key").to_pylist()), often.column("n").to_pylist()))
    trie = train_trie(longest, order, contexts)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(SHARES * parts, 1 << 16)
    shared = docs.sparkSession.sparkContext.broadcast((trie, frequent))

    names = ["row", "doc_id", "n_tokens", "known", "logs", "score", "rare", "bucket", "grams", "times", "rows",
             "questions"]

    def run(batches):
        trie, frequent = shared.value
        first = row = TaskContext.get().partitionId() << 40
        left: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            out = []
            for bucket, grams, rows in dealt(*(np.concatenate(c) for c in zip(*left)), buckets) if left else ():
                begin = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
                out.append((bucket, narrow(grams[begin]),
                            np.diff(np.append(begin, len(grams))).astype(np.uint32).tobytes(), rows.tobytes(),
                            len(rows)))
            left.clear()
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([first] * len(out), pa.int64()), *[pa.nulls(len(out), t) for t in (
                    pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))],
                 *[pa.array(c, t) for c, t in zip(
                     columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))]],
                names=names)

        for batch in batches:
            for part in slices(batch, PART_BYTES):
                texts = texts_of(part)
                split = [t.lower().split() for t in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                coded = pa.array(itertools.chain.from_iterable(split), pa.binary()).dictionary_encode()
                distinct = coded.dictionary
                n = np.fromiter((frequent.get(w, 0) for w in distinct.to_pylist()), np.int64, len(distinct))
                index = coded.indices.to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(texts)), sizes)
                per_token = n[index]
                rare = per_token == 0
                logs = np.where(rare, 0.0, np.log10(np.maximum(n, 1) + 0.5)[index])
                rare_sizes = np.bincount(owner[rare], minlength=len(texts))
                rare_words = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(rare_sizes)]), pa.int32()),
                    distinct.take(pa.array(index[rare])))
                ends = frequent.get(b"", 0)
                sums, owners, grams = code_lengths(trie, texts)
                if len(grams):
                    left.append((grams, (row - first + owners).astype(np.uint32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(texts))), part.column("doc_id").cast(pa.int64()),
                     pa.array(sizes + 1), pa.array(sizes - rare_sizes + (ends > 0)),
                     pa.array(np.bincount(owner, logs, minlength=len(texts)) + math.log10(ends + 0.5)),
                     pa.array(sums), rare_words, pa.nulls(len(texts), pa.int32()),
                     *[pa.nulls(len(texts), pa.binary())] * 3, pa.nulls(len(texts), pa.int64())], names=names)
                row += len(texts)
                if sum(len(g) for g, _ in left) > FLUSH_GRAMS:
                    yield from flush()
        yield from flush()

    made = stage(docs.select("doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n_tokens long, known long, logs double, score double, rare array<binary>, "
        "bucket int, grams binary, times binary, rows binary, questions long"), "scored")
    scored = made.where(F.col("bucket").isNull()).drop("bucket", "grams", "times", "rows", "questions")
    others = known_words.where(F.col("n") * words < n_all).select("key", "n")
    more = scored.select("row", F.explode("rare").alias("word")).join(
        others, F.col("word") == F.col("key"), "left").select(
        "row", F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("known"),
        F.log10(F.coalesce("n", F.lit(0)) + 0.5).alias("base"), F.lit(0.0).alias("chain"))
    if not trie.whole_model:
        asked = made.where(F.col("bucket").isNotNull()).select(
            "bucket", F.lit(1).alias("kind"), "row", "grams", "times", "rows")
        split = split_buckets(made.where(F.col("bucket").isNotNull()).select("bucket", "questions"), parts)
        packed = shared_out(packed_counts(longest, buckets).union(asked), split)
        more = more.union(looked_up(packed, trie.levels[:WHOLE + 1], order, parts)
                          .select("row", F.lit(0), F.lit(0.0), "logs"))
    rare = more.groupBy("row").agg(
        F.sum("known").alias("rare_known"), F.sum("base").alias("rare_logs"), F.sum("chain").alias("chain_logs"))
    room = math.log10(n_all + 0.5 * (n_distinct + 1))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens",
        (F.col("known") + zero("rare_known", "long")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs", "double") - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (F.col("score") + zero("chain_logs", "double")).alias("score"))
