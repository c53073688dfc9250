"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

Counting lays hashed unigrams and bigrams into blocks, which are summed apart. A count c is stored as level
1 + floor(log2 c): the filter holds (n-gram, 1) ... (n-gram, level), so a count comes back as the number of probes
that succeed in a row. Each block owns a region of the filter, of a fixed number of bits for each entry: the filter
grows with what it holds and never lies in one place. n-grams of all rows go to their blocks, by slices of rows; a block
probes its region for them and sends the levels back to the slices, which are scored then.
Exact unigram counts (for the base score) come from a broadcast head of the most frequent words and, for the rest,
from a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, cut, mix, word_hashes

END = np.uint64(0x5EEDED0C5EEDED0C)
PROBES = 3


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and, after each text, of one end; offsets by row."""
    words, by_row = word_hashes(column)
    at = by_row[1:] + np.arange(len(by_row) - 1)
    out = np.empty(len(words) + len(at), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at] = True
    out[is_end], out[~is_end] = END, words
    return out, np.r_[0, at + 1]


def bigrams(t: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; the first token of a text follows an end."""
    before = np.empty_like(t)
    before[:1], before[1:] = END, t[:-1]
    return mix(before * PLACE[10] + t * PLACE[11])


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def bits(h: np.ndarray, level: int, order: int, blocks: int, region: int) -> list[np.ndarray]:
    """The filter's bits for n-grams of an order at one level."""
    x = mix(h ^ PLACE[20 + order]) + PLACE[level % 60]
    a, b = mix(x), mix(x ^ PLACE[30]) | np.uint64(1)
    base = block_of(h, blocks) * region
    return [base + ((a + np.uint64(i) * b) % np.uint64(region)).astype(np.int64) for i in range(PROBES)]


class Filter:
    def __init__(self, data: np.ndarray, blocks: int, region: int):
        self.data, self.blocks, self.region = data, blocks, region

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """Successful probes in a row of each n-gram."""
        out = np.zeros(len(h), np.int64)
        alive = np.arange(len(h))
        for level in range(1, 63):
            x = h[alive]
            ok = np.ones(len(x), bool)
            for at in bits(x, level, order, self.blocks, self.region):
                ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[ok]
            if not len(alive):
                break
            out[alive] = level
        return out


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for none."""
    low = np.exp2(np.maximum(level, 1) - 1.0)
    return np.where(level > 0, (3 * low - 1) / 2, 0.0)


def sliced(batches, size: int, rows: int = 4000):
    """(key, rows) of slices of at most `rows` rows and about size bytes of text (column 2); the same rows in the same order give the same keys."""
    key = TaskContext.get().partitionId() << 24
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))
            j = max(i + 1, min(j, i + rows))
            yield key, b.slice(i, j - i)
            key, i = key + 1, j


def dealt(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by block, and where each block begins in it."""
    block = block_of(h, blocks)
    o = np.argsort(block, kind="stable")
    return o, np.searchsorted(block[o], np.arange(blocks + 1))


def _keyed(size: int):
    def run(batches):
        for key, b in sliced(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, key)), *b.columns], names=["slice", *b.schema.names])

    return run


def _count(blocks: int, size: int):
    """Distinct n-grams of each slice by block and order, with their counts in training rows."""

    def run(batches):
        for key, b in sliced(batches, size):
            t, by_row = tokens(b.column(2))
            train = np.repeat(~b.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(by_row))
            rows = {"part": [], "slice": [], "grams": [], "counts": []}
            for order, h in ((1, t), (2, bigrams(t))):
                o = np.argsort(h)
                h = h[o]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                h, c = h[start], np.add.reduceat(train[o].astype(np.uint32), start, dtype=np.uint32)
                o, cuts = dealt(h, blocks)
                for j in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = o[cuts[j] : cuts[j + 1]]
                    rows["part"].append(j * 2 + order - 1)
                    rows["slice"].append(key)
                    rows["grams"].append(h[mine].tobytes())
                    rows["counts"].append(c[mine].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]))

    return run


def region_of(grams: np.ndarray, counts: np.ndarray, order: int, entry_bits: int) -> Filter:
    """A filter of one block, with entry_bits bits for each (n-gram, level)."""
    levels = np.log2(counts).astype(np.int64) + 1
    region = max(64, -(-int(levels.sum()) * entry_bits // 64) * 64)
    data = np.zeros(region // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in bits(grams[levels >= level], level, order, 1, region):
            np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return Filter(data, 1, region)


def _sum(least: int, entry_bits: int):
    """Sums a block's counts of one order: exact ones of unigrams, and the filter's levels of all n-grams for each slice."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = part % 2 + 1
        own = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        h, inverse = np.unique(np.concatenate(own), return_inverse=True)
        inverse = inverse.reshape(-1)
        c = np.bincount(inverse, c, len(h)).astype(np.int64)
        stored = c >= (1 if order == 1 else max(1, least))
        levels = region_of(h[stored], c[stored], order, entry_bits).levels(h, order).astype(np.uint8)[inverse]
        ends = np.cumsum([len(x) for x in own])
        levels = [levels[e - len(x) : e].tobytes() for x, e in zip(own, ends.tolist(), strict=True)]
        sums = np.array([np.bitwise_xor.reduce(x) for x in own], np.uint64).view(np.int64)
        seen = np.flatnonzero(c if order == 1 else [])
        n, m = len(own), len(seen)
        none = lambda k, t: pa.nulls(k, t)
        both = lambda a, b: pa.chunked_array([a, b])
        return pa.table({
            "slice": both(table.column("slice").combine_chunks(), none(m, pa.int64())), "part": both(pa.array([part] * n, pa.int64()), none(m, pa.int64())),
            "sum": both(pa.array(sums), none(m, pa.int64())), "levels": both(pa.array(levels, pa.binary()), none(m, pa.binary())),
            "gram": both(none(n, pa.int64()), pa.array(h[seen].view(np.int64))), "count": both(none(n, pa.int64()), pa.array(c[seen])),
        })

    return run


def _levels_of(h: np.ndarray, order: int, blocks: int, answers: dict) -> np.ndarray:
    """The levels that the blocks sent back for a slice's distinct n-grams, in ascending order."""
    out = np.zeros(len(h), np.int64)
    o, cuts = dealt(h, blocks)
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        mine = o[cuts[j] : cuts[j + 1]]
        check, levels = answers.get(j * 2 + order - 1, (None, b""))
        if len(levels) != len(mine) or check != int(np.bitwise_xor.reduce(h[mine]).view(np.int64)):
            raise RuntimeError("the rows came in another order when they were read again; write them to a table first")
        out[mine] = np.frombuffer(levels, np.uint8)
    return out


def _score(model, head, weight: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, n_tokens, n_types = model
        grams, counts = head.value
        total = n_tokens + n_types + 1.0
        answers = {p: (s, x) for p, s, x in zip(*(right.column(n).to_pylist() for n in ("part", "sum", "levels")), strict=True)}
        t, _ = tokens(left.column("text"))
        known = [(h := np.unique(x), count_of(_levels_of(h, order, blocks, answers))) for order, x in ((1, t), (2, bigrams(t)))]
        first = left.column("slice")[0].as_py() << 12
        out = []
        for i in range(0, left.num_rows, 1000):
            b = left.slice(i, 1000)
            t, by_row = tokens(b.column("text"))
            rows = np.repeat(np.arange(b.num_rows), np.diff(by_row))
            types, inverse = np.unique(t, return_inverse=True)
            inverse = inverse.reshape(-1)
            at = np.searchsorted(known[0][0], types)
            one = known[0][1][at][inverse]
            before = np.empty_like(one)
            before[1:] = one[:-1]
            before[:1] = known[0][1][np.searchsorted(known[0][0], END)]
            two = np.minimum(known[1][1][np.searchsorted(known[1][0], bigrams(t))], before)
            p = (one + 1) / total
            p = np.where(before > 0, (1 - weight) * p + weight * two / np.maximum(before, 1), p)
            score = np.bincount(rows, np.log10(np.minimum(p, 1.0)), b.num_rows)
            at = np.minimum(np.searchsorted(grams, types), max(0, len(grams) - 1))
            in_head = grams[at] == types if len(grams) else np.zeros(len(types), bool)
            exact = np.where(in_head, counts[at] if len(grams) else 0, 0)
            base = np.bincount(rows, np.where(in_head, np.log10((exact + 1) / total), 0.0)[inverse], b.num_rows)
            n_known = np.bincount(rows, in_head[inverse], b.num_rows).astype(np.int64)
            tail = ~in_head[inverse]
            ends = np.r_[0, np.cumsum(np.bincount(rows[tail], minlength=b.num_rows))]
            key = first + i + np.arange(b.num_rows, dtype=np.int64)
            out.append(pa.table({
                "key": key, "id": b.column("id"), "held_out": b.column("held_out"), "n_tokens": np.diff(by_row).astype(np.int64), "known": n_known, "base": base, "score": score,
                "tail": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t[tail].view(np.int64))),
            }))
        return pa.concat_tables(out)

    return run


def bloom_lm_score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", least: int = 1, weight: float = 0.6, entry_bits: int = 16, head: int = 1 << 20, block_bytes: int = 8 << 20, slice_bytes: int = 12 << 20) -> DataFrame:
    """Scores whole texts by a bigram model of the rows that the condition held_out doesn't pick.

    Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end; null texts are empty. Smoothing: the bigram's
    share of its first word, by the filter's counts, mixed (weight) with (count + 1) / (N + V + 1). All bigrams
    are stored; with least > 1, those seen fewer times aren't. Returns id, held_out, n_tokens, n_known, train_tokens (N), base_score (log10 of
    the add-one unigram probability, exact counts) and score (log10, the model's), a row for each row. Without training
    rows N = V = 0. The filter takes entry_bits for each n-gram and level (16: 0.5 % false probes), whatever their number; it
    is probed block by block. head bounds the broadcast exact counts, beyond which words are joined. docs is read twice
    and must give its rows in the same order (files do); else it raises. Rows may repeat ids or have none; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0)
    blocks = max(16, -(-size // block_bytes))
    counted = rows.mapInArrow(_count(blocks, slice_bytes), "part long, slice long, grams binary, counts binary")
    summed = cut(counted.groupBy("part").applyInArrow(_sum(least, entry_bits), "slice long, part long, sum long, levels binary, gram long, count long"), "counts")
    exact = summed.where("slice is null").select("gram", "count")
    n_tokens, n_types = (int(x or 0) for x in exact.agg(F.sum("count"), F.count("*")).first())
    held, floor = 0, 1
    if n_types > head:
        sizes = exact.select(F.floor(F.log2("count")).alias("octave")).groupBy("octave").count().orderBy(F.desc("octave")).collect()
        floor = 1 << 62
        for r in sizes:
            held += r["count"]
            if held > head:
                break
            floor = 1 << r["octave"]
    top = exact.where(F.col("count") >= floor).toArrow()
    grams, counts = (top.column(i).combine_chunks().to_numpy() if top.num_rows else np.zeros(0, np.int64) for i in range(2))
    grams = grams.view(np.uint64)
    order = np.argsort(grams)
    first = spark.sparkContext.broadcast((grams[order], counts[order]))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = rows.mapInArrow(_keyed(slice_bytes), f"slice long, id {kind}, held_out boolean, text string")
    answers = summed.where("slice is not null").select("slice", "part", "sum", "levels")
    scored = keyed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score((blocks, n_tokens, n_types), first, weight), f"key long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>")
    scored = cut(scored, "scored")
    rest = scored.select("key", F.explode("tail").alias("gram")).groupBy("key", "gram").count()
    rest = rest.join(exact.where(F.col("count") < floor).withColumnRenamed("count", "seen"), "gram", "left")
    total = float(n_tokens + n_types + 1)
    rest = rest.groupBy("key").agg(F.sum(F.col("count") * F.log10((F.coalesce("seen", F.lit(0)) + 1) / F.lit(total))).alias("more"), F.sum(F.when(F.col("seen") > 0, F.col("count")).otherwise(0)).alias("more_known"))
    out = scored.drop("tail").join(rest, "key", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
