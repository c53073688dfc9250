"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

1. One pass gives each document the size and a 128-bit signature of its n-gram set; equal sets are one class.
2. A second pass lays the columns that can matter into blocks by n-gram hash: sets are ordered rarest first (by a
   bounded table of frequent hashes) and only the first n - ceil(t n) + 1 are kept, as two sets with similarity t
   share one of those.
3. Each block multiplies its piece of the incidence by its transpose, counting overlaps of pairs; summed over blocks,
   a pair whose count can't reach ceil(t/(1+t) (n_a + n_b)) any more is discarded.
   Blocks know a class by KEY bits of its signature and its size.
4. Of the remaining pairs, counts of members by part of the hashes, more parts for larger sets, bound the overlap; whole
   sets of those still in reach are intersected exactly, first the most promising pair of each class, then pairs still
   in different components.
A column shared by over `wide` classes is first linked along its members sorted by size and to its first member, then
by a few pairs of each class that is still apart; columns of which some class has more pairs, and which this leaves in
different components, are multiplied in full after that, so no link between components is lost, and few pairs of a large group of near copies are ever made.

The first column that two linked sets share (in the order of 2.) has at least `least` - 1 more members behind it in
both. Of a wide column, only pairs for which it can be that first one are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PLACE, cut, forget, mix, release, tidy, word_hashes
from .components import components

#: Entries of the table of frequent hashes: 4 MB as broadcast, whatever the input.
TABLE = 1 << 22
#: Parts of the hashes by which members of a set are counted, to bound overlaps before whole sets move: for small and for very large sets.
PARTS, MOST_PARTS = 256, 1 << 14
#: Bits of a signature that blocks carry. Classes of one size that agree in them share their columns in a block, and what comes of it counts for both.
KEY = (1 << 48) - 1
#: Pairs that a class still apart first tries in a wide column, before all others.
TRIES = 8
#: Parts of a sketch, the same counts in short numbers, by which pairs of a wide column are bounded before they are made.
SKETCH, FULL = 128, 65535
#: Signatures that a task remembers, so as to describe equal sets once; then it forgets them. Sets that come twice do no harm.
SEEN = 100_000


def shingle_sets(column: pa.Array, k: int, rows: int = 500) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; with fewer words, of the whole sequence."""
    return [s for i in range(0, len(column), rows) for s in _some_sets(column[i : i + rows], k)]


def _some_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    words, by_row = word_hashes(column)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(by_row[:-1].tolist(), by_row[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mix((words[a:b] * PLACE[: b - a]).sum(keepdims=True) + PLACE[40 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def few(batches, rows: int = 2000):
    """The batches in pieces of so many rows, as sets and counts take several times the memory of their rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def light(run):
    """run, a function of a group's table, with the memory that its worker no longer needs given back."""

    def whole(table):
        try:
            return run(table)
        finally:
            release()

    return whole


def signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        both = mix(s ^ PLACE[50]).sum(), (mix(s + PLACE[51]) * PLACE[52]).sum()
    return tuple(int(x) for x in np.array(both, np.uint64).view(np.int64))


def _needed(num: int, den: int, n):
    """ceil(num n / den)"""
    return -((-num * n) // den)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte: all lowest bytes first, so that the zeros of small numbers lie together and pack well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def packed(cols: np.ndarray) -> bytes:
    """The lower 48 bits of hashes, which tell the columns of a block apart.

    Columns of different sets that fall together bring more pairs to check; two of one set of n do with a chance under n^2 / 2^49."""
    return cols.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def tally(s: np.ndarray) -> bytes:
    """How many members fall into each part of the hashes, 255 at most; a power of two of parts, so that two members share one on average or fewer."""
    parts = min(MOST_PARTS, max(PARTS, 1 << max(0, len(s) // 2 - 1).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % parts, minlength=parts), 255).astype(np.uint8).tobytes()


def overlaps(x: list[bytes], y: list[bytes], rows: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of tallies the largest overlap that they allow, by the fewer parts of both, and whether either has a count that was cut off."""
    sizes = np.array([(len(v), len(w)) for v, w in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    most, full = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for p, q in np.unique(sizes, axis=0).tolist():
        here, few = np.flatnonzero((sizes == (p, q)).all(1)), min(p, q)
        step = max(1, rows * PARTS // max(p, q))
        for i in range(0, len(here), step):
            at = here[i : i + step]
            v, w = (np.frombuffer(b"".join(z[j] for j in at.tolist()), np.uint8).reshape(len(at), -1) for z in (x, y))
            full[at] = (v == 255).any(1) | (w == 255).any(1)
            v, w = (z.reshape(len(at), -1, few).sum(1, dtype=np.int64) for z in (v, w))
            most[at] = np.minimum(v, w).sum(1)
    return most, full


def sketch(s: np.ndarray) -> bytes:
    n = np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return np.minimum(n, FULL).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unsketch(column) -> np.ndarray:
    return np.array([np.frombuffer(b, np.uint8).reshape(2, -1).T.copy().view("<u2").reshape(-1) for b in column], np.int32).reshape(-1, SKETCH)


def _describe(k: int):
    def run(batches):
        counts, seen = np.zeros(TABLE, np.uint32), set()
        total = 0
        for b in few(batches):
            sets = shingle_sets(b.column(1), k)
            signs = [signature(s) for s in sets]
            fresh = []
            for s, g in zip(sets, signs, strict=True):
                if g not in seen and len(s):
                    seen.add(g)
                    fresh.append(s)
            if len(seen) > SEEN:
                seen.clear()
            for i in range(0, len(fresh), 1000):
                slots, n = np.unique(np.concatenate(fresh[i : i + 1000]) & np.uint64(TABLE - 1), return_counts=True)
                counts[slots.astype(np.int64)] += n.astype(np.uint32)
                total += int(n.sum())
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([g[0] for g in signs], pa.int64()), pa.array([g[1] for g in signs], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["id", "n", "c1", "c2", "slot", "df", "sketch"]
            )
        mean = total / TABLE
        hot = np.flatnonzero(counts >= max(8, mean + 8 * mean**0.5))
        n = len(hot)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int64())] * 3, pa.array(hot, pa.int64()), pa.array(counts[hot].astype(np.int64)), pa.nulls(n, pa.binary())], names=["id", "n", "c1", "c2", "slot", "df", "sketch"])

    return run


def _blocks(k: int, num: int, den: int, blocks: int, frequent):
    """Incidence pieces: one row per block and batch, columns packed as little-endian arrays."""

    def run(batches):
        table, seen = frequent.value, set()
        for b in batches:
            cols, who, place, classes = [], [], [], []
            for s in (s for i in range(0, b.num_rows, 500) for s in _some_sets(b.column(1)[i : i + 500], k)):
                g = signature(s)
                n = len(s)
                if not n or g in seen:
                    continue
                seen.add(g)
                rare = table[(s & np.uint64(TABLE - 1)).astype(np.int64)]
                if rare.any():
                    s = s[np.argsort(rare, kind="stable")]
                p = n - _needed(num, den, n) + 1
                cols.append(s[:p].copy())
                who.append(np.full(p, len(classes), np.int32))
                place.append(np.arange(p, dtype=np.int32))
                classes.append((g[0] & KEY, n))
            if len(seen) > SEEN:
                seen.clear()
            if not classes:
                continue
            cols, who, place, classes = np.concatenate(cols), np.concatenate(who), np.concatenate(place), np.array(classes, np.int64)
            block = (cols >> np.uint64(32)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
            rows = {"block": [], **{c: [] for c in PIECE}}
            for j in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[j] : cuts[j + 1]]
                mine, many = np.unique(who[o], return_counts=True)  # entries of a class lie together
                for name, x in (("block", j), ("cols", packed(cols[o])), ("place", planes(place[o])), ("many", planes(many)), ("keys", packed(classes[mine, 0])), ("sizes", planes(classes[mine, 1]))):
                    rows[name].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in PIECE]]))

    return run


#: Of entries, class by class: columns and places; of classes: how many entries, keys and sizes.
PIECE = ("cols", "place", "many", "keys", "sizes")
BLOCK = "block long, " + ", ".join(f"{c} binary" for c in PIECE)
PRODUCT = "kind int, a long, na long, b long, nb long, shared long, col long, place long"


def _product(num: int, den: int, wide: int):
    """The block's piece of the incidence times its transpose.

    Kind 0: pairs and how many of the block's columns they share; 1: pairs next to each other in wide columns; 2: entries of wide columns.
    """

    def run(table: pa.Table) -> pa.Table:
        cols, who, place, classes, at = [], [], [], [], 0
        for r in table.to_pylist():
            c = np.column_stack([unpacked(r["keys"]).view(np.int64), unplanes(r["sizes"])])
            cols.append(unpacked(r["cols"]))
            who.append(np.repeat(np.arange(len(c)), unplanes(r["many"])) + at)
            place.append(unplanes(r["place"]))
            classes.append(c)
            at += len(c)
        cols, who, place, classes = (np.concatenate(x) for x in (cols, who, place, classes))
        classes, number = np.unique(classes, axis=0, return_inverse=True)
        who, size = number.reshape(-1)[who], classes[:, 1]
        order = np.lexsort((who, size[who], cols))
        cols, who, place = cols[order], who[order], place[order]
        keep = np.r_[True, (cols[1:] != cols[:-1]) | (who[1:] != who[:-1])] if len(cols) else np.zeros(0, bool)
        cols, who, place = cols[keep], who[keep], place[keep]
        start = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else np.zeros(0, np.int64)
        length = np.diff(np.r_[start, len(cols)])
        run_of = np.repeat(np.arange(len(start)), length)
        first, many = start[run_of], length[run_of]
        own = np.arange(len(cols))

        def pairs(x, y, first: bool):
            """Of entries x < y of one column, those whose sizes and places allow the overlap; with first, as the first column they share."""
            nx, ny, px, py = size[who[x]], size[who[y]], place[x], place[y]
            least = _needed(num, num + den, nx + ny)
            before = 0 if first else np.minimum(px, py)
            ok = (np.minimum(nx, ny) * den >= num * np.maximum(nx, ny)) & (before + np.minimum(nx - px, ny - py) >= least)
            return x[ok], y[ok]

        narrow, lists = [], []
        for d in range(1, min(wide, int(length.max(initial=0)))):
            x = own[(many <= wide) & (own + d < first + many)]
            if not len(x):
                break
            narrow.append(pairs(x, x + d, False))
        big = many > wide
        if big.any():
            x = own[big & (own + 1 < first + many)]
            lists.append(pairs(x, x + 1, True))
            y = own[big & (own > first)]
            lists.append(pairs(first[y], y, True))

        def distinct(found, kind):
            if not found:
                return
            a, b = (who[np.concatenate(z)] for z in zip(*found, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            key, shared = np.unique(a * len(classes) + b, return_counts=True)
            ca, cb = classes[key // len(classes)], classes[key % len(classes)]
            n = len(key)
            parts.append([np.full(n, kind), ca[:, 0], ca[:, 1], cb[:, 0], cb[:, 1], shared, np.zeros(n), np.zeros(n)])

        parts: list = []
        distinct(narrow, 0)
        distinct(lists, 1)
        if big.any():
            c, z = classes[who[big]], np.zeros(int(big.sum()))
            parts.append([z + 2, c[:, 0], c[:, 1], z, z, z, cols[big].view(np.int64), place[big]])
        parts = parts or [[np.zeros(0)] * 8]
        names = [x.split()[0] for x in PRODUCT.split(", ")]
        return pa.table({n: pa.array(np.concatenate([p[i].astype(np.int64) for p in parts]), pa.int32() if n == "kind" else pa.int64()) for i, n in enumerate(names)})

    return run


def _across(num: int, den: int, tries: int | None = None):
    """Pairs of one wide column whose classes are still in different components.

    Pairs that share a narrow column were judged before; the others overlap at most in wide columns, of which the first
    they share is this one or is multiplied elsewhere, and beyond the kept columns. `wide` counts the wide columns that
    a class has from this one on. Counts by part of the hashes bound an overlap by the sum of the smaller ones, as long
    as none is FULL. With tries, only so many pairs of a class, those with the largest bounds, and a row with the column
    if that left any out."""

    def run(table: pa.Table) -> pa.Table:
        t = table.to_pandas().sort_values(["col", "na"], kind="stable")
        found, unended = [], []
        for col, g in t.groupby("col", sort=False):
            comp = pd.factorize(g["label"])[0]
            if comp.max(initial=0) == 0:
                continue
            n, place, wide, ids = g["na"].to_numpy(), g["place"].to_numpy(), g["wide"].to_numpy(), g[["a1", "a2"]].to_numpy()
            rest, parts = _needed(num, den, n) - 1, unsketch(g["sketch"])
            full = (parts == FULL).any(1)
            largest = np.bincount(comp).argmax()
            low, high = np.searchsorted(n, _needed(num, den, n)), np.searchsorted(n, n * den // num, "right")
            for i in np.flatnonzero(comp != largest).tolist():
                z = slice(low[i], high[i])
                least = _needed(num, num + den, n[z] + n[i])
                ok = (comp[z] != comp[i]) & (np.minimum(n[z] - place[z], n[i] - place[i]) >= least)
                ok &= np.minimum(wide[z], wide[i]) + np.maximum(rest[z], rest[i]) >= least
                ok &= (comp[z] == largest) | (np.arange(low[i], high[i]) > i)
                j = low[i] + np.flatnonzero(ok)
                most = np.concatenate([np.minimum(parts[j[c : c + 4096]], parts[i]).sum(1) for c in range(0, len(j), 4096)]) if len(j) else j
                in_reach = ((num + den) * most >= num * (n[j] + n[i])) | full[j] | full[i]
                j, most = j[in_reach], most[in_reach]
                if tries and len(j) > tries:
                    j = j[np.argpartition(-most / (n[j] + n[i]), tries)[:tries]]
                    unended.append(col)
                found.append(np.column_stack([np.tile(ids[i], (len(j), 1)), ids[j]]))
        x = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        swap = (x[:, 0] > x[:, 2]) | ((x[:, 0] == x[:, 2]) & (x[:, 1] > x[:, 3]))
        x[swap] = x[swap][:, [2, 3, 0, 1]]
        x = np.unique(x, axis=0)
        unended = sorted(set(unended))
        made = {c: pa.array([*x[:, i].tolist(), *[None] * len(unended)], pa.int64()) for i, c in enumerate(("a1", "a2", "b1", "b2"))}
        return pa.table(made | {"unended": pa.array([*[None] * len(x), *unended], pa.int64())})

    return run


def _sets(k: int):
    """Whole sets, and how many of their members fall into each part of the hashes."""

    def run(batches):
        seen = set()
        for b in few(batches):
            found = [(signature(s), s) for s in shingle_sets(b.column(1), k)]
            found = [found[i] for i in {g: i for i, (g, _) in enumerate(found) if g not in seen}.values()]
            seen.update(g for g, _ in found)
            if len(seen) > SEEN:
                seen.clear()
            sets = [s for _, s in found]
            counts = [tally(s) for s in sets]
            arrays = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g, _ in found], pa.int64()), pa.array([g[1] for g, _ in found], pa.int64()), pa.array(counts, pa.binary()), arrays], names=["c1", "c2", "counts", "grams"])

    return run


def _within_reach(num: int, den: int):
    """Pairs a1, a2, b1, b2 of sizes nx, ny whose counts by part, x and y, allow the overlap: it is at most the sum of the smaller counts, `most`."""

    def run(batches):
        for b in few(batches):
            most, full = overlaps(b.column("x").to_pylist(), b.column("y").to_pylist())
            sizes = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            arrays = [*(b.column(c) for c in ("a1", "a2", "b1", "b2")), pa.array(most / np.maximum(sizes, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a1", "a2", "b1", "b2", "most"]).filter(pa.array(full | ((num + den) * most >= num * sizes)))

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, wide: int = 32, block_entries: int = 1_000_000, broadcast_ids: int = 1 << 20) -> DataFrame:
    """Links texts whose sets of k-word shingles have a Jaccard similarity of num/den or more.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text of fewer words than k is one shingle; a text without
    words, or null, has none and links with nothing. Returns id, n_shingles, class1, class2 (128 bits that equal sets
    share) and component_id, the smallest id reachable over links. Rows with one id are joined like any others and
    each is returned; rows with a null id get the smallest id of their component, or null if it has none. Other
    columns are ignored; an empty table gives an empty one. block_entries bounds what one task multiplies;
    broadcast_ids bounds a broadcast list of ids, beyond which that join is a shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = cut(rows.mapInArrow(tidy(_describe(k)), "id long, n long, c1 long, c2 long, slot long, df long, sketch binary"), "sets")
    own = told.where("slot is null").select("id", "n", "c1", "c2")
    slots = told.where("slot is not null").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()  # TABLE rows at most
    table = np.zeros(TABLE, np.uint8)
    table[slots["slot"].to_numpy(np.int64)] = np.log2(slots["df"].to_numpy(float)).astype(np.uint8)
    frequent = spark.sparkContext.broadcast(table)

    classes = cut(own.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max(F.col("id").isNull()).alias("nameless")), "classes")
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    blocks = max(8, -(-int(entries) // block_entries))
    product = cut(rows.mapInArrow(tidy(_blocks(k, num, den, blocks, frequent)), BLOCK).groupBy("block").applyInArrow(light(_product(num, den, wide)), PRODUCT), "product")

    def keyed(x: str) -> DataFrame:
        return classes.select(F.col("c1").bitwiseAND(F.lit(KEY)).alias(x), F.col("n").alias(f"n{x}"), F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"))

    pair = ["a1", "a2", "b1", "b2"]
    onward = Window.partitionBy("a", "na").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    entries = product.where("kind = 2").select("col", "a", "na", "place", F.count("*").over(onward).alias("wide"))
    entries = cut(entries.join(keyed("a"), ["a", "na"]), "entries")
    spread = entries.groupBy("a", "na").agg(F.max("wide").alias("wide"))
    in_a, in_b = spread.withColumnRenamed("wide", "wide_a"), spread.select(F.col("a").alias("b"), F.col("na").alias("nb"), F.col("wide").alias("wide_b"))
    # overlaps in narrow columns are counted in full; those in wide ones are at most the entries that either set has there
    counted = product.where("kind < 2").groupBy("a", "na", "b", "nb").agg(F.sum(F.when(F.col("kind") == 0, F.col("shared")).otherwise(0)).alias("shared"))
    least = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    rest = F.greatest(F.ceil(F.col("na") * num / den), F.ceil(F.col("nb") * num / den)) - 1
    wide_both = F.least(F.coalesce("wide_a", F.lit(0)), F.coalesce("wide_b", F.lit(0)))
    counted = counted.join(in_a, ["a", "na"], "left").join(in_b, ["b", "nb"], "left")
    kept = counted.where(F.col("shared") + wide_both + rest >= least).select("a", "na", "b", "nb")
    kept = kept.join(keyed("a"), ["a", "na"]).join(keyed("b"), ["b", "nb"])
    ends = [F.struct(F.col(f"{x}1").alias("x"), F.col(f"{x}2").alias("y")) for x in "ab"]
    kept = kept.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    pairs = cut(kept.select(F.col("a.x").alias("a1"), F.col("a.y").alias("a2"), F.col("b.x").alias("b1"), F.col("b.y").alias("b2")), "pairs")
    forget(product)

    def name(a: str, b: str):
        return F.concat(F.hex(a), F.lit("."), F.hex(b))

    def sides(what: str, of: DataFrame) -> tuple[DataFrame, DataFrame]:
        size = F.size("grams").cast("long")
        return tuple(of.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col(what).alias(y), size.alias(f"n{y}")) for x, y in ("ax", "by"))

    def members(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).union(pairs.select("b1", "b2")).distinct(), "members")

    def linked(near: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The components after linking those of the pairs whose whole sets are similar enough."""
        few = near.count() <= broadcast_ids
        of_b = near.select(F.col("b1").alias("c1"), F.col("b2").alias("c2")).distinct()
        a, b = sides("grams", sets)[0], sides("grams", sets.join(F.broadcast(of_b) if few else of_b, ["c1", "c2"], "left_semi"))[1]
        near = F.broadcast(near) if few else near  # then whole sets move but to the other side of their pairs
        # both >= num/den of the union, as (num + den) * both >= num * (sizes)
        ok = (num + den) * F.size(F.array_intersect("x", "y")) >= num * (F.size("x") + F.size("y"))
        # rows that repeat an id bring a set twice, and then a link
        links = near.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(ok).select(name("a1", "a2").alias("u"), name("b1", "b2").alias("v"))
        return components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    def grown(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The components after all links among pairs that join two of them."""
        wanted = members(pairs)
        whole = wanted.join(classes, ["c1", "c2"])
        ids = cut(whole.where("rep is not null").select(F.col("rep").alias("id")).distinct(), "wanted")
        ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
        some = rows.join(ids, "id", "left_semi")
        nameless = whole.where("rep is null").limit(1).count()
        some = some.unionByName(rows.where("id is null")) if nameless else some
        sets = cut(some.mapInArrow(tidy(_sets(k)), "c1 long, c2 long, counts binary, grams array<long>"), "grams")

        a, b = sides("counts", sets)
        near = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(*pair, "x", "y", "nx", "ny")
        near = cut(near.mapInArrow(tidy(_within_reach(num, den)), "a1 long, a2 long, b1 long, b2 long, most double"), "near")
        each = near.withColumn("node", F.explode(F.array(name("a1", "a2"), name("b1", "b2"))))
        best = each.groupBy("node").agg(F.max(F.struct("most", *pair)).alias("best")).select("best.*").select(*pair).distinct()
        labels = linked(cut(best, "best"), sets, labels)

        def label(a: str, b: str) -> DataFrame:
            return labels.select(F.col("node").alias(a), F.col("label").alias(b))

        apart = near.select(*pair).distinct().withColumn("u", name("a1", "a2")).withColumn("v", name("b1", "b2"))
        apart = apart.join(label("u", "of_u"), "u", "left").join(label("v", "of_v"), "v", "left")
        apart = cut(apart.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select(*pair), "apart")
        if not apart.isEmpty():
            labels = linked(apart, sets, labels)
        forget(sets)
        return labels

    labels = grown(pairs, None)
    if not entries.isEmpty():
        mine = entries.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).distinct()
        mine = F.broadcast(mine) if mine.count() <= broadcast_ids else mine
        sketches = told.select("c1", "c2", "sketch").join(mine, ["c1", "c2"], "left_semi").dropDuplicates(["c1", "c2"])
        sketches = cut(sketches.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), "sketch"), "sketches")
    unended = None
    for tries in (TRIES, None):
        if (entries if unended is None else unended).isEmpty():
            break
        held = entries if unended is None else entries.join(unended, "col", "left_semi")
        held = held.withColumn("node", name("a1", "a2")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        held = cut(held, "wide")
        split = held.groupBy("col").agg((F.min("label") != F.max("label")).alias("split")).where("split").select("col")
        held = held.join(split, "col", "left_semi").withColumn("part", F.pmod(F.col("col"), F.lit(blocks * 8)))
        held = held.join(sketches, ["a1", "a2"])
        more = held.select("part", "col", "a1", "a2", "na", "place", "wide", "label", "sketch").groupBy("part").applyInArrow(light(_across(num, den, tries)), "a1 long, a2 long, b1 long, b2 long, unended long")
        more = cut(more, "across")
        unended = more.where("unended is not null").select(F.col("unended").alias("col"))
        more = cut(more.where("unended is null").select(*pair).distinct().join(pairs, pair, "left_anti"), "pairs")
        if not more.isEmpty():
            labels, pairs = grown(more, labels), pairs.unionByName(more)

    member = classes.withColumn("node", name("c1", "c2")).join(labels, "node").select("c1", "c2", "rep", "label")
    least = member.groupBy("label").agg(F.min("rep").alias("component"))
    member = cut(member.join(least, "label").select("c1", "c2", "component"), "members")
    known = classes.join(member, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    full = own.where("n > 0").join(cut(known, "known"), ["c1", "c2"])
    out = full.select("id", "n", "c1", "c2", "component").unionByName(own.where("n = 0").select("id", "n", "c1", "c2", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c1").alias("class1"), F.col("c2").alias("class2"), F.col("component").alias("component_id"))
