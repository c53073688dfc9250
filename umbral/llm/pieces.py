"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text has an edge for each vocabulary piece that matches and, for characters without a piece, one of
byte pieces. No piece holds a space after another character, or a line feed, so the lattice falls apart at those and
each part is sampled by itself. Forward sums are computed once for each distinct part, for all parts at a time;
backward steps run for all occurrences at a time. The random number of a step is a hash of the seed, the row's key,
the part's place and the step: the same whatever the partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import BACK, PLACE, STEP, mix, tidy

SPACE, FEED = 0x2581, 0x0A
#: Stands for U+2581 in a text, which isn't a space there and so goes out as bytes.
LITERAL = 0x110000
#: Slots of the table of a trie's steps, as a power of two; raised for larger vocabularies.
SLOTS = 18


class Vocabulary:
    """Pieces of a SentencePiece model: hashes, log weights and bytes. Weights fall with the rank by score, as 1 / rank."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(byte).tolist():
            self.byte_ids[int(pieces[i][3:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces; characters outside it would be lost")
        lexical = np.flatnonzero(~special & ~byte)
        if any("▁" in pieces[i].lstrip("▁") or "\n" in pieces[i] for i in lexical.tolist()):
            raise ValueError("pieces with inner spaces or line feeds are not supported")
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n)
        rank[lexical[np.argsort(-score[lexical], kind="stable")]] = np.arange(len(lexical))
        self.weight = np.zeros(n)
        self.weight[lexical] = -alpha * np.log((rank[lexical] + 1) * np.log(n + 1.0))
        self.byte_weight = -alpha * np.log(n * np.log(n + 1.0))
        self.longest = max(len(pieces[i]) for i in lexical.tolist())
        self.ids = lexical
        self._plant([pieces[i] for i in lexical.tolist()], lexical.tolist())
        raw = [bytes([int(p[3:-1], 16)]) if byte[i] else b"" if special[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.raw = raw


    def _plant(self, pieces: list[str], ids: list[int]) -> None:
        """A trie: states are numbered from the root, 0; `piece` has the piece that ends at a state, or -1."""
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for p, i in zip(pieces, ids, strict=True):
            state = 0
            for c in p:
                state = steps.setdefault((state, ord(c)), len(steps) + 1)
            if ends.setdefault(state, i) != i:
                raise ValueError("two pieces are equal")
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(SLOTS, len(steps).bit_length() + 2)
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([(s << 21) | c for s, c in steps], np.int64)
        for k, z, at in zip(keys.tolist(), steps.values(), self._slot(keys).tolist(), strict=True):
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.to[at] = k, z

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * STEP) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that the codes lead to, 0 where they lead nowhere."""
        key = (state << 21) | code
        at = self._slot(key)
        held = self.key[at]
        out = np.where(held == key, self.to[at], 0)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):  # slots that another step took
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def _power(n: int, base) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p, out=p)


def sample(codes: np.ndarray, by_row: np.ndarray, keys: np.ndarray, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts in codes (code points, spaces as U+2581) and their offsets by row."""
    n, rows = len(codes), len(by_row) - 1
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    # parts, and the distinct ones
    first = np.zeros(n + 1, bool)
    first[by_row] = True
    first = first[:n]
    first[1:] |= ((codes[1:] == SPACE) & (codes[:-1] != SPACE)) | (codes[1:] == FEED) | (codes[:-1] == FEED)
    start = np.flatnonzero(first)
    end = np.r_[start[1:], n]
    power, inverse = _power(n, STEP), _power(n, BACK)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64)) * power, out=total[1:])
    part = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * PLACE[4])
    _, one, kind = np.unique(part, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    # their characters, in a row
    size = (end - start)[one]
    head = np.r_[0, np.cumsum(size)]
    m = int(head[-1])
    at = np.repeat(start[one] - head[:-1], size) + np.arange(m)
    local = np.arange(m) - np.repeat(head[:-1], size)
    left = np.repeat(size, size) - local
    letters = codes[at].astype(np.int64)
    del power, inverse, total, part, at
    # edges: all places walk down the trie together
    starts, lengths, ids = [], [], []
    single = np.zeros(m, bool)
    p, state = np.arange(m), np.zeros(m, np.int64)
    for length in range(1, v.longest + 1):
        state = v.step(state, letters[p + length - 1])
        piece = v.piece[state]
        ok = piece >= 0
        starts.append(p[ok])
        lengths.append(np.full(len(starts[-1]), length, np.int64))
        ids.append(piece[ok])
        if length == 1:
            single[p[ok]] = True
        on = (state > 0) & (left[p] > length)
        p, state = p[on], state[on]
        if not len(p):
            break
    lost = np.flatnonzero(~single)
    starts.append(lost)
    lengths.append(np.ones(len(lost), np.int64))
    ids.append(-1 - letters[lost])
    # longer ones first: those are drawn more often
    starts, lengths, ids = (np.concatenate(x[::-1]) for x in (starts, lengths, ids))
    del letters, left, single, p, state, piece
    weight = np.where(ids >= 0, v.weight[np.maximum(ids, 0)], v.byte_weight * utf8_length(-1 - ids))
    node = starts + lengths - 1
    order = np.argsort(node, kind="stable")
    depth = local[node[order]]
    order = order[np.argsort(depth.astype(np.uint16) if depth.max() < 65536 else depth, kind="stable")]
    starts, ids, weight, node = starts[order], ids[order], weight[order], node[order]
    depth = local[node]
    new = np.r_[True, node[1:] != node[:-1]]
    node_first = np.flatnonzero(new)
    rank = np.cumsum(new) - 1
    # forward: log sums by depth, all parts at a time
    alpha = np.zeros(m + 1)  # alpha[p]: of the text before character p of its part
    inner = local[starts] > 0
    value = weight.copy()
    node_of = node[node_first]
    log_sum = np.empty(len(node_first))
    edge_cut = np.searchsorted(depth, np.arange(int(depth.max()) + 2))
    node_cut = np.searchsorted(depth[node_first], np.arange(int(depth.max()) + 2))
    for d in range(int(depth.max()) + 1):
        a, b, x, y = edge_cut[d], edge_cut[d + 1], node_cut[d], node_cut[d + 1]
        w = value[a:b]
        w += np.where(inner[a:b], alpha[starts[a:b]], 0.0)
        group = node_first[x:y] - a
        top = np.maximum.reduceat(w, group)
        log_sum[x:y] = np.log(np.add.reduceat(np.exp(w - top[rank[a:b] - x]), group)) + top
        go = node_of[x:y] + 1
        alpha[go] = log_sum[x:y]
    # backward: shares of a node's edges, summed up
    share = np.exp(value - log_sum[rank])
    up = np.cumsum(share)
    up -= (up - share)[node_first][rank]
    last = np.r_[node_first[1:], len(node)] - 1
    up[last] = 2.0
    del value, weight, share, order, alpha, inner, depth
    rank_of = np.zeros(m, np.int64)
    rank_of[node_of] = np.arange(len(node_of))
    row = np.searchsorted(by_row, start, side="right") - 1
    nth = np.arange(len(start)) - np.searchsorted(start, by_row[:-1])[row]
    base = mix(keys[row] + np.array([seed], np.uint64) * PLACE[5]) + nth.astype(np.uint64) * PLACE[6]
    live, now = np.arange(len(start)), head[kind + 1] - 1
    floor = head[kind]
    steps = np.zeros(len(start), np.int64)
    taken = []
    step = 0
    while len(live):
        u = (mix(mix(base[live]) + np.array([step], np.uint64) * PLACE[7]) >> np.uint64(12)).astype(np.float64) * 2.0**-52
        edge = node_first[rank_of[now]]
        more = np.flatnonzero(up[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[up[edge[more]] <= u[more]]
        taken.append((live, edge))
        steps[live] += 1
        now = starts[edge] - 1
        on = now >= floor[live]
        live, now = live[on], now[on]
        step += 1
    # forward order
    ends = np.cumsum(steps)
    out = np.empty(int(ends[-1]), np.int64)
    for s, (who, edge) in enumerate(taken):
        out[ends[who] - 1 - s] = ids[edge]
    count = np.bincount(row, steps, rows).astype(np.int64)
    if (out < 0).any():
        wide = np.where(out < 0, utf8_length(-1 - out), 1)
        of_row = np.repeat(np.arange(rows), count)
        count = np.bincount(of_row, wide, rows).astype(np.int64)
        flat = np.repeat(out, wide)
        nth_byte = np.arange(len(flat)) - np.repeat(np.cumsum(wide) - wide, wide)
        for c in np.unique(flat[flat < 0]).tolist():
            code = -1 - c
            raw = (chr(SPACE) if code == LITERAL else chr(code)).encode("utf-8", "surrogatepass")
            mine = flat == c
            flat[mine] = v.byte_ids[np.frombuffer(raw, np.uint8)[nth_byte[mine]]]
        out = flat
    return out.astype(np.int32), np.r_[0, np.cumsum(count)]


def utf8_length(code: np.ndarray) -> np.ndarray:
    return np.where(code == LITERAL, 3, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with a space ahead; spaces as U+2581. Empty texts have none."""
    joined = "".join([" " + t if t else "" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == SPACE] = LITERAL
    codes[codes == 0x20] = SPACE
    return codes, np.r_[0, np.cumsum([len(t) + 1 if t else 0 for t in texts])]


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text that was encoded, whatever its segmentation."""
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def _encode(vocabulary, seed: int, chars: int, proof: bool):
    def run(batches):
        v = vocabulary.value
        for b in batches:
            column, keys = b.column(2), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = [n or 0 for n in pc.utf8_length(column).to_pylist()]
            a = 0
            while a < len(sizes):
                z, size = a, 0
                while z < len(sizes) and (z == a or size + sizes[z] <= chars):
                    size += sizes[z]
                    z += 1
                ids, by_row = sample(*code_points([t or "" for t in column[a:z].to_pylist()]), keys[a:z], v, seed)
                cols = [b.column(0)[a:z], pa.ListArray.from_arrays(pa.array(by_row.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(np.diff(by_row))]
                if proof:
                    back = [decode_ids(ids[by_row[i] : by_row[i + 1]].tolist(), v.raw).encode("utf-8", "surrogatepass") for i in range(z - a)]
                    cols += [pa.array([len(x) for x in back], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "n_pieces", "text_bytes", "text_sha256"][: len(cols)])
                a = z

    return run


def sentencepiece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0, proof: bool = False, chars: int = 60_000) -> DataFrame:
    """A sampled segmentation of each whole text: id, ids (piece ids), n_pieces.

    Segmentations are drawn with the product of their pieces' weights, to the power alpha, from the row's id and seed:
    rows with one id and one text get one segmentation. Null and empty texts have no pieces. Texts keep every
    character: what the model lacks becomes byte pieces. Rows may repeat ids or have none (null is a key as any other);
    other columns are ignored. With proof, the pieces are decoded again on the spot, and text_bytes and text_sha256 are of
    what they give. model: path of a SentencePiece model with byte pieces, read on the driver.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, alpha))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(_encode(v, seed, chars, proof)), f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_pieces long" + ", text_bytes long, text_sha256 string" * proof)
    return out.withColumnRenamed("id", id_col)


def sentencepiece_decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with the text of each list of pieces, in out_col; of no pieces it is empty, of null it is null.

    A column that has out_col's name already is replaced; an empty table gives an empty one."""
    raw = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model).raw)
    at = encoded.columns.index(ids_col)
    kept = [i for i, c in enumerate(encoded.columns) if c.lower() != out_col.lower()]

    def run(batches):
        for b in batches:
            column = b.column(at)
            flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            null = column.is_null().to_pylist()
            texts = [None if null[i] else decode_ids(flat[cuts[i] : cuts[i + 1]].tolist(), raw.value) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(b.schema.names[i] for i in kept), out_col])

    return encoded.mapInArrow(tidy(run), StructType([*(encoded.schema.fields[i] for i in kept), StructField(out_col, StringType())]))
