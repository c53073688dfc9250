"""Token counts that follow edits: a segment tree of pre-tokens per document.

Leaves hold runs of pre-tokens with their lengths and token counts, inner nodes the sums of both. An edit is found by
descending the sums of lengths; only the pre-tokens it touches, and as many before it as its boundary can change, are
split and encoded again, until the new split meets an old boundary; then the sums on the way up are set anew.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The public split pattern of byte-level BPE vocabularies of this family; no alternative looks back.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 500_000):
        import regex
        import tiktoken

        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(pieces)
        encode = self.encoding.encode_ordinary
        for p in new:
            known[p] = len(encode(p))
        return [known[p] for p in pieces]


class Tree:
    """Segment tree over leaves of pre-tokens; sums[i] is (characters, tokens, pre-tokens) of node i, 1 the root."""

    LEAF = 64

    def __init__(self, lengths: list[int], counts: list[int]):
        n = self.LEAF
        self._set([(lengths[i : i + n], counts[i : i + n]) for i in range(0, len(lengths), n)])

    def _set(self, leaves: list) -> None:
        self.leaves = leaves or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.width)
        for i, (a, b) in enumerate(self.leaves):
            self.sums[self.width + i] = sum(a), sum(b), len(a)
        for i in range(self.width - 1, 0, -1):
            x, y = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = x[0] + y[0], x[1] + y[1], x[2] + y[2]

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pieces(self) -> int:
        return self.sums[1][2]

    def find(self, char: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds a character; past the end, the place after the last."""
        if char >= self.chars:
            last = max(0, max((i for i, (a, _) in enumerate(self.leaves) if a), default=0))
            return last, len(self.leaves[last][0]), self.chars
        node, at = 1, 0
        while node < self.width:
            node *= 2
            if char >= at + self.sums[node][0]:
                at += self.sums[node][0]
                node += 1
        leaf = node - self.width
        for i, n in enumerate(self.leaves[leaf][0]):
            if char < at + n:
                return leaf, i, at
            at += n
        raise AssertionError("sums and leaves differ")

    def before(self, leaf: int, i: int) -> tuple[int, int] | None:
        """The place of the pre-token before this one."""
        while i == 0:
            if leaf == 0:
                return None
            leaf -= 1
            i = len(self.leaves[leaf][0])
        return leaf, i - 1

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Puts new pre-tokens in place of those from first up to, not including, last."""
        (a, i), (b, j) = first, last
        merged = self.leaves[a][0][:i] + lengths + self.leaves[b][0][j:], self.leaves[a][1][:i] + counts + self.leaves[b][1][j:]
        if len(merged[0]) > 4 * self.LEAF:
            n = self.LEAF
            parts = [(merged[0][k : k + n], merged[1][k : k + n]) for k in range(0, len(merged[0]), n)]
            self._set(self.leaves[:a] + parts + self.leaves[b + 1 :])
            return
        for k in range(a, b + 1):
            self.leaves[k] = merged if k == a else ([], [])
        touched = set(range(self.width + a, self.width + b + 1))
        for node in touched:
            x, y = self.leaves[node - self.width]
            self.sums[node] = sum(x), sum(y), len(x)
        while touched != {1}:
            touched = {n // 2 for n in touched if n > 1}
            for n in touched:
                x, y = self.sums[2 * n], self.sums[2 * n + 1]
                self.sums[n] = x[0] + y[0], x[1] + y[1], x[2] + y[2]


class Document:
    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.split.findall(text)
        self.tree = Tree([*map(len, pieces)], counter.of(pieces))

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replaces text[start : start + deleted]; places beyond the text are taken as its end."""
        old, tree = self.text, self.tree
        start = min(max(0, start), len(old))
        end = min(len(old), start + max(0, deleted))
        new = old[:start] + inserted + old[end:]
        shift = len(new) - len(old)
        # the pre-token before the edit may grow into it, white space before that may regroup, an apostrophe there begin a contraction
        leaf, i, at = tree.find(max(0, start - 1))
        while at > 0 and (back := tree.before(leaf, i)) is not None:
            n = tree.leaves[back[0]][0][back[1]]
            if not old[at - n : at].isspace() and old[at - 1] != "'":
                break
            (leaf, i), at = back, at - n
        pieces, meet, to = [], None, at
        after = start + len(inserted)
        for m in self.counter.split.finditer(new, at):
            if m.start() >= after and m.start() - shift >= end:
                place = tree.find(m.start() - shift)
                if place[2] == m.start() - shift:
                    meet = place[:2]
                    break
            pieces.append(m.group())
            to = m.end()
        if meet is None:
            assert to == len(new)
            meet = len(tree.leaves) - 1, len(tree.leaves[-1][0])
        tree.replace((leaf, i), meet, [*map(len, pieces)], self.counter.of(pieces))
        self.text, self.encoded = new, self.encoded + len(pieces)


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def edit_aware_counts(docs: DataFrame, edits: Column, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Token counts of each whole text before and after its edits.

    edits: array<struct<start int, deleted int, inserted string>> per row, applied in order, in characters of the text
    as it is then; null entries or arrays are no edits; places beyond the text are its end. Returns id, n_pretokens and
    n_tokens of the text as it was, n_chars_after, n_pretokens_after, n_tokens_after, and n_encoded, the pre-tokens
    encoded again. A null text counts as an empty one. Rows may repeat ids or have none; other columns are ignored.
    ranks_path: a vocabulary file, read on the driver.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), edits.cast("array<struct<start:int,deleted:int,inserted:string>>").alias("edits"))
    names = ("n_pretokens", "n_tokens", "n_chars_after", "n_pretokens_after", "n_tokens_after", "n_encoded")

    def run(batches):
        counter = Counter(ranks.value, pattern)
        for b in batches:
            out = []
            for text, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = Document(text or "", counter)
                was = doc.tree.pieces, doc.tree.tokens
                for e in changes or []:
                    if e is not None:
                        doc.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((*was, doc.tree.chars, doc.tree.pieces, doc.tree.tokens, doc.encoded))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)
