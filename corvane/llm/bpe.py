"""Byte-level BPE by monoid tree reduction.

A text is encoded as a tree: halves are encoded by recursion, and two neighbours are joined by encoding
anew only a window around the border, which grows until what lies outside is proved to stay as it is.
The join is associative, so any tree over the pieces of a text gives the tokens that one pass over the
whole gives. It works on two levels:

* Words (matches of the pattern). A match depends on nothing before its start and on at most
  ``AHEAD`` characters beyond its end. So matches of the left part that end early enough stand, and
  once the window, scanned from there, reaches a border that the right part has too, all later ones stand.
* Tokens within one match. A token sequence is the BPE encoding of its bytes if and only if each pair of
  neighbours is the encoding of its own bytes. So a window fits if the pairs at both of its ends do.

Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

#: Characters of a leaf of the tree over a text, and bytes of a leaf within a match. The tiktoken library
#: encodes the matches of leaves and of the windows at borders.
LEAF_CHARS, LEAF_BYTES = 512, 256
#: The pattern looks no further ahead than this: ``'re`` from its start, white space by one beyond its end.
AHEAD = 3
#: Pairs of tokens that a worker remembers as checked, matches that it remembers with their tokens, and characters of such a match.
PAIRS, MATCHES, SHORT = 50_000, 50_000, 32
#: Texts whose tokens a worker holds at a time.
ROWS = 64


class Node(NamedTuple):
    """A part of a text: its matches, in characters and in tokens each, and all its tokens."""

    sizes: array
    counts: array
    ids: array


class Bpe:
    """Encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes = {v: k for k, v in table.items()}
        self.pattern, self.pairs, self.known = regex.compile(pattern), {}, {}

    # tokens of one match

    def _leaf(self, data: bytes) -> list[int]:
        return self.library._encode_single_piece(data)

    def _stands(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._leaf(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _joined(self, left: list[int], right: list[int]) -> list[int]:
        size = 1
        while True:
            keep, skip = max(0, len(left) - size), min(len(right), size)
            window = b"".join(map(self.bytes.__getitem__, chain(left[keep:], right[:skip])))
            new = self._leaf(window)
            if (not keep or self._stands(left[keep - 1], new[0])) and (skip == len(right) or self._stands(new[-1], right[skip])):
                return left[:keep] + new + right[skip:]
            size *= 2

    def _split(self, data: bytes) -> list[int]:
        """The tree over the bytes of a long match, from the leaves up, level by level."""
        level = [self._leaf(data[k : k + LEAF_BYTES]) for k in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            level = [self._paired(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def _paired(self, left: list[int], right: list[int]) -> list[int]:
        return self._joined(left, right) if not self._stands(left[-1], right[0]) else left + right

    def match_ids(self, match: str) -> list[int]:
        """Tokens of one match of the pattern."""
        if (ids := self.known.get(match)) is None:
            data = match.encode("utf-8", "surrogatepass")
            ids = self._leaf(data) if len(data) <= LEAF_BYTES else self._split(data)
            if len(match) <= SHORT:
                if len(self.known) > MATCHES:
                    self.known.clear()
                self.known[match] = ids
        return ids

    # matches of a text

    def _node(self, matches: list[str]) -> Node:
        tokens = list(map(self.match_ids, matches))
        return Node(array("i", map(len, matches)), array("i", map(len, tokens)), array("i", chain.from_iterable(tokens)))

    def _halves(self, text: str, lo: int, hi: int) -> Node:
        """The node of text[lo:hi], as if it were the whole text."""
        if hi - lo <= LEAF_CHARS:
            return self._node(self.pattern.findall(text[lo:hi]))
        mid = (lo + hi) // 2
        return self._met(text, mid, self._halves(text, lo, mid), self._halves(text, mid, hi))

    def _met(self, text: str, mid: int, left: Node, right: Node) -> Node:
        """The node of two neighbours that meet at text[mid]."""
        # matches of the left part that end, or look ahead, beyond its end may change
        cut, beyond = len(left.sizes), 0
        while cut:
            size = left.sizes[cut - 1]
            beyond += size  # from the start of this match to the end of the left part
            if beyond >= AHEAD and beyond - size >= AHEAD - 1:
                break
            cut -= 1
        begin, take = mid - sum(left.sizes[cut:]), 8
        while True:
            whole = take >= len(right.sizes)
            borders, at = {}, mid - begin  # places of the window where a match of the right part begins
            for k, size in enumerate(right.sizes[:take]):
                borders[at] = k
                at += size
            window, skip = text[begin : begin + at], len(right.sizes) if whole else None
            at, new = 0, []
            for m in self.pattern.findall(window):
                if not whole and (at + AHEAD > len(window) or at + len(m) + AHEAD - 1 > len(window)):
                    break
                if at in borders:
                    skip = borders[at]
                    break
                new.append(m)
                at += len(m)
            if skip is not None:
                return self._around(left, cut, self._node(new), right, skip)
            take *= 4

    @staticmethod
    def _around(left: Node, cut: int, new: Node, right: Node, skip: int) -> Node:
        """The matches of *left* before *cut*, *new*, and those of *right* from *skip* on."""
        keep, gone = len(left.ids) - sum(left.counts[cut:]), sum(right.counts[:skip])
        return Node(left.sizes[:cut] + new.sizes + right.sizes[skip:], left.counts[:cut] + new.counts + right.counts[skip:], left.ids[:keep] + new.ids + right.ids[gone:])

    def encode(self, text: str) -> array:
        return self._halves(text, 0, len(text)).ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, concatenated up the tree; an id that has none is an error."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_LOADED: dict = {}


def loaded(ranks: str, pattern: str) -> Bpe:
    """One encoder for each worker process, for all its tasks."""
    key = ranks, pattern
    if key not in _LOADED:
        _LOADED[key] = Bpe(*key)
    return _LOADED[key]


def encoded(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """*df* with a further column *ids*, array<int>: the tokens of each whole text, without special tokens.

    *ranks* is a file that every executor has under that path. Null and empty texts give an empty array.
    Rows are encoded one by one, so repeated rows are encoded alike, and an empty table stays empty. A long text is
    held once, with twelve bytes for each of its matches. If a column has that name already, the new one's name gets underscores
    until it is free.
    """
    return _mapped(df, text, {ids: "array<int>"}, ranks, pattern)


def decoded(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """*df* with a further column *data*, binary: the bytes of the tokens in *ids* (null: no bytes). A name
    that is taken gets underscores, as in :func:`encoded`."""
    return _mapped(df, ids, {data: "binary"}, ranks, pattern)


def encoded_and_decoded(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Both in one pass over the texts: *ids*, and *data* decoded from them."""
    return _mapped(df, text, {ids: "array<int>", data: "binary"}, ranks, pattern)


def _mapped(df: DataFrame, source: str, targets: dict[str, str], ranks: str, pattern: str) -> DataFrame:
    taken, names = {c.lower() for c in df.columns}, []
    for name in targets:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    place, kinds = df.columns.index(source), list(targets.values())

    def run(batches):
        import pyarrow as pa

        bpe = loaded(ranks, pattern)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                column, new = b.column(place), []
                if kinds[0] == "array<int>":
                    column = _arrow_lists([bpe.encode(x.as_py() or "") for x in column])
                    new.append(column)
                if kinds[-1] == "binary":
                    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
                    new.append(pa.array([bpe.decode(flat[at[k] : at[k + 1]].tolist()) if column[k].is_valid else b"" for k in range(len(column))], pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    return df.mapInArrow(run, schema)


def _arrow_lists(rows: list[list[int]]):
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(np.array(r, np.int32) for r in rows)])))


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ids, decoded): each text's tokens, and the bytes that these give."""
    t = df.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return encoded_and_decoded(t, ranks, pattern, "t").select("id", "ids", "decoded")
