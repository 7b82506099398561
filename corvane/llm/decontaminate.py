"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Shingles are five consecutive words, as sets. A document contains a test item if it has at least
``threshold`` of the item's shingles. Items are partitioned by their number of shingles (powers of two).
In a partition whose items have at most u shingles, the sketch of an item is its u - ceil(threshold * u) + 1
smallest shingle hashes (bottom-k MinHash). A containing document misses fewer shingles than the
sketch has, so it has one of the sketch: the search loses nothing, however long the document. (Banded
signatures of whole documents would: an item of 20 shingles in 20,000 has a Jaccard similarity of 0.001.)
What it finds is verified by counting the item's shingles, word by word, in the document.

Documents are hashed in Arrow batches with array arithmetic over bytes and never shuffled; items are sent
to the executors in blocks of a fixed number of shingles, one pass over the documents for each block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

WIDTH, THRESHOLD = 5, 0.8
#: Shingles of the items that one pass over the documents looks for.
BLOCK = 2_000_000
#: Bytes of text that are hashed at a time.
PIECE = 1 << 22
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(data: bytes) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII; A-Z are lower-cased."""
    return WORD.findall(data.lower())


def shingles(data: bytes) -> set[bytes]:
    """Five words, joined by a space; fewer words are one shingle; none give no shingle."""
    w = words(data)
    return {b" ".join(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()


class Hasher:
    """Hashes of all shingles of many texts at once, by arithmetic modulo 2**64 over their bytes."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        import numpy as np

        low = np.zeros(256, np.uint8)
        for b in range(256):
            if WORD.match(bytes([b]).lower()):
                low[b] = bytes([b]).lower()[0]
        self.low, self.size = low, 0

    def _powers(self, n: int) -> None:
        import numpy as np

        if n > self.size:
            self.size = n
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                x = np.full(n, base & (1 << 64) - 1, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def _piece(self, data, offsets):
        """Word hashes of a piece, and where each word starts; words end at the offsets."""
        import numpy as np

        self._powers(len(data))
        t = self.low[data]
        is_word = t != 0
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = is_word[inner]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        sums = np.add.reduceat(t * self.up[: len(data)], starts)
        return self._mixed(sums * self.down[starts]), starts

    @staticmethod
    def _mixed(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def __call__(self, data, offsets):
        """For texts data[offsets[k]:offsets[k + 1]]: shingle hashes, and the text of each."""
        import numpy as np

        hashes, places, at = [], [], 0
        while at < len(data):
            stop = min(at + PIECE, len(data))
            while stop < len(data):  # back to the last byte that cannot stand in a word, else further on
                gaps = np.flatnonzero(self.low[data[at:stop]] == 0)
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                stop = min(stop + PIECE, len(data))
            h, s = self._piece(data[at:stop], offsets - at)
            hashes.append(h)
            places.append(s + at)
            at = stop
        h, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, places))
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        text = np.searchsorted(offsets, s, "right") - 1
        mult = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WIDTH)]
        n = len(h) - WIDTH + 1
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            inside = text[:n] == text[WIDTH - 1 :]
            out = sum(h[k : k + n] * mult[k] for k in range(WIDTH))[inside]
            of = text[:n][inside]
        # texts of fewer words: the whole sequence
        count = np.bincount(text, minlength=len(offsets) - 1)
        few = np.flatnonzero((count > 0) & (count < WIDTH))
        if len(few):
            begin = np.cumsum(count) - count
            whole = np.zeros(len(few), np.uint64)
            for k in range(WIDTH - 1):
                has = count[few] > k
                whole[has] += h[begin[few[has]] + k] * mult[k]
            out, of = np.concatenate([out, whole]), np.concatenate([of, few])
        return self._mixed(out), of


class Index:
    """Sketches of one block of items, probed with the shingle hashes of documents."""

    def __init__(self, items: list[tuple[object, bytes]], threshold: float) -> None:
        import numpy as np

        hasher, keys, owners = Hasher(), [], []
        self.items = []  # id, exact shingles, how many are needed
        for key, data in items:
            exact = shingles(data)
            if not exact:
                continue
            found = np.unique(hasher(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])
            top = (1 << len(exact).bit_length()) - 1  # the largest size of this partition
            sketch = found[: top - math.ceil(threshold * top - 1e-9) + 1]
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.items)))
            self.items.append((key, exact, math.ceil(threshold * len(exact) - 1e-9)))
        self.keys, self.owners = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (owners, np.int64)))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def candidates(self, hashes, of) -> dict[int, set[int]]:
        import numpy as np

        found: dict[int, set[int]] = {}
        maybe = self.seen[hashes >> np.uint64(42)]
        hashes, of = hashes[maybe], of[maybe]
        lo, hi = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        for k in np.flatnonzero(lo < hi):
            found.setdefault(int(of[k]), set()).update(self.owners[lo[k] : hi[k]].tolist())
        return found

    def matches(self, column):
        """For a binary Arrow column: (row, item id, number of its shingles found, of how many)."""
        import numpy as np
        import pyarrow as pa

        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if len(column) == 0 or offsets[-1] == offsets[0] or not self.items:
            return
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        for row, owners in sorted(self.candidates(*self.hashed(data, offsets - offsets[0])).items()):
            there = shingles(column[row].as_py())
            for k in sorted(owners):
                key, exact, need = self.items[k]
                if (n := len(exact & there)) >= need:
                    yield row, key, n, len(exact)

    def hashed(self, data, offsets):
        self.hasher = getattr(self, "hasher", None) or Hasher()
        return self.hasher(data, offsets)


def _blocks(items: DataFrame, item: str, text: str):
    """The items, in lists of at most BLOCK shingles (a longer item has a list of its own).

    The driver holds one list at a time, however many items there are.
    """
    block, size = [], 0
    for row in items.select(F.col(item).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").toLocalIterator():
        n = len(row.t) // 2
        if block and size + n > BLOCK:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += n
    if block:
        yield block


def contained(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, item, containment) for every document row and every item that it contains.

    Null and empty texts contain nothing and are contained nowhere; null ids are carried like others;
    repeated documents and repeated items each give rows of their own; empty tables give no rows;
    other columns are not read. Long texts are searched whole, PIECE bytes at a time.
    """
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item].dataType
    schema, found = f"id {kind}, item {item_kind.simpleString()}, containment double", None
    docs = df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t"))
    arrow = docs.sparkSession.createDataFrame([], schema).select("item").toArrow().schema.field(0).type
    for block in _blocks(items, item, item_text):

        def search(batches, block=block):
            import pyarrow as pa

            index = Index(block, threshold)
            for b in batches:
                hits = list(index.matches(b.column(1)))
                ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], arrow), pa.array([h[2] / h[3] for h in hits], pa.float64())], ["id", "item", "containment"])

        part = docs.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of *df* that contain no item, with all columns; nothing is shuffled. Null and empty texts contain nothing and stay,
    rows that repeat others stay or go together, empty tables change nothing, and long texts are searched whole."""
    place, schema = df.columns.index(text), df.schema
    for block in _blocks(items, item, item_text):

        def keep(batches, block=block):
            import pyarrow as pa

            index = Index(block, threshold)
            for b in batches:
                bad = {h[0] for h in index.matches(b.column(place).cast(pa.binary()))}
                yield b.take(pa.array([k for k in range(b.num_rows) if k not in bad], pa.int64())) if bad else b

        df = df.mapInArrow(keep, schema)
    return df


SQL = r"""
with w(kind, id, w) as (
  select 0, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
s as (select distinct kind, id, array_to_string(w[i : i + 4], ' ') s from (select kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
n as (select id, count(*) n from s where kind = 1 group by id)
select d.id as doc_id, i.id as item_id, count(*)::double / any_value(n) as containment
from s d join s i on d.kind = 0 and i.kind = 1 and d.s = i.s join n on n.id = i.id
group by d.id, i.id having count(*) >= ceil(0.8 * any_value(n) - 1e-9)
"""
