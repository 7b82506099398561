"""Documents that share buckets, linked by exact Jaccard similarity of their shingles; line dedup uses the buckets and limits.

A search from member to member keeps one link for each member reached instead of all pairs; large buckets are dealt
out in chunks. Distributed union-find turns links into components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import written
from .components import connected_components

#: Least Jaccard similarity.
SIMILARITY = 0.8
#: Members, and bytes of them, in a chunk of a bucket; a task compares two chunks at a time.
CHUNK, CHUNK_BYTES = 1024, 2 << 20

#: From several texts, the hashes of their shingles, text by text, and how many each has.
Hashes = Callable[[list], tuple]


def distinct_buckets(keyed: DataFrame) -> DataFrame:
    """Rows (bucket, chunks) of the buckets of *keyed* (bucket, h1, bytes) that have several members, one of each set of
    members; chunks: into how many its members are dealt."""
    b = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64(F.lit("x"), "h1")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "h1")).alias("y"))
    b = b.where("n > 1").groupBy("n", "bytes", "x", "y").agg(F.min("bucket").alias("bucket"))
    return b.select("bucket", F.expr(f"greatest(ceil(n / {CHUNK}D), ceil(bytes / {CHUNK_BYTES}D))").alias("chunks"))


def near(df: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The rows of *df* whose *key*, a long, may be one of *nodes* (one column *key*, a written table).

    A bitmap of a bounded number of bits, sent to all executors, keeps most others out of the shuffle that follows.
    """
    bits = 1 << min(28, max(20, (8 * nodes.count()).bit_length()))
    spot = F.expr(f"pmod({key}, {bits}L)")
    maps = nodes.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bm"))
    t = df.withColumn("p", spot).join(F.broadcast(maps), F.bitmap_bucket_number("p") == F.col("part"))
    byte = "cast(conv(hex(substring(bm, cast(bitmap_bit_position(p) div 8 + 1 as int), 1)), 16, 10) as int)"
    return t.where(f"(shiftright({byte}, cast(bitmap_bit_position(p) % 8 as int)) & 1) = 1").select(*df.columns)


class Shingled:
    """The shingles of several texts, at least one each, as sets of numbers."""

    def __init__(self, hashes, counts) -> None:
        import numpy as np

        values, ids = np.unique(hashes, return_inverse=True)
        self.vocabulary = len(values)
        pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * self.vocabulary + ids)
        owner, self.ids = pairs // self.vocabulary, pairs % self.vocabulary
        self.sizes = np.bincount(owner, minlength=len(counts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def similar(self, k: int, ids, starts, sizes):
        """Which of the sets *ids*, cut at *starts*, have at least SIMILARITY with text *k*."""
        import numpy as np

        mark = np.zeros(self.vocabulary, np.uint8)
        mark[self.ids[self.starts[k] : self.starts[k] + self.sizes[k]]] = 1
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        return both >= SIMILARITY * (self.sizes[k] + sizes - both) - 1e-9


def spanning(names: list[int], s: Shingled) -> tuple[list, list]:
    """Links that connect all that single linkage connects: a search with one link for each text reached."""
    import numpy as np

    left, ids, starts, sizes, queue, a, b = np.arange(len(names)), s.ids, s.starts, s.sizes, [], [], []

    def without(gone):
        stay = ~gone
        return left[stay], ids[np.repeat(stay, sizes)], np.cumsum(sizes[stay]) - sizes[stay], sizes[stay]

    while len(left):
        if queue:
            at = queue.pop()
        else:
            at = int(left[0])
            left, ids, starts, sizes = without(left == at)
        if len(left):
            near = s.similar(at, ids, starts, sizes)
            if near.any():
                found = left[near].tolist()
                a += [names[at]] * len(found)
                b += [names[x] for x in found]
                queue += found
                left, ids, starts, sizes = without(near)
    return a, b


def between(names: list[int], s: Shingled, roots: list[int], few: list[bool]) -> tuple[list, list]:
    """Links from each text of *few* to others that its root does not yet reach, one for each root."""
    import numpy as np

    a, b, root = [], [], np.asarray(roots, np.int64)
    for k in np.flatnonzero(few).tolist():
        near = s.similar(k, s.ids, s.starts, s.sizes) & (root != root[k])
        for other in np.unique(root[near]).tolist():
            a.append(names[k])
            b.append(names[int(np.flatnonzero(near & (root == other))[0])])
            root[root == other] = root[k]
    return a, b


def searched(rows: DataFrame, hashes: Hashes, least: int, apart: bool) -> DataFrame:
    """Links (u, v) within each group g of *rows*: (g, h1, l), and root, few if *apart*. Texts of fewer than *least* bytes have none.

    Rows are sorted by group and streamed, so a task holds one group at a time.
    """
    columns = ["g", "h1", "l", *(["root", "few"] if apart else [])]

    def search(batches):
        import pyarrow as pa

        def links(part):
            seen = dict(zip(part["h1"], range(len(part["h1"])), strict=True))  # two equal groups may share a name
            pick = [k for k in seen.values() if len(part["l"][k]) >= least]
            if len(pick) < 2:
                return [], []
            names, s = [part["h1"][k] for k in pick], Shingled(*hashes([part["l"][k] for k in pick]))
            return between(names, s, [part["root"][k] for k in pick], [part["few"][k] for k in pick]) if apart else spanning(names, s)

        group, now, out = {c: [] for c in columns}, None, ([], [])
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in columns}
            at, g = 0, values["g"]
            while at < len(g):
                stop = at
                if g[at] != now:
                    for x, y in zip(out, links(group), strict=True):
                        x += y
                    group, now = {c: [] for c in columns}, g[at]
                while stop < len(g) and g[stop] == now:
                    stop += 1
                for c in columns:
                    group[c] += values[c][at:stop]
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v"])
            out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(group)], ["u", "v"])

    rows = rows.select(*[F.col(c).cast("binary") if c == "l" else F.col(c) for c in columns])
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(search, "u long, v long").distinct()


def linked(members: DataFrame, texts: DataFrame, hashes: Hashes, least: int = 1) -> DataFrame:
    """Rows (node, root) of members that are similar to others, as comparing all pairs of each bucket would give.

    *members* (bucket, h1, chunks) and *texts* (h1, l) are written tables. Members are dealt out in chunks by a hash. First each chunk
    of a bucket is searched together with the next one, which is linear in the bucket and links most of what is similar;
    then the members outside a bucket's largest component meet all others of it.
    """
    dealt = members.withColumn("p", F.expr("pmod(xxhash64('chunk', h1), chunks)"))
    rows = dealt.select("bucket", "h1", F.explode(F.expr("if(chunks <= 2, array(0L), array(p, pmod(p + 1, chunks)))")).alias("p"))
    links = written(searched(rows.join(texts, "h1").select(F.xxhash64("bucket", "p").alias("g"), "h1", "l"), hashes, least, False), "links")
    roots = written(connected_components(links, "u", "v"), "linked")
    if not members.where("chunks > 2").isEmpty():
        found = written(searched(_apart(dealt.where("chunks > 2"), roots).join(texts, "h1"), hashes, least, True), "links")
        if not found.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found), "u", "v")
    return roots


def _apart(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (g, h1, root, few): the members outside the largest component of their bucket (few), in groups with each of its chunks."""
    m = dealt.join(roots, F.col("h1") == F.col("node"), "left").select("bucket", "h1", "p", "chunks", F.coalesce("root", "h1").alias("root"))
    sizes = m.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    sizes = sizes.where("top.n < n").select("bucket", F.col("top.root").alias("top"), F.expr("(n - top.n) / cast(n as double)").alias("share"))
    m = m.join(sizes, "bucket").withColumn("us", F.expr("cast(ceil(share * chunks) as bigint)")).withColumn("few", F.expr("root <> top"))
    u = m.where("few").select("bucket", "h1", "root", "few", F.expr("pmod(xxhash64('few', h1), us)").alias("q"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("p"))
    v = m.select("bucket", "h1", "root", F.lit(False).alias("few"), F.explode(F.expr("sequence(0L, us - 1)")).alias("q"), "p")
    # a member of a group's own chunk may come from both sides: it counts as one of the few
    both = u.select("bucket", "p", "q", "h1", "root", "few").union(v.select("bucket", "p", "q", "h1", "root", "few"))
    return both.groupBy(F.xxhash64("bucket", "p", "q").alias("g"), "h1").agg(F.first("root").alias("root"), F.max("few").alias("few"))
