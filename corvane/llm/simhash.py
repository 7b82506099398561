"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance.

Fingerprints are made in Arrow batches (one hash a shingle). Linking works on distinct fingerprints
only: two that differ in at most ``distance`` of 64 bits agree on at least ``blocks - distance`` of
``blocks`` blocks, so each set of that many blocks is a key and close pairs meet under some key.
Under a key, a search from member to member keeps one link for each fingerprint reached instead of
all pairs; a key with many members is dealt out as pairs of chunks. Distributed union-find joins the rest.

A Jaccard similarity of 0.8 over five-word shingles leaves 64-bit fingerprints some ten bits apart, too far for keys that still
tell texts apart. :func:`similar` therefore makes wide fingerprints of two-word shingles, where such pairs agree in nine bits
of ten, splits them into blocks that grow with the corpus, joins on blocks, verifies by Hamming distance over 64 further bits
and then by exact similarity.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations
from math import ceil, comb, log, log2

from pyspark.sql import DataFrame, functions as F

from . import similar as search
from .common import finished, hot_join, written
from .components import connected_components

SEED = 42
#: Members of a key that one task compares at most with as many others.
CHUNK = 16384
#: Words of a shingle of wide fingerprints; share of bits in which texts agree whose five-word shingles have a similarity of 0.8
#: (measured: 0.90 to 0.93); share of such pairs that are to meet in a block; distance of 64 bits beyond which texts are not compared.
WIDE, AGREE, MEET, APART = 2, 0.905, 0.97, 12
#: Members of a block that are compared by distance; in a larger one all go on to the exact comparison.
LIMIT = 4096


def fingerprint(data: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint of UTF-8 text, as a signed integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles are *width* words
    joined by a space, repeats included; fewer words are one shingle, no words give zero. A bit is
    set if it is set in more than half of the shingles' XXH64 hashes.
    """
    hashes, total = _shingled(data, width), 0
    import numpy as np

    counts = np.zeros(64, np.int64)
    for h in hashes:
        total += len(h)
        lanes = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(lanes[:, k], minlength=256) @ _bits()
    value = sum(1 << k for k in range(64) if 2 * int(counts[k]) > total)
    return value - (1 << 64) if value >> 63 else value


def _shingled(data: bytes, width: int):
    """XXH64 hashes of the shingles of a text, in arrays of at most 65,536; none if it has no words."""
    import numpy as np
    import xxhash

    words = data.lower().split()  # on bytes, both know ASCII only
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    xxh, step = xxhash.xxh64_intdigest, 1 << 16
    if n <= width:
        yield np.array([xxh(joined, SEED)], np.uint64)
        return
    ends, total = [x - 1 for x in accumulate(len(w) + 1 for w in words)], n - width + 1
    for at in range(0, total, step):
        stop = min(at + step, total)
        starts = [0, *(e + 1 for e in ends[: stop - 1])] if at == 0 else [e + 1 for e in ends[at - 1 : stop - 1]]
        yield np.fromiter((xxh(joined[s:e], SEED) for s, e in zip(starts, ends[at + width - 1 : stop + width - 1], strict=True)), np.uint64, stop - at)


@cache
def _bits():
    """The bits of each byte, 256 x 8."""
    import numpy as np

    return np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """Rows (id, fp) for each row of *df*; fp is a long. Null texts have the fingerprint zero."""
    kind = df.schema[id_col].dataType

    def make(batches):
        import pyarrow as pa

        for b in batches:
            fp = [fingerprint(x.as_py() or b"", width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    t = df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t"))
    return t.mapInArrow(make, f"id {kind.simpleString()}, fp long")


def _block_count(n: int, distance: int) -> int:
    """The fewest blocks whose keys are so wide that chance puts at most 64 of *n* under one."""
    return next((b for b in range(distance + 2, distance + 9) if n >> (64 // b * (b - distance)) <= 64), distance + 8)


def _spanning(fps, distance: int) -> tuple[list, list]:
    """Links that connect all of *fps* which single linkage connects: a search with one link each."""
    import numpy as np

    left, links_a, links_b = np.unique(np.asarray(fps, np.int64)), [], []
    queue: list = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
        if near.any():
            found = left[near]
            links_a += [int(at)] * len(found)
            links_b += found.tolist()
            queue += list(found)
            left = left[~near]
    return links_a, links_b


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Rows (a, b) of fingerprints at most *distance* bits apart, enough to connect whatever is
    connected. *fps* has one column ``fp`` of distinct longs, and should be a written table.
    """
    blocks = blocks or _block_count(fps.count(), distance)
    borders = [64 * k // blocks for k in range(blocks + 1)]
    part = [f"(shiftrightunsigned(fp, {lo}) & {(1 << hi - lo) - 1}L)" for lo, hi in zip(borders, borders[1:], strict=False)]
    widths = [hi - lo for lo, hi in zip(borders, borders[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        value = "0L"
        for c in chosen:
            value = f"(shiftleft({value}, {widths[c]}) | {part[c]})"
        keys.append(f"struct({k} as k, {value} as v)")
    assert len(keys) == comb(blocks, distance)
    keyed = fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    t = keyed.join(sizes, ["k", "v"]).withColumn("chunks", F.expr(f"cast(ceil(n / {CHUNK}D) as int)"))
    t = t.withColumn("c", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
    t = t.select("k", "v", "fp", F.explode(F.expr("transform(sequence(0, chunks - 1), j -> struct(least(c, j) as p, greatest(c, j) as q))")).alias("pair"))
    t = t.groupBy("k", "v", "pair").agg(F.collect_list("fp").alias("fps")).select("fps").where("size(fps) > 1")

    def search(batches):
        import pyarrow as pa

        for b in batches:
            a, z = [], []
            for x in b.column(0):
                one, two = _spanning(x.values.to_numpy(), distance)
                a += one
                z += two
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return t.mapInArrow(search, "a long, b long").distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """Rows (id, fp, root, component_id) for each row of *df*: root is the smallest fingerprint and component_id is the smallest id reachable
    over links of at most *distance* bits, the row's own included.

    Null ids are ignored in that minimum (null if a class has no other); repeated rows share their
    class; texts without words, nulls included, have the fingerprint zero, which links like any other.
    An empty table gives no rows; other columns are not read.
    """
    rows = written(fingerprints(df, id_col, text, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp"), distance), "a", "b")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = written(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(by_fp, "fp").select("id", "fp", "root", "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """*df* with one row of each class: the one with the smallest id. Of rows that share that id
    (repeats, or classes whose ids are all null), one stays. Columns are unchanged.
    """
    found = written(classes(df, id_col, text, width, distance).where("id <=> component_id").select("id", "fp", "root"), "kept")
    per_id = written(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "per-id")
    kept = df.join(per_id.where("id is not null and n = 1").select(F.col("id").alias(id_col)), id_col, "left_semi").select(*df.columns)
    again = per_id.where("id is null or n > 1").select(F.col("id").alias("j"))
    if again.isEmpty():
        return kept
    # ids that stand for several kept rows: their texts are fingerprinted anew to tell the rows apart
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.join(again, F.expr("k <=> j"), "left_semi").select("row", F.struct("k", "t").alias("key"))
    prints = fingerprints(d.select("key", "key.t").distinct(), "key", "t", width)
    keepers = prints.join(found.distinct().withColumnRenamed("fp", "f").withColumnRenamed("id", "i"), F.expr("fp = f and id.k <=> i"))
    one = d.join(keepers.select(F.col("id").alias("key"), "root"), "key").groupBy("root").agg(F.min_by("row", "key").alias("row"))
    return kept.union(one.select("row.*"))


def _tables(n: int) -> tuple[int, int]:
    """Bits of a block, so that chance puts few of *n* texts under one, and blocks, so that MEET of the similar pairs share one."""
    k = min(40, max(12, ceil(log2(n + 1)) + 4))
    return k, ceil(log(1 - MEET) / log(1 - AGREE**k))


@cache
def _planes(columns: int):
    """For each byte of a shingle's hash, what its value adds to each bit's sum: +1 for half of the values, -1 for the others."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    half = np.repeat(np.array([1, -1], np.float32), 128)
    return np.stack([np.stack([rng.permutation(half) for _ in range(columns)], axis=1) for _ in range(8)])


def wide(data: bytes, columns: int):
    """8 * *columns* bits of a text's two-word shingles; None if it has no words."""
    import numpy as np

    lanes, planes = None, _planes(columns)
    for h in _shingled(data, WIDE):
        lanes = np.zeros((8, 256), np.float32) if lanes is None else lanes
        bytes_ = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes[k] += np.bincount(bytes_[:, k], minlength=256)
    # column by column, so that a block has bits of all eight bytes
    return None if lanes is None else np.einsum("kv,kvc->ck", lanes, planes).ravel() > 0


def _blocks(texts: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Rows (h1, fp, size, keys) of the different texts that have words: 64 bits, number of bytes, and the text's block in each table."""
    columns = -(-(64 + bits * blocks) // 8)

    def make(batches):
        import numpy as np
        import pyarrow as pa

        one, offset, seen = np.int64(1) << np.arange(bits, dtype=np.int64), np.arange(blocks, dtype=np.int64) << np.int64(40), set()
        for b in batches:
            names, prints, sizes, keys = [], [], [], []
            for h1, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if h1 in seen:  # copies nearby; others are left out later
                    continue
                seen.add(h1)
                data = t.as_py()
                if (w := wide(data, columns)) is None:
                    continue
                names.append(h1)
                prints.append(int(np.packbits(w[:64]).view(np.int64)[0]))
                sizes.append(len(data))
                keys.append(w[64 : 64 + bits * blocks].reshape(blocks, bits) @ one + offset)
            seen = set() if len(seen) > 1_000_000 else seen
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["h1", "fp", "size", "keys"])

    t = texts.select("h1", F.coalesce("t", F.lit("")).cast("binary").alias("t")).mapInArrow(make, "h1 long, fp long, size long, keys array<long>")
    return t.groupBy("h1").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))


def _met(prints: DataFrame) -> DataFrame:
    """Rows (bucket, h1, bytes) of texts that share a block with another at most APART of 64 bits away."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        names = ["bucket", "h1", "bytes", "fp"]

        def batch(rows, keep):
            return pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in names[:3]], names[:3])

        def close(rows):
            key, fp = rows["bucket"], rows["fp"]
            found, at, step = np.zeros(len(key), bool), np.arange(len(key)), 1
            while len(at):
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                hit = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= APART]
                found[hit] = found[hit + step] = True
                step += 1
            return found

        left, large = {c: np.zeros(0, np.int64) for c in names}, None
        for b in batches:
            rows = {c: np.concatenate([left[c], b.column(c).to_numpy()]) for c in names}
            if large is not None:  # the rest of a block beyond LIMIT
                stop = int(np.searchsorted(rows["bucket"], large, "right"))
                yield batch(rows, slice(0, stop))
                rows = {c: x[stop:] for c, x in rows.items()}
                large = large if not len(rows["bucket"]) else None
            if not len(rows["bucket"]):
                left = rows
                continue
            last = int(np.searchsorted(rows["bucket"], rows["bucket"][-1], "left"))
            done, left = {c: x[:last] for c, x in rows.items()}, {c: x[last:] for c, x in rows.items()}
            yield batch(done, close(done))
            if len(left["bucket"]) > LIMIT:
                large = left["bucket"][0]
                yield batch(left, slice(None))
                left = {c: x[:0] for c, x in left.items()}
        yield batch(left, close(left))

    t = prints.select(F.explode("keys").alias("bucket"), "h1", F.col("size").alias("bytes"), "fp")
    return t.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "bucket long, h1 long, bytes long")


def _five(texts: list[bytes]) -> tuple:
    import numpy as np

    found = [np.unique(np.concatenate(list(_shingled(t, 5)))) for t in texts]
    return np.concatenate(found), np.array([len(x) for x in found])


def similar(texts: DataFrame) -> DataFrame:
    """Rows (node, root): of texts (*texts*: h1, t) whose five-word shingles, as sets, have a Jaccard similarity of 0.8 or more to
    another's, the smallest h1 that links reach. h1 is a 64-bit hash of the text."""
    n = texts.select(F.approx_count_distinct("h1")).first()[0]
    prints = written(_blocks(texts, *_tables(n)), "prints")
    met = written(_met(prints), "met")
    members = written(met.join(search.distinct_buckets(met), "bucket").select("bucket", "h1", "chunks"), "members")
    nodes = written(members.select("h1").distinct(), "nodes")
    whole = search.near(texts, nodes, "h1").groupBy("h1").agg(F.first("t").alias("l")).join(nodes, "h1")
    return search.linked(members, written(whole, "texts"), _five)


def deduplicated_similar(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """*df* with one row of each group of near copies (:func:`similar`, and equal texts): the one with the smallest id, null ids last,
    then the smallest hash of the text. Of rows that repeat both, one stays. Columns are unchanged.

    A null text counts as empty; texts without words are near copies of their equals only. An empty table stays empty. Long texts are
    read whole: a task holds one text, or two chunks of a bucket, at a time.
    """
    name = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), name.alias("h1"))
    roots = finished(lambda: similar(df.select(name.alias("h1"), F.col(text).alias("t"))), "roots")
    times = rows.groupBy("h1").agg(F.count(F.lit(1)).alias("times"))
    roots = written(roots.join(times, roots.node == times.h1).select("h1", "root", "times"), "roots")
    found = hot_join(rows, roots, ["h1"], "times", F.xxhash64("id")).select("id", "h1", F.coalesce("root", "h1").alias("root"))
    found = found.groupBy("root", "id", "h1").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h1", "n")).alias("k"))
    first = written(first.select(F.col("k.id").alias("k_id"), F.col("k.h1").alias("k_h1"), F.col("k.n").alias("k_n")), "first")
    match = F.expr("k_id <=> id_ and k_h1 = h_")
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id_"), name.alias("h_"))
    once = d.join(first.where("k_n = 1"), match, "left_semi").select("row.*")
    again = first.where("k_n > 1")
    if again.isEmpty():
        return once
    return once.union(d.join(again, match, "left_semi").groupBy("id_", "h_").agg(F.first("row").alias("row")).select("row.*"))
