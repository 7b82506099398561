"""Line dedup across documents: exact copies by hash, fuzzy ones by MinHash over character shingles.

Signatures are minima of one shingle hash under many orders (h XOR a constant), taken while Spark aggregates
exploded shingles inside generated code. Bands of them are the keys of buckets; of buckets with equal members one
stays. Members of large buckets first meet a few leaders, as long as that links many; then all that no links connect yet is compared
by exact Jaccard similarity, in the condition of a join, so that only links become rows. Large buckets are dealt out in chunks.
Distributed union-find turns links into components, and the first line of each component, in document order, stays.

Built-in functions only. Texts move between machines only for lines that share a bucket with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import similar
from .common import dropped, finished, hot_join, written
from .components import connected_components
from .similar import distinct_buckets, near

#: Bytes of a shingle, bands, minima of a band.
WIDTH, BANDS, DEPTH = 12, 6, 3
#: Bytes of a line whose shingles are exploded at a time.
PIECE = 1 << 16
#: What the 32-bit hashes are XORed with for each place of a signature, over the whole range.
ORDER = [(k * 0x9E3779B9 + 0xA43F6A88) % 2**32 for k in range(BANDS * DEPTH)]
#: Size in bytes from which a line's minima leave out hashes that do not begin like any of ORDER. A minimum differs by that only if none
#: of the hashes begins like its own constant (one in 57 at this size), and then it is one over fewer shingles.
LARGE = 256
#: Bits that tell how a hash begins, and the beginnings of ORDER as a set of bits.
START = 6
STARTS = sum({1 << (c >> (32 - START)) for c in ORDER})
#: Members from which a bucket gets leaders, and how many at a time.
MANY, LEADERS = 16, 4
#: Words of a sketch, 64 bits each, and how many shingles enter it at a time.
WORDS, STEP = 16, 4

BLANK = r"trim(leading ' \t\n\u000b\u000c\r' from l) = ''"


def _lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lines with a word: k (document: id and hash of the text), n (place from 0), h1, h2 (128-bit hash), l."""
    d = df.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("x")).alias("k"), F.col(text).alias("t"))
    t = d.select("k", F.posexplode(F.split("t", "\n", -1)).alias("n", "l")).where(f"not ({BLANK})")
    return t.select("k", "n", F.xxhash64("l").alias("h1"), F.xxhash64(F.lit("line"), "l").alias("h2"), "l")


def _minima(lines: DataFrame) -> DataFrame:
    """Rows (h1, bytes, m0, m1, ...): the signature of each different line of WIDTH bytes or more; shorter ones have no similar lines."""
    t = lines.select("h1", F.col("l").cast("binary").alias("l")).select("h1", "l", F.length("l").alias("bytes")).where(f"bytes >= {WIDTH}")
    t = t.select("h1", "bytes", "l", F.explode(F.expr(f"sequence(0, bytes - {WIDTH}, {PIECE})")).alias("at"))
    t = t.select("h1", "bytes", F.expr(f"substring(l, at + 1, {PIECE + WIDTH - 1})").alias("l"))
    t = t.select("h1", "bytes", "l", F.explode(F.expr(f"sequence(1, length(l) - {WIDTH - 1})")).alias("i"))
    t = t.select("h1", "bytes", F.expr(f"hash(substring(l, i, {WIDTH}))").alias("h"))
    mask = STARTS - 2**64 if STARTS >= 2**63 else STARTS
    t = t.where(f"bytes < {LARGE} or (shiftright({mask}L, shiftrightunsigned(h, {32 - START})) & 1L) = 1")
    # the sign bit is flipped, so that signed minima are those of unsigned numbers
    return t.groupBy("h1").agg(F.max("bytes").alias("bytes"), *[F.min(F.expr(f"h ^ {(c ^ 2**31) - 2**32 * (c < 2**31)}")).alias(f"m{k}") for k, c in enumerate(ORDER)])


def _banded(lines: DataFrame) -> DataFrame:
    """Rows (h1, bytes, keys): the buckets of each different line of WIDTH bytes or more."""
    keys = [f"xxhash64({k}, {', '.join(f'm{k * DEPTH + j}' for j in range(DEPTH))})" for k in range(BANDS)]
    return _minima(lines).select("h1", "bytes", F.expr(f"array({', '.join(keys)})").alias("keys"))


def _shingled(texts: DataFrame) -> DataFrame:
    """Rows (h1, buckets, size, s): of each line of *texts* (h1, l, buckets), the set of its shingles as 32-bit hashes."""
    t = texts.select("h1", "buckets", F.col("l").cast("binary").alias("l"))
    # in an array of its own, so that a line's bytes are not fetched again for each shingle
    s = f"array_distinct(get(transform(array(l), x -> transform(sequence(1, length(x) - {WIDTH - 1}), i -> hash(substring(x, i, {WIDTH})))), 0))"
    return t.select("h1", "buckets", F.expr(s).alias("s")).select("h1", "buckets", F.size("s").alias("size"), "s")


def _sketched(shingled: DataFrame) -> DataFrame:
    """Rows (h1, x): of each set of *shingled*, WORDS * 64 bits that tell whether an even or an odd number of its hashes fall there.

    A bit in which two sketches differ stands for at least one hash that only one of the sets has, and different bits for different hashes.
    """
    t = shingled.select("h1", "s", F.explode(F.expr(f"sequence(0, size - 1, {STEP})")).alias("i")).select("h1", *[F.expr(f"get(s, i + {j})").alias(f"s{j}") for j in range(STEP)])
    places = [F.expr(f"coalesce(shiftrightunsigned(s{j}, 6) & {WORDS - 1}, -1)").alias(f"w{j}") for j in range(STEP)]
    t = t.select("h1", *places, *[F.expr(f"coalesce(shiftleft(1L, s{j}), 0L)").alias(f"b{j}") for j in range(STEP)])
    t = t.groupBy("h1").agg(*[F.bit_xor(F.expr(" ^ ".join(f"if(w{j} = {k}, b{j}, 0L)" for j in range(STEP)))).alias(f"x{k}") for k in range(WORDS)])
    return t.select("h1", F.array(*[f"x{k}" for k in range(WORDS)]).alias("x"))


def _alike() -> str:
    """Whether the sets of u and v have at least SIMILARITY. Sizes, and hashes that by the sketches only one of them has, tell most others
    apart before the sets are compared, and no similar ones."""
    least = similar.SIMILARITY
    # one array each: as columns they make the join's generated code too large to be compiled
    odd = "aggregate(zip_with(u_x, v_x, (a, b) -> bit_count(a ^ b)), 0, (n, c) -> n + c)"
    return (f"least(u_size, v_size) >= {least}D * greatest(u_size, v_size) - 1e-9D "
            f"and {1 + least}D * {odd} <= {1 - least}D * (u_size + v_size) + 1e-3D "
            f"and {1 + least}D * (u_size - size(array_except(u_s, v_s))) >= {least}D * (u_size + v_size) - 1e-9D")


def _side(name: str, t: DataFrame, keys: list[str]) -> DataFrame:
    return t.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c not in keys])


def _led(members: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Links (u, v) of members (bucket, h1, chunks, p) of large buckets to leaders. Who has none meets other leaders next time, as long as
    that finds a tenth of them; the others are left to :func:`_apart`."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MANY}")
    left, links = written(members.join(sizes.select("bucket"), "bucket"), "left"), []
    n = left.count()
    while n:
        heads = left.groupBy("bucket", "chunks", F.expr(f"pmod(xxhash64('leader', h1), {LEADERS})").alias("k")).agg(F.min("h1").alias("h1"))
        heads = heads.join(texts, "h1").select("bucket", *texts.columns, F.explode(F.expr("sequence(0L, chunks - 1)")).alias("p"))
        u, v = _side("u", left.join(texts, "h1"), ["bucket", "p"]), _side("v", heads, ["bucket", "p"])
        found = written(u.join(v, ["bucket", "p"]).where(f"u_h1 <> v_h1 and {_alike()}").select("bucket", F.col("u_h1").alias("u"), F.col("v_h1").alias("v")), "links")
        links.append(found.select("u", "v"))
        gone = found.select("bucket", F.col("u").alias("h1")).union(found.select("bucket", "v")).distinct()
        left = written(left.join(gone, ["bucket", "h1"], "left_anti"), "left")
        before, n = n, left.count()
        if 10 * (before - n) < before:
            break
    return links


def _apart(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between members of a bucket that *roots* (node, root) does not connect yet: those outside the bucket's largest
    component meet all others of it, chunk by chunk. The join itself compares them, so that other pairs are never rows. Who shares several
    buckets is compared in the first one only; as roots are the same in all of them, they meet in each.
    """
    m = members.join(roots, F.col("h1") == F.col("node"), "left").select("bucket", "h1", "chunks", "p", F.coalesce("root", "h1").alias("root"))
    sizes = m.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    sizes = sizes.where("top.n < n").select("bucket", F.col("top.root").alias("top"), F.expr("n - top.n = 1").alias("one"), F.expr("(n - top.n) / cast(n as double)").alias("share"))
    m = m.join(sizes, "bucket").select("bucket", "h1", "root", "chunks", "p", "one", F.expr("root = top").alias("most"), F.expr("cast(ceil(share * chunks) as bigint)").alias("us"))
    m = written(m, "apart").join(texts, "h1")
    keys, rest = ["bucket", "p", "q"], ["root", "most", *texts.columns]
    u = _side("u", m.where("not most").select("bucket", F.expr("pmod(xxhash64('few', h1), us)").alias("q"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("p"), *rest), keys)
    v = _side("v", m.where("most or not one").select("bucket", F.explode(F.expr("sequence(0L, us - 1)")).alias("q"), "p", *rest), keys)
    once = "bucket = array_min(array_intersect(u_buckets, v_buckets))"
    return u.join(v, keys).where(f"u_root <> v_root and (v_most or u_h1 < v_h1) and {once} and {_alike()}").select(F.col("u_h1").alias("u"), F.col("v_h1").alias("v")).distinct()


def components(lines: DataFrame) -> DataFrame:
    """Rows (h1, root) of lines that are similar to others but not equal, as comparing all pairs of each bucket would give.

    Lines that share h1 with a different line, one chance in 2**64 for a pair, are left to exact matching.
    """
    banded = written(_banded(lines), "banded")
    keyed = banded.select("h1", "bytes", F.explode("keys").alias("bucket"))
    buckets = written(distinct_buckets(keyed), "buckets")
    members = near(keyed, buckets.select("bucket"), "bucket").join(buckets, "bucket")
    members = written(members.select("bucket", "h1", "chunks", F.expr("pmod(xxhash64('chunk', h1), chunks)").alias("p")), "members")
    dropped(banded)
    nodes = written(members.groupBy("h1").agg(F.collect_list("bucket").alias("buckets")), "nodes")
    texts = near(lines.select("h1", "h2", "l"), nodes.select("h1"), "h1").groupBy("h1").agg(F.first("l").alias("l"), F.min("h2").alias("a"), F.max("h2").alias("b"))
    texts = written(_shingled(texts.where("a = b").select("h1", "l").join(nodes, "h1")), "texts")
    texts = texts.join(written(_sketched(texts), "sketches"), "h1")
    links = _led(members, texts)
    roots = members.select(F.col("h1").alias("node"), F.col("h1").alias("root")).limit(0)
    if links:
        roots = written(connected_components(reduce(DataFrame.union, links), "u", "v"), "linked")
    found = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_apart(members, roots, texts))
    return connected_components(found, "u", "v").select(F.col("node").alias("h1"), "root")


def duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k, n, keeper) of every line that goes: k and n tell document and place, keeper (k, n) the line
    that stays for its component, the first by id, hash of the text and place.

    Lines end at ``\\n``; lines of ASCII white space never count. Lines of fewer than WIDTH bytes are one
    shingle, so only their copies go. Null and empty texts have no lines; null ids come last; rows that repeat
    both id and text are one document and lose the same lines; an empty table gives no rows; other columns
    are not read. Long lines and texts are read whole; a task holds one text, or two chunks of a bucket, at a time.
    """
    lines = _lines(df, id_col, text)
    roots = finished(lambda: components(lines), "roots")
    places = written(lines.select("k", "n", "h1", "h2"), "places")
    kinds = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "n")).alias("first"))
    kinds = written(kinds.join(roots, "h1", "left").where("times > 1 or root is not null"), "kinds")
    alike = kinds.where("root is not null")
    keepers = written(alike.groupBy("root").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("kinds")), "keepers")
    alike = hot_join(alike, keepers, ["root"], "kinds", F.col("h1")).select("h1", "h2", "times", "keeper")
    kept = written(kinds.where("root is null").select("h1", "h2", "times", F.col("first").alias("keeper")).union(alike), "kept")
    gone = hot_join(places, kept, ["h1", "h2"], "times", F.xxhash64("k", "n"))
    return gone.where("keeper <> struct(k, n)").select("k", "n", "keeper").distinct()


def deduplicated(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """*df* with the lines of :func:`duplicates` gone from its texts; documents that had words and lose
    all of them go as well. Rows and columns are otherwise unchanged.
    """
    gone = duplicates(df, id_col, text).groupBy("k").agg(F.collect_list("n").alias("gone"))
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("x"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("k"), F.col(text).alias("t"))
    rows = rows.join(gone, "k", "left").select("row", "gone", "t", F.expr("if(gone is null, null, split(t, '\n', -1))").alias("ls"))
    stay = "array_except(sequence(0, size(ls) - 1), gone)"
    rows = rows.select("row", "gone", F.expr(f"if(gone is null, t, array_join(transform({stay}, i -> get(ls, i)), '\n'))").alias("l"))
    rows = rows.where(f"gone is null or not ({BLANK})")
    return rows.select(*[F.col("l").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def shingle_hashes(data: bytes, sizes):
    """Spark's ``hash`` of the shingles of lines of WIDTH bytes or more, which *data* holds one after the other, line by line."""
    import numpy as np

    total, data, u = len(data), data + bytes(WIDTH + 4), np.uint32
    words = np.empty(total + WIDTH, u)  # four bytes from every place
    for k in range(4):
        words[k::4] = np.frombuffer(data, "<u4", len(range(k, total + WIDTH, 4)), k)
    turned = lambda x, by: (x << u(by)) | (x >> u(32 - by))
    h = np.full(total, 42, u)
    for at in range(0, WIDTH, 4):
        h = turned(h ^ turned(words[at : at + total] * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(WIDTH)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(by))) * u(times)
    inside = np.ones(total + 1, bool)
    ends = np.cumsum(sizes)
    for k in range(1, WIDTH):  # places too near the end of their line
        inside[ends - k] = False
    return (h ^ (h >> u(16)))[inside[:total]]


def signatures(lines: list[bytes]):
    """The minima of each line over all its shingles, len(lines) x BANDS * DEPTH: what the query takes in Spark, as a model for tests.
    Lines have WIDTH bytes or more; longer ones than PIECE go piece by piece."""
    import numpy as np

    parts, owners = [], []
    for k, line in enumerate(lines):
        for at in range(0, max(1, len(line) - WIDTH + 1), PIECE):
            parts.append(line[at : at + PIECE + WIDTH - 1])
            owners.append(k)
    out = np.empty((len(parts), len(ORDER)), np.uint32)
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop]) <= PIECE):
            size += len(parts[stop])
            stop += 1
        sizes = np.fromiter(map(len, parts[at:stop]), np.int64, stop - at)
        h = shingle_hashes(b"".join(parts[at:stop]), sizes)
        starts = np.cumsum(sizes - (WIDTH - 1)) - (sizes - (WIDTH - 1))
        for k, c in enumerate(ORDER):
            out[at:stop, k] = np.minimum.reduceat(h ^ np.uint32(c), starts)
        at = stop
    return np.minimum.reduceat(out, np.searchsorted(owners, np.arange(len(lines))), axis=0)
