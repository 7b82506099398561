"""Dense vectors: validation, normalisation, exact cosine search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Numbers of the queries' vectors that are broadcast at a time, of eight bytes each; hits of a block's queries that a task holds.
BLOCK, HELD = 2_000_000, 1_000_000
#: Pairs whose products a Python worker holds at a time, of eight bytes each.
PRODUCTS = 2_000_000


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def valid(a: str, dims: int) -> str:
    """Right size, all finite, not zero."""
    return f"size({a}) = {dims} and forall({a}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({a}, x -> x <> 0)"


def normalized(a: str) -> str:
    # the norm is bound to a name by a lambda over one row, so that it is computed once
    return f"element_at(transform(array({norm(a)}), n -> transform({a}, x -> cast(x as double) / n)), 1)"


def _kept(q, ids, s, k: int, digits: int):
    """Places of the hits (query q, ids, similarity s) that may be among the *k* best of their query, by similarity rounded to *digits*
    and then id. Where the rounding is not certain, sums in another order could round otherwise, so these stay as well."""
    import numpy as np

    low, high = (np.floor((s + e) * 10.0**digits + 0.5) for e in (-1e-12, 1e-12))
    order = np.lexsort((ids, -low, q))
    q, low, high = q[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[first, len(q)])
    place = np.arange(len(q)) - np.repeat(first, size)
    last = np.repeat(np.where(size > k, low[first + np.minimum(k, size) - 1], -np.inf), size)
    return order[(place < k) | (high > low) & (high >= last)]


def _nearest(q, v, ids, k: int, digits: int):
    """Hits (query, id, similarity) of *q* among *v*, matrices of unit vectors, at least the *k* best of each query. A hit's products are
    summed in order, as SQL does it. A similarity of inf stands for NaN, of -inf for null: where a vector holds a null (masked)."""
    import numpy as np

    (q, q_null), (v, v_null) = ((np.ma.getdata(x), np.ma.getmaskarray(x).any(axis=1)) for x in (q, v))
    out = []
    for a in range(0, len(q), step := max(1, PRODUCTS // max(1, len(v)))):
        s = q[a : a + step] @ v.T
        s[np.isnan(s)] = np.inf
        s[q_null[a : a + step]] = s[:, v_null] = -np.inf
        least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] - 2 * 10.0**-digits if len(v) > k else np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= least[:, None])
        best = _kept(i, ids[j], found := s[i, j], k, digits)
        i, j, found = i[best], j[best], found[best]
        for b in range(0, len(i), 50_000):
            part, fine = slice(b, b + 50_000), np.isfinite(found[b : b + 50_000])
            found[part][fine] = np.cumsum(q[a + i[part][fine]] * v[j[part][fine]], axis=1)[:, -1]
        out.append((a + i, ids[j], found))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _matrices(ids, vectors) -> dict:
    """Of each length, (ids, matrix) of the vectors, an Arrow list array; missing vectors are left out, nulls in them are masked."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        x = vectors.take(rows).flatten()
        null = x.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
        out[int(n)] = ids[rows], np.ma.array(pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False).reshape(-1, n), mask=null)
    return out


def knn(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact search: rows (query_id, chunk_id, similarity, rank), the *k* (1 to 1000) nearest by cosine, ties by id.

    *queries* (query_id, q) is a stated set, sent to the vectors in blocks of about BLOCK numbers; *vectors* (chunk_id, v) stay where they
    are and are scanned once for each block. All products are taken, as products of matrices in Arrow batches, and only the best *k* of a query
    leave a task, with any more whose rounding could differ by the order of summation. Vectors are normalised once.
    """
    import numpy as np

    k = min(max(k, 1), 1000)
    q = queries.select("query_id", F.expr(normalized("q")).alias("q"))
    v = vectors.select("chunk_id", F.expr(normalized("v")).alias("v"))
    n_numbers, n_queries = queries.agg(F.sum(F.size("q")), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil((n_numbers or 0) / BLOCK), math.ceil(n_queries * k / HELD))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("similarity", T.DoubleType())])
    pairs = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.expr(f"pmod(xxhash64(query_id), {blocks}) = {b}"))).toArrow().combine_chunks()
        asked = part.column("query_id").combine_chunks()
        sent = queries.sparkSession.sparkContext.broadcast((asked, _matrices(np.arange(len(asked)), part.column("q").combine_chunks())))
        found = v.mapInArrow(lambda batches, sent=sent: _held(batches, sent, k, digits), schema).withColumn("similarity", F.round("similarity", digits))
        pairs = found if pairs is None else pairs.union(found)
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _held(batches, sent, k: int, digits: int):
    """Arrow batches (query_id, chunk_id, similarity) of the best hits among the vectors of a task, for the queries *sent*."""
    import numpy as np
    import pyarrow as pa

    asked, queries = sent.value
    held, kind = None, None
    for b in batches:
        kind = b.schema.field("chunk_id").type
        for n, (ids, v) in _matrices(b.column("chunk_id").to_numpy(zero_copy_only=False), b.column("v")).items():
            if n in queries:
                at, q = queries[n]
                i, found, s = _nearest(q, v, ids, k, digits)
                new = at[i], found, s
                held = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
                if held is not new:
                    best = _kept(*held, k, digits)
                    held = tuple(x[best] for x in held)
    for a in range(0, len(held[0]) if held else 0, 10_000):
        i, ids, s = (x[a : a + 10_000] for x in held)
        s = pa.array(np.where(s == np.inf, np.nan, s), pa.float64(), mask=s == -np.inf)
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), pa.array(ids, kind), s], ["query_id", "chunk_id", "similarity"])


def spaces(vectors: DataFrame) -> DataFrame:
    """Rows (model, revision, dims, vectors, consistent), a row for each space of *vectors* (model, revision, v): a space is a model in
    a revision, and all its vectors must have one length; where they have not, dims is null."""
    s = vectors.groupBy("model", "revision").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"))
    one = F.expr("least = most and least > 0")
    return s.select("model", "revision", F.when(one, F.col("least")).alias("dims"), "vectors", one.alias("consistent"))


def with_space(known: DataFrame, model: str, revision: str, dims: int) -> DataFrame:
    """*known* (model, revision, dims) with that space; nothing changes if it is there, and another length is an error."""
    found = known.where((F.col("model") == model) & (F.col("revision") == revision)).select("dims").head()
    if found is None:
        return known.unionByName(known.sparkSession.createDataFrame([(model, revision, dims)], "model string, revision string, dims int"))
    if found.dims != dims:
        raise ValueError(f"vectors of {model} {revision} have {found.dims} numbers, not {dims}")
    return known


def stored(vectors: DataFrame, batches: DataFrame, dims: int) -> DataFrame:
    """*vectors* (chunk_id, v) with those of *batches* (batch, chunk_id, v) in place of their own: a batch with any vector that is
    not valid is refused whole. Of several vectors for a chunk that of the highest batch counts."""
    bad = batches.where(~F.coalesce(F.expr(valid("v", dims)), F.lit(False))).select("batch").distinct()
    new = batches.join(bad, "batch", "left_anti").groupBy("chunk_id").agg(F.max_by("v", F.struct("batch", "v")).alias("v"))
    return vectors.join(new.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "v").union(new.select("chunk_id", "v"))


def rebuilt(vectors: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, relations) of the chunks that have both."""
    return vectors.join(relations.select("chunk_id"), "chunk_id", "left_semi"), relations.join(vectors.select("chunk_id"), "chunk_id", "left_semi")


def relations(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """*known* (chunk_id, content_hash) brought up to *chunks* (chunk_id, text), with stale: whether the vector of a chunk is missing
    or was made from another text. Chunks that are gone have no row."""
    now = chunks.select("chunk_id", F.sha2("text", 256).alias("content_hash"))
    return now.join(known.select("chunk_id", F.col("content_hash").alias("_known")), "chunk_id", "left").select("chunk_id", "content_hash", (~F.col("_known").eqNullSafe(F.col("content_hash"))).alias("stale"))


def embedding_input(section: str, text: str, purpose: str = "passage") -> str:
    """SQL for what a model embeds: a prefix for its purpose (passage or query), and for passages the section on its own line."""
    body = f"if({section} is null, {text}, concat({section}, '\\n', {text}))" if purpose == "passage" else text
    return f"concat('{purpose}: ', {body})"
