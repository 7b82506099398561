"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed byte n-grams; each language has several centroids, found
by spherical k-means over a bounded sample; the nearest centroid by cosine decides, and texts farther from it
than its training texts are marked as rejected. Texts are counted in Arrow batches with array arithmetic.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of the hashed n-grams, lengths of the n-grams in bytes, centroids per language.
DIMS, SIZES, CENTROIDS = 8192, (2, 3), 3
#: Labelled texts that the centroids are fitted on: this many different ones in all, shared equally, but at least
#: SAMPLE_LEAST of each language. Document frequencies count all labelled rows. The driver gets the counts of these texts,
#: made by the executors: at most DIMS * 6 bytes a text, so 200 MB for up to 100 languages, however long the texts are.
SAMPLE, SAMPLE_LEAST = 4000, 40
#: A text is rejected below this quantile of the cosines that a centroid's own training texts have, less MARGIN.
QUANTILE, MARGIN = 0.01, 0.1
#: Bytes and texts that are counted at a time.
PIECE, ROWS = 1 << 22, 256


class Model(NamedTuple):
    languages: list  # of each centroid
    centroids: object  # DIMS x number of centroids
    idf: object
    least: object  # cosine under which a text is rejected, of each centroid


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id's text, modulo 4, is 2. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _plain():
    import numpy as np

    low = np.full(256, 32, np.uint8)
    low[128:] = np.arange(128, 256)
    for c in range(97, 123):
        low[c] = low[c - 32] = c
    return low


def counts(texts: list[bytes]):
    """n-gram counts, len(texts) x DIMS. ASCII letters are lower-cased, other ASCII is a space, and a
    text begins and ends with one."""
    import numpy as np

    low, out, k = _plain(), np.zeros((len(texts), DIMS), np.float32), 0
    while k < len(texts):
        group, size = [], 0
        while k + len(group) < len(texts) and (not group or size + len(texts[k + len(group)]) <= PIECE):
            group.append(texts[k + len(group)])
            size += len(group[-1]) + 2
        for at in range(0, max(map(len, group)) or 1, PIECE):  # a text beyond PIECE stands alone, and goes piece by piece
            parts = [b" " + g[at : at + PIECE + (2 if at + PIECE < len(g) else 0)] + b" " for g in group]
            data = low[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
            row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            total = np.zeros(len(parts) * DIMS, np.int64)
            for n in SIZES:
                if len(data) >= n:
                    m = len(data) - n + 1
                    code = np.full(m, n, np.uint32)
                    for j in range(n):
                        code = (code << np.uint32(8)) | data[j : j + m]
                    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(19)
                    inside = row[:m] == row[n - 1 :]
                    total += np.bincount(row[:m][inside] * DIMS + bucket[inside], minlength=len(total))
            out[k : k + len(group)] += total.reshape(len(parts), DIMS)
        k += len(group)
    return out


def weighted(c, idf):
    """Normalised TF-IDF vectors of counts, TF as 1 + log."""
    import numpy as np

    v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(data: bytes | None) -> bool:
    if not data:
        return False
    if any(97 <= b <= 122 for b in data[:64].lower()):
        return True
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


def clustered(v, k: int, rounds: int = 10):
    """At most *k* centroids of unit vectors; begins with the vectors farthest from one another."""
    import numpy as np

    chosen = [v.mean(axis=0)]
    while len(chosen) < min(k, len(v)):
        chosen.append(v[np.argmin((v @ np.array(chosen).T).max(axis=1))])
    c = np.array(chosen)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(v @ c.T, axis=1)
        c = np.array([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def sampled(t: DataFrame, languages: int) -> DataFrame:
    """Rows (lang, h, t) of the different texts with the smallest hashes of each language, of rows (lang, t, h).

    A bound on the hash, from the number of different texts of a language, lets about twice as many through as are
    wanted, so what is ranked is small whatever share of the rows a language or a text has.
    """
    most = max(SAMPLE_LEAST, SAMPLE // languages)
    kinds = t.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    limits = kinds.select(F.col("lang").alias("name"), F.expr(f"if(n <= {2 * most}, {2**63 - 1}L, cast({-(2**63)}D + {2 * most} / cast(n as double) * {2**64}D as bigint))").alias("top"))
    few = t.join(F.broadcast(limits) if languages <= 10_000 else limits, F.expr("lang = name and h <= top"))
    few = few.groupBy("lang", "h").agg(F.first("t").alias("t"))
    return few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most).select("lang", "h", "t")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model | None:
    """A model from the rows of *df* with a language that are not held out; None if there are none."""
    import numpy as np

    t = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col))
    t = t.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(text).cast("binary")).alias("h"))

    def frequencies(batches):
        import pyarrow as pa

        n, total = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                texts = b.column(0).slice(k, ROWS).to_pylist()
                n += (counts(texts) > 0).sum(axis=0)
                total += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array([total, *n], pa.int64())], ["dim", "n"])

    seen = {r.dim: r.n for r in t.select("t").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = seen.get(-1, 0)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + np.array([seen.get(k, 0) for k in range(DIMS)]))).astype(np.float32) + 1

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                c = counts(part.column(2).to_pylist())
                at = [np.flatnonzero(x) for x in c]
                dims = pa.array([x.astype(np.int16) for x in at], pa.list_(pa.int16()))
                values = pa.array([x[i] for x, i in zip(c, at, strict=True)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), dims, values], ["lang", "h", "dims", "n"])

    sample = sampled(t, t.select("lang").distinct().count()).mapInArrow(counted, "lang string, h long, dims array<short>, n array<float>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    names, cents, least, of = [], [], [], np.array(sample["lang"].to_pylist())
    for name in sorted(set(of.tolist())):
        c = np.zeros((int((of == name).sum()), DIMS), np.float32)
        for row, k in zip(c, np.flatnonzero(of == name), strict=True):
            row[sample["dims"][int(k)].values.to_numpy()] = sample["n"][int(k)].values.to_numpy()
        v = weighted(c, idf)
        c = clustered(v, CENTROIDS)
        cosine = v @ c.T
        for j in range(len(c)):
            own = cosine[np.argmax(cosine, axis=1) == j, j]
            names.append(name)
            cents.append(c[j])
            least.append((np.quantile(own, QUANTILE) if len(own) else 0) - MARGIN)
    return Model(names, np.array(cents, np.float32).T, idf, np.array(least))


def predict(df: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, lang_pred, score, rejected) for each row of *df*; nothing but the text is an input.

    lang_pred is the language of the nearest centroid, or ``und`` with score 0 for a null text, a text without
    a letter, and everything if there was nothing to learn from. score: the cosine, 0 to 1. rejected: ``und``,
    or farther from the centroid than its training texts. Of equally near centroids the first by name
    counts. Repeated rows get equal results; an empty table gives no rows; other columns are not read. Long texts
    are counted whole, PIECE bytes at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                texts = part.column(1).to_pylist()
                known = [model is not None and has_letter(x) for x in texts]
                names, scores, off = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if any(known):
                    cosine = weighted(counts([x or b"" for x in texts]), model.idf) @ model.centroids
                    best = np.argmax(cosine, axis=1)
                    top = cosine[np.arange(len(texts)), best]
                    for j in np.flatnonzero(known):
                        names[j], scores[j], off[j] = model.languages[best[j]], min(1.0, max(0.0, float(top[j]))), top[j] < model.least[best[j]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores), pa.array(off)], ["id", "lang_pred", "score", "rejected"])

    t = df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t"))
    return t.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
