"""Approximate nearest neighbours with score-aware (anisotropic) four-bit product quantisation.

Squared distance is |q|^2 - 2 q.x + |x|^2. The norms are kept exactly; the inner product is searched
as maximum inner product over quantised vectors. Codebooks (16 centroids for each pair of
dimensions) minimise a loss that weighs the part of the residual parallel to the vector more than
the rest, eta = (d - 1) T^2 / (1 - T^2) times, because that part moves the large inner products.
They are fitted on a bounded sample; every valid row is encoded, two codes to a byte.

Codes are of vectors less the sample's mean, in units of its largest component, so that an offset or a
scale that all share costs no precision.

Search: queries and rows are packed into blocks. For each pair of a query block and a row block a
table of 256 scores per two subspaces is added up along the codes, and the best ``RERANK`` rows of the
block for each query are measured exactly in double precision. The k-th of those distances is a bound:
a row whose distance to the query, by its codes, exceeds it by more than the row's own quantisation error is
out for sure. What the codes can't rule out (rows in tight clusters, unlike the sample, with equal codes) is
measured too, so a block's best ``k`` rows are its true ones whatever the vectors are.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; rows that repeat an id are candidates each, and a query id is
asked once, with its smallest vector; ties go to the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _shared

CENTROIDS, WIDTH, THRESHOLD = 16, 2, 0.2
#: Rows that the codebooks are fitted on, at most.
FIT_ROWS = 10_000
RERANK, ROW_BLOCK, QUERY_BLOCK = 100, 8192, 512
#: Pairs of a query and a row that are measured at once.
_PAIRS = 1 << 20
#: Packed queries are broadcast up to this size, else joined block by block.
BROADCAST_BYTES = 64 << 20


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, subspaces) by coordinate descent on the anisotropic loss."""
    x = _pad(x)
    n, m = len(x), len(books)
    parts = x.reshape(n, m, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(n, m, WIDTH)
    codes = np.stack([((parts[:, j, None] - books[j][None]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    rest = parts - books[np.arange(m), codes]
    along = (rest * unit).sum((1, 2))
    for _ in range(rounds):
        for j in range(m):
            own = (rest[:, j] * unit[:, j]).sum(1)
            r = parts[:, j, None] - books[j][None]
            loss = (r**2).sum(2) + (weight - 1) * ((along - own)[:, None] + (r * unit[:, j, None]).sum(2)) ** 2
            codes[:, j] = loss.argmin(1)
            rest[:, j] = parts[:, j] - books[j][codes[:, j]]
            along += (rest[:, j] * unit[:, j]).sum(1) - own
    return codes.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces, 16, WIDTH): alternate codes and weighted least squares."""
    weight, x = eta(x.shape[1]), _pad(x)
    n, m = len(x), x.shape[1] // WIDTH
    parts = x.reshape(n, m, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(n, m, WIDTH)
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.choice(n, CENTROIDS, n < CENTROIDS), j] for j in range(m)])
    for _ in range(8):  # plain k-means to begin with
        for j in range(m):
            code = ((parts[:, j, None] - books[j][None]) ** 2).sum(2).argmin(1)
            for c in np.unique(code):
                books[j, c] = parts[code == c, j].mean(0)
    for _ in range(rounds):
        codes = encode(x, books, weight, 1)
        rest = parts - books[np.arange(m), codes]
        along = (rest * unit).sum((1, 2))
        for j in range(m):
            own = (rest[:, j] * unit[:, j]).sum(1)
            u, a = unit[:, j], parts[:, j]
            outer = np.eye(WIDTH)[None] + (weight - 1) * u[:, :, None] * u[:, None, :]
            right = a + (weight - 1) * u * ((along - own) + (a * u).sum(1))[:, None]
            for c in np.unique(codes[:, j]):
                sel = codes[:, j] == c
                books[j, c] = np.linalg.solve(outer[sel].sum(0), right[sel].sum(0))
            rest[:, j] = a - books[j][codes[:, j]]
            along += (rest[:, j] * u).sum(1) - own
    return books


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _pack_rows(dim: int, index, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def flush():
            nonlocal ids, vectors, held
            i, x = np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [], [], 0
            order = np.argsort(i, kind="stable")
            i, x = i[order], x[order]
            for a in range(0, len(i), rows):
                part = x[a : a + rows]
                body = b""
                if index is not None:
                    books, centre, unit = index.value
                    codes = encode((part - centre) / unit, books, eta(dim))
                    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                    body = (codes[:, ::2] | (codes[:, 1::2] << 4)).tobytes()
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(part)], pa.int32()), "ids": pa.array([i[a : a + rows].tobytes()], pa.binary()), "vectors": pa.array([part.tobytes()], pa.binary()), "codes": pa.array([body], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vectors.append(_matrix(batch.column(1), dim))
                held += batch.num_rows
            if held >= rows:
                yield from flush()
        if held:
            yield from flush()

    return run


def _nearest(x: np.ndarray, ids: np.ndarray, packed: np.ndarray, q: np.ndarray, asked: np.ndarray, index: tuple, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """(query, row, distance) by number: for each query its ``k`` nearest rows of a block, those with its own id left out."""
    books, centre, unit = index
    m, n = len(books), len(x)
    xc, qc = _pad((x - centre) / unit), _pad((q - centre) / unit)
    codes = np.empty((packed.shape[1] * 2, n), np.uint8)
    codes[::2], codes[1::2] = packed.T & 15, packed.T >> 4
    coded = np.concatenate([books[j][codes[j]] for j in range(m)], 1)
    norms, sizes, q_sizes = (xc**2).sum(1), (coded**2).sum(1), (qc**2).sum(1)
    tables = -2 * np.einsum("qmw,mcw->mqc", qc.reshape(len(q), m, WIDTH), books).astype(np.float32)
    near = np.repeat(norms[None].astype(np.float32), len(q), 0)
    for j in range(0, m, 2):  # one byte holds two codes
        pair = tables[j][:, None, :] + (tables[j + 1][:, :, None] if j + 1 < m else np.zeros((len(q), CENTROIDS, 1), np.float32))
        near += np.take(pair.reshape(len(q), -1), packed[:, j // 2], axis=1)
    own = asked[:, None] == ids[None]
    near[own | np.isnan(near)] = np.inf

    def measure(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(i.shape)
        for d in range(x.shape[1]):  # added in order of dimension
            total += (x[j, d] - q[i, d]) ** 2
        return np.sqrt(total)

    first = np.argpartition(near, rerank - 1, axis=1)[:, :rerank] if n > rerank else np.repeat(np.arange(n)[None], len(q), 0)
    each = np.arange(len(q))[:, None]
    exact = measure(np.broadcast_to(each, first.shape), first)
    exact[own[each, first]] = np.inf
    kth = np.partition(exact, k - 1, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(len(q), np.inf)
    # rounding: of the centred vectors, of the single-precision sums, of the expanded square
    slip = 4e-15 * (np.abs(x).max() + np.abs(q).max()) * x.shape[1] / unit
    reach = kth / unit * (1 + 1e-12) + slip
    error = np.sqrt(((xc - coded) ** 2).sum(1))
    loose = 1e-5 * (q_sizes.max() + max(norms.max(), sizes.max()))
    bound = (reach[:, None] + error[None]) ** 2 + loose
    by_code = near + q_sizes[:, None] + (sizes - norms)[None]
    left = ~(np.isfinite(by_code) & (by_code > bound)) & ~own
    rows = np.flatnonzero(left.any(0))
    square = norms[rows][None] + q_sizes[:, None] - 2 * (qc @ xc[rows].T)
    margin = 1e-12 * (norms.max() + q_sizes.max())
    left, square = left[:, rows], np.where(np.isfinite(square), square, 0)
    most = reach**2 + margin
    if len(rows) > k:
        far = np.where(left, square, np.inf)
        most = np.minimum(most, (np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1] + margin, 0)) + 2 * slip) ** 2 + margin)
    i, j = np.nonzero(left & ~(square > most[:, None]))
    j = rows[j]
    exact = np.concatenate([measure(i[a : a + _PAIRS], j[a : a + _PAIRS]) for a in range(0, len(i), _PAIRS)] or [np.zeros(0)])
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], exact[top]


def _scan(dim: int, index, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                packed = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                asked, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    i, j, exact = _nearest(x, ids, packed, q, asked, index.value, k, rerank)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(exact)], ["query_id", "vec_id", "score"])

    return run


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector can take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return own.where("id is not null and v is not null").where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))


_PACKED = "n int, ids binary, vectors binary, codes binary"


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest rows by Euclidean distance
    but the rows with its own id, the nearest first. ``queries`` has the columns of ``rows``."""
    spark = rows.sparkSession
    kind = "query_id long, vec_id long, score double"
    points = valid(rows, id_col, vector_col)
    sample = [r[1] for r in sorted(map(tuple, _shared.bounded_sample(points, fit_rows, "id").collect()))]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    known = np.array([v for v in sample if len(v) == dim], np.float64)
    unit = float(np.abs(known).max())
    centre = (known / unit).mean(0) * unit
    unit = float(np.abs(known - centre).max()) or unit
    fitted = spark.sparkContext.broadcast((fit((known - centre) / unit), centre, unit))
    points = points.where(F.size("v") == dim)
    asked = valid(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    blocks = _shared.keep(asked.mapInArrow(_pack_rows(dim, None, QUERY_BLOCK), _PACKED), "queries")
    blocks = blocks.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    size = blocks.agg(F.coalesce(F.sum(F.length("q_vectors")), F.lit(0))).first()[0]
    blocks = blocks.repartition(max(1, size // (QUERY_BLOCK * dim * 8)))
    index = _shared.keep(points.mapInArrow(_pack_rows(dim, fitted, ROW_BLOCK), _PACKED), "index")
    pairs = index.crossJoin(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks)
    found = pairs.mapInArrow(_scan(dim, fitted, k, rerank), kind)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return _shared.keep(best, "nearest", *_shared.paths(index, blocks))


def op5_anisotropic_index(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))


#: Exact neighbours: equal to the index's results where its recall is 1, as on tables of few rows a block.
OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, e, len(e) AS d FROM v
       WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
most AS (SELECT d FROM ok GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1),
p AS (SELECT vec_id, e FROM ok JOIN most USING (d)),
q AS (SELECT vec_id AS query_id, min(e) AS qe FROM p WHERE vec_id % 100 = 0 GROUP BY vec_id),
pair AS (SELECT query_id, vec_id, sqrt(list_reduce(list_transform(range(1, len(e) + 1), lambda i: (e[i] - qe[i]) * (e[i] - qe[i])), lambda a, b: a + b)) AS score FROM q JOIN p ON p.vec_id <> q.query_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pair)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
