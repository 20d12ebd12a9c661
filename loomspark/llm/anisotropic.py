"""Nearest neighbours by inner product: score-aware anisotropic quantisation and four-bit table scans.

Vectors are cut into two-dimensional parts, each quantised to one of 16 centres (four bits).  The quantisation error
parallel to a vector costs ``eta`` times the error across it, for that is the part that moves large inner products.
Queries and vectors meet in cells of a grid, block by block: a cell scans its codes through per-query tables of two
codes to the byte, and reranks in double precision every row that quantised score and residual do not rule out.

Equal vectors are one entry with its smallest ids, as many as any result could name, so a vector that a third of the
rows share neither fills a cell nor loses a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors the centres are fitted on at most, by a hash of the id.  Every row is quantised and scanned.
SAMPLE = 4096
CENTRES, WIDTH = 16, 2
#: Rows of a cell: vectors and queries.
VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 65_536, 8192, 4096


@dataclass
class Codebook:
    dim: int
    eta: float
    centres: np.ndarray  # parts x 16 x 2

    @property
    def padded(self) -> int:
        return self.centres.shape[0] * WIDTH

    def pad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.padded))
        out[:, : x.shape[1]] = x
        return out

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x parts) by coordinate descent on the anisotropic loss, from the nearest centres."""
        parts = self.centres.shape[0]
        xs = x.reshape(len(x), parts, WIDTH)
        weigh = (self.eta - 1) / np.maximum((x * x).sum(1), 1e-30)
        codes = np.zeros((len(x), parts), np.uint8)
        along = np.zeros((len(x), parts))
        for m in range(parts):
            r = xs[:, m, None, :] - self.centres[m][None]
            codes[:, m] = (r * r).sum(2).argmin(1)
            along[:, m] = (r[np.arange(len(x)), codes[:, m]] * xs[:, m]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(parts):
                r = xs[:, m, None, :] - self.centres[m][None]
                a = (r * xs[:, m, None, :]).sum(2)
                other = total - along[:, m]
                loss = (r * r).sum(2) + weigh[:, None] * (other[:, None] + a) ** 2
                codes[:, m] = loss.argmin(1)
                along[:, m] = a[np.arange(len(x)), codes[:, m]]
                total = other + along[:, m]
        return codes


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> Codebook:
    """Centres of every part: k-means under the anisotropic loss; ``threshold`` is the score from which it counts."""
    n, dim = x.shape
    parts = 2 * -(-dim // (2 * WIDTH))  # an even number: two codes fill a byte
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    book = Codebook(dim, eta, np.zeros((parts, CENTRES, WIDTH)))
    xp = book.pad(x)
    xs = xp.reshape(n, parts, WIDTH)
    for m in range(parts):
        book.centres[m] = xs[rng.choice(n, CENTRES, replace=n < CENTRES), m]
    weigh = (eta - 1) / np.maximum((xp * xp).sum(1), 1e-30)
    for _ in range(rounds):
        codes = book.assign(xp, 1)
        r = xs - book.centres[np.arange(parts)[None], codes]
        along = (r * xs).sum(2)
        total = along.sum(1)
        for m in range(parts):
            v, other = xs[:, m], total - along[:, m]
            left = np.eye(WIDTH)[None] + weigh[:, None, None] * v[:, :, None] * v[:, None, :]
            right = v + (weigh * (other + (v * v).sum(1)))[:, None] * v
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    book.centres[m, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
    return book


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def scan(book: Codebook, packed: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the best ``k`` of ``x`` for each query, ties to the earlier row.

    The best ``depth`` by table scan give a score that the k-th best reaches at least; every row whose quantised score
    and residual do not rule that score out is then scored exactly.  So ``depth`` moves the work, never the result.
    """
    n = len(x)
    k, depth = min(k, n), min(max(depth, k), n)
    rows, scores = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    columns = [np.ascontiguousarray(packed[:, b]) for b in range(packed.shape[1])]
    along, across, norms = residuals(book, packed, x)
    lowest = along * norms / np.maximum(np.hypot(along * norms, across), 1e-300)
    qs = book.pad(queries).reshape(len(queries), -1, WIDTH)
    for i in range(len(queries)):
        q = queries[i]
        at = np.arange(n)
        if depth < n:
            tables = np.einsum("md,mcd->mc", qs[i], book.centres).astype(np.float32)
            both = (tables[1::2, :, None] + tables[0::2, None, :]).reshape(-1, 256)
            near = both[0].take(columns[0])
            for b in range(1, len(columns)):
                near += both[b].take(columns[b])
            first = np.argpartition(near, n - depth)[n - depth :]
            reached = np.partition(x[first] @ q, depth - k)[depth - k]
            # a row of cosine c has a quantised score of at least along * |q| |x| c - across * |q| sqrt(1 - c * c)
            size = np.sqrt(q @ q)
            slack = 1e-5 * float(np.abs(tables).max(1).sum()) + 1e-9 * size * norms  # rounding of the sums
            c = np.minimum(np.maximum((reached - slack) / np.maximum(size * norms, 1e-300), -lowest), 1)
            least = size * (along * norms * c - across * np.sqrt(np.maximum(0, 1 - c * c)))
            at = np.flatnonzero(~((near < least - slack) | (size * norms < reached - slack)))
        exact = x[at] @ q
        if k < len(at):
            cut = np.partition(exact, len(at) - k)[len(at) - k]
            at = at[exact >= cut - 1e-9 * max(1e-300, abs(cut), np.sqrt(q @ q) * norms[at].max())]
        exact = (x[at] * q).sum(1)  # summed in one order, so that equal scores are equal
        best = np.argsort(-exact, kind="stable")[:k]
        rows[i], scores[i] = at[best], exact[best]
    return rows, scores


def residuals(book: Codebook, packed: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its code's share along the row (1 for no parallel error), the code's length across it, its norm."""
    codes = np.empty((len(x), 2 * packed.shape[1]), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
    norms = np.sqrt((x * x).sum(1))
    code, own = book.centres[np.arange(codes.shape[1])[None], codes].reshape(len(x), -1), book.pad(x)
    along = (code * own).sum(1) / np.maximum(norms * norms, 1e-300)
    return along, np.sqrt(((code - along[:, None] * own) ** 2).sum(1)), norms


def _vectors(column) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def clean(rows: DataFrame) -> DataFrame:
    """vec_id and v (doubles), one row per id: ids and vectors that are null, zero, or hold null or non-finite
    components take no part, nor do vectors of another length than most; of equal ids the smallest vector counts."""
    v = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    own = own.where(F.size("v") == (sizes[0].n if sizes else 0))
    return own.groupBy("vec_id").agg(F.min("v").alias("v"))


def coarse_centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of ``lists`` coarse cells, by spherical k-means."""
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    centres = unit[np.random.default_rng(seed).choice(len(x), lists, replace=len(x) < lists)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        for c in range(lists):
            if (total := unit[own == c].sum(0)).any():
                centres[c] = total / np.sqrt(total @ total)
    return centres


def search(rows: DataFrame, every: int = 20, k: int = 20, depth: int = 250, lists: int = 0, probes: int = 0) -> DataFrame:
    """The ``k`` nearest of all rows for each row whose id is divisible by ``every``, without itself.

    By default every query meets every block of vectors and the result is exact; that work grows with queries times
    rows.  With ``lists`` coarse cells a query meets only the ``probes`` cells whose centres score highest for it: work
    grows with ``probes / lists`` of that, and neighbours in other cells are lost (measure the recall before use).

    query_id, rank (from 1), vec_id, score (the inner product of the original vectors in double precision); nearest
    first, ties to the smaller vec_id; all candidates where they are fewer than ``k``.  Rows that take no part: see
    ``clean``.  An empty table gives no row; repeated rows count once; other columns are ignored.
    """
    spark = rows.sparkSession
    own = written(clean(rows), spark, "vectors")
    # equal vectors: their smallest k + 1 ids are all that a result can name
    window = Window.partitionBy("v").orderBy("vec_id")
    few = own.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k + 1)
    items = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    items = written(items.withColumn("item", F.col("ids")[0]), spark, "items")
    n = items.count()
    drawn = items.where(F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / max(1, n))).select("v").limit(2 * SAMPLE).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        drawn = items.select("v").limit(SAMPLE).collect()
    if not drawn:
        return spark.createDataFrame([], result)
    book = fit(np.array([r.v for r in drawn]))
    shipped = spark.sparkContext.broadcast(book)  # 16 centres a part: bounded by the dimension
    coarse = coarse_centres(np.array([r.v for r in drawn]), lists) if lists else None
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // VECTOR_BLOCK), min(2 * cores, -(-n // LEAST_BLOCK)))
    # equal query vectors are asked once; 128 bits of hashes stand for a vector, so that no join moves it
    vector_key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("b"))
    queries = own.where(F.col("vec_id") % every == 0).withColumn("vk", vector_key)
    asked = queries.groupBy("vk").agg(F.min("vec_id").alias("query"), F.min("v").alias("v"))
    asked_n = max(1, own.where(F.col("vec_id") % every == 0).count())
    query_blocks = -(-asked_n // QUERY_BLOCK)
    if lists:  # a coarse cell's share, in blocks of its own where cells are uneven
        blocks = max(1, -(-2 * n // (lists * VECTOR_BLOCK)))

    def encode(batches):
        own_book = shipped.value
        for b in batches:
            x = _vectors(b.column(2))
            packed = pack_codes(own_book.assign(own_book.pad(x)))
            cells = (x @ coarse.T).argmax(1) if coarse is not None and len(x) else np.zeros(len(x), np.int64)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([bytes(c) for c in packed], pa.binary()), pa.array(cells, pa.int64())], names=["item", "ids", "v", "code", "list"])

    def route(batches):
        for b in batches:
            scores = _vectors(b.column(1)) @ coarse.T
            best_lists = np.argsort(-scores, 1, kind="stable")[:, : max(1, probes)]
            yield pa.record_batch([b.column(0), pa.array(list(best_lists), pa.list_(pa.int64()))], names=["query", "lists"])

    coded = items.select("item", "ids", "v").mapInArrow(encode, "item long, ids array<long>, v array<double>, code binary, list long")
    coded = coded.withColumn("vb", F.col("list") * blocks + F.pmod(F.xxhash64("item"), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    if coarse is not None:
        routed = asked.select("query", "v").mapInArrow(route, "query long, lists array<long>")
        asked = asked.join(routed, "query").withColumn("list", F.explode("lists")).drop("lists")
    else:
        asked = asked.withColumn("list", F.lit(0).cast("long"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks))).withColumn("vb", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.col("list") * blocks + i)))
    found_schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_schema.empty_table()
        left = left.sort_by("item")  # ties go to the smaller id
        x, q = _vectors(left["v"]), _vectors(right["v"])
        packed = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        ids, asked_ids = left["ids"].to_pylist(), right["query"].to_pylist()
        found, scores = scan(shipped.value, packed, x, q, k + 1, depth)
        out = []
        for i, (rows_, own_scores) in enumerate(zip(found.tolist(), scores.tolist())):
            pairs = [(-s, d) for r, s in zip(rows_, own_scores) for d in ids[r]]
            out += [(asked_ids[i], d, -s) for s, d in sorted(pairs)[: k + 1]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), found_schema.types)], schema=found_schema)

    met = coded.groupBy("vb", "qb").cogroup(asked.select("query", "v", "qb", "vb").groupBy("vb", "qb")).applyInArrow(cell, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    # one short list for each different query vector meets all rows that ask it
    lists = lists.join(asked.select("query", "vk").distinct(), "query").select("vk", "near")
    joined = queries.select(F.col("vec_id").alias("query_id"), "vk").join(lists, "vk")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(kept).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
