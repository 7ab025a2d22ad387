"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, fitted on a bounded sample; a pair of codes is a cell. A query
orders cells by the sum of its distances to the two centroids with a heap and visits them until the visited cells hold
`depth` entries; visited entries are reranked by their true distance. `depth` is not a constant: a few calibration
vectors are compared with all entries, and the depth is taken at which a share `target` of their true neighbours has
been visited.

Cells are packed into chunks of about `chunk_rows` entries; a cell with more is split over several chunks. Queries are
put into blocks of near ones. Only pairs of a chunk and a block that visits it meet, each in its own small task.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, nor do null ids; rows with equal id and vector count once; of equal vectors only the k + 1 smallest ids
can be among the k nearest, so only these are entries; a query that is a further copy is answered by the k smallest of
them, at distance 0, without a search; a query with fewer than k candidates gets them all; ties go to the smaller id; no
valid vector gives an empty table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import share, shared, small


def valid(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0)).where(~F.exists("v", F.isnan))


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.Array):
        n = len(column)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, by one matrix product."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def visit(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, depth: int) -> tuple[list[int], float]:
    """Cells in the order of d1[i] + d2[j] until they hold `depth` entries, and the last sum."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2, width = d1[o1].tolist(), d2[o2].tolist(), len(o2)
    heap, cells, held, last = [(s1[0] + s2[0], 0, 0)], [], 0, -1.0
    while heap and held < depth:
        last, a, b = heapq.heappop(heap)
        # (a, b) is reached from (a, b - 1), and the first of a row from the row before
        if b + 1 < width:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(o1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        n = counts[o1[a] * width + o2[b]]
        if n:
            cells.append(o1[a] * width + o2[b])
            held += int(n)
    return cells, last


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, seen: np.ndarray | None, k: int):
    """Per query the k nearest visited entries but its own: query numbers, entry numbers, distances."""
    approx = squares(q, x)
    if seen is not None:
        approx[~seen] = np.inf
    approx[qid[:, None] == xid[None]] = np.inf
    out = [], [], []
    for r in range(len(q)):
        row = approx[r]
        near = np.flatnonzero(row < np.inf)
        if len(near) > k:
            near = near[row[near] <= np.partition(row[near], k - 1)[k - 1] + 1e-9 * (1 + (q[r] ** 2).sum())]
        d = np.sqrt(((x[near] - q[r]) ** 2).sum(1))
        order = np.lexsort((xid[near], d))[:k]
        out[0].append(np.full(len(order), r))
        out[1].append(near[order])
        out[2].append(d[order])
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (int, int, float), strict=True))


def best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def of_copies(rows: DataFrame, entries: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, vec_id, score for the queries among `rows` that are no entries, as k + 1 smaller ids have their vector."""
    name = [F.xxhash64("v").alias("_h1"), F.xxhash64(F.lit("second"), "v").alias("_h2")]
    full = entries.select("vec_id", *name).groupBy("_h1", "_h2").agg(F.array_sort(F.collect_list("vec_id")).alias("_ids"))
    full = materialize(full.where(F.size("_ids") == k + 1), "ann-full")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), *name).distinct()
    lost = queries.join(small(full, 100_000), ["_h1", "_h2"]).where(F.col("query_id") > F.element_at("_ids", -1))
    return lost.select("query_id", F.explode(F.slice("_ids", 1, k)).alias("vec_id"), F.lit(0.0).alias("score"))


def search(
    df: DataFrame,
    ident: str,
    vector: str,
    is_query: Column,
    k: int = 10,
    sample_rows: int = 16_384,
    calibration_rows: int = 48,
    target: float = 0.97,
    chunk_rows: int = 4096,
    block_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of which `is_query` (of vec_id) holds."""
    with scratch(df.sparkSession) as keep:
        sizes = (k, sample_rows, calibration_rows, target, chunk_rows, block_rows)
        return keep(_search(df, ident, vector, is_query, *sizes), "nearest")


def _search(
    df: DataFrame, ident: str, vector: str, is_query: Column, k: int, sample_rows: int, calibration_rows: int,
    target: float, chunk_rows: int, block_rows: int,
) -> DataFrame:
    spark = df.sparkSession
    rows = materialize(valid(df, ident, vector), "ann-valid")
    copies = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = rows.dropDuplicates(["vec_id", "v"]).withColumn("_c", copies).where(F.col("_c") <= k + 1).drop("_c")
    entries = materialize(entries, "ann-entries")
    n = entries.count()
    result = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], result)

    # codebooks from a bounded sample
    picked = entries.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).toArrow()
    sample, ids = matrix(picked["v"].combine_chunks()), picked["vec_id"].to_numpy()
    half, codes = sample.shape[1] // 2, int(min(512, max(2, round(math.sqrt(n) / 2))))
    books = [codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)]
    width = len(books[1])
    shared_books = share(spark, (books, half))

    def encode(it):
        (b1, b2), half = shared(shared_books)
        for batch in it:
            x = matrix(batch.column("v"))
            cell = squares(x[:, :half], b1).argmin(1) * len(b2) + squares(x[:, half:], b2).argmin(1) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    index = materialize(entries.mapInArrow(encode, "vec_id long, v array<double>, cell long"), "ann-index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    held = index.groupBy("cell").count().toArrow()  # at most codes ** 2 rows
    counts[held["cell"].to_numpy()] = held["count"].to_numpy()

    # how many entries must be visited to meet the true neighbours
    probe, probe_ids = sample[:calibration_rows], ids[:calibration_rows]
    shared_probe = share(spark, (probe, probe_ids))

    def exact(it):
        q, qid = shared(shared_probe)
        for batch in it:
            x, xid, cell = matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            if len(x):
                a, b, d = nearest(q, qid, x, xid, None, k)
                cols = [pa.array(qid[a]), pa.array(xid[b]), pa.array(d), pa.array(cell[b])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score", "cell"])

    true = best(index.mapInArrow(exact, "query_id long, vec_id long, score double, cell long"), k).toArrow()
    row = {int(x): r for r, x in enumerate(probe_ids)}
    d1, d2 = squares(probe[:, :half], books[0]), squares(probe[:, half:], books[1])
    need = []
    for q in set(true["query_id"].to_pylist()):
        sums = (d1[row[q]][:, None] + d2[row[q]][None]).ravel()
        order = np.argsort(sums)
        upto = np.cumsum(counts[order])
        cells = true["cell"].to_numpy()[true["query_id"].to_numpy() == q]
        need += upto[np.searchsorted(sums[order], sums[cells], side="right") - 1].tolist()
    depth = max(int(np.quantile(need, target)) if need else n, min(n, 10 * k))

    # chunks of cells in code order; a cell over the size has chunks of its own
    before = np.cumsum(counts) - counts
    parts = np.maximum(1, -(-counts // chunk_rows))
    shared_cells = share(spark, (counts, before, parts, depth))
    n_blocks = max(1, math.ceil(index.where(is_query).count() / block_rows))

    def place(it):
        """Chunk of each entry."""
        counts, before, parts, _ = shared(shared_cells)
        for batch in it:
            cell, i = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy().astype(np.uint64)
            salt = ((i * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[cell]
            cols = [*batch.columns, pa.array(before[cell] // chunk_rows), pa.array(salt)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "cell", "chunk", "salt"])

    def ask(it):
        """The chunks that each query visits, and its last sum."""
        (b1, b2), half = shared(shared_books)
        counts, before, parts, depth = shared(shared_cells)
        total = int(counts.sum())
        for batch in it:
            x, xid, own = matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            if not len(x):
                continue
            d1, d2 = squares(x[:, :half], b1), squares(x[:, half:], b2)
            u = ((xid.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(float) / (1 << 24)
            block = np.minimum(n_blocks - 1, (n_blocks * (before[own] + u * counts[own]) / total).astype(np.int64))
            who, where, salt, last = [], [], [], []
            for r in range(len(x)):
                cells, end = visit(d1[r], d2[r], counts, depth)
                cells = np.array(cells)
                pairs = {(int(c), s) for c, p in set(zip((before[cells] // chunk_rows).tolist(), parts[cells].tolist())) for s in range(p)}
                who += [r] * len(pairs)
                where += [c for c, _ in pairs]
                salt += [s for _, s in pairs]
                last += [end] * len(pairs)
            who = np.array(who, np.int64)
            cols = [pa.array(xid[who]), batch.column("v").take(pa.array(who)), pa.array(last, pa.float64())]
            cols += [pa.array(where, pa.int64()), pa.array(salt, pa.int64()), pa.array(block[who])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "v", "last", "chunk", "salt", "block"])

    asked = index.where(is_query).mapInArrow(
        ask, "query_id long, v array<double>, last double, chunk long, salt long, block long"
    )
    asked = materialize(asked, "ann-asked")
    met = asked.select("chunk", "salt", F.col("block").alias("_block")).distinct()
    placed = index.mapInArrow(place, "vec_id long, v array<double>, cell long, chunk long, salt long")
    placed = placed.join(met, ["chunk", "salt"])

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (b1, b2), half = shared(shared_books)
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x, cell = matrix(left["v"]), matrix(right["v"]), right["cell"].to_numpy()
        sums = squares(q[:, :half], b1)[:, cell // len(b2)] + squares(q[:, half:], b2)[:, cell % len(b2)]
        seen = sums <= left["last"].to_numpy()[:, None] * (1 + 1e-9)
        qid, xid = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        a, b, d = nearest(q, qid, x, xid, seen, k)
        return pd.DataFrame({"query_id": qid[a], "vec_id": xid[b], "score": d})

    left, right = asked.groupBy("chunk", "salt", "block"), placed.groupBy("chunk", "salt", "_block")
    found = left.cogroup(right).applyInPandas(rerank, "query_id long, vec_id long, score double")
    found = found.unionByName(of_copies(rows, entries, is_query, k))
    return best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
