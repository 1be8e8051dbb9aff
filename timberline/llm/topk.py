"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. Candidates are packed into blocks of ``candidate_rows``, queries into blocks of
``query_rows``. Every query block meets every candidate block: candidate blocks are dealt to groups, a few times as many
as tasks run at once, and a join by query block and group brings them together, so that nothing passes through the driver
and nothing is broadcast. Where two blocks meet, the candidates are postings by term (dimension): which of them have a
non-zero weight there, and the weights. The queries' non-zero weights are scattered term by term into dense arrays of
scores, one row a query, and partition selection takes each query's best of the block. A task keeps the best of the blocks
it has seen; a query's best of all tasks are merged by rank.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; a query never meets
its own row, where a row is known by its id (repeated ids are one vector each, and none of them meets the query of that
id); vectors of other lengths than the query's are compared over the terms that both have; ties go to the smaller id;
weights beyond 2**62 are held there and sums wrap around as 64-bit numbers do; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm._shared import bound_batches, spill, tidy

SCHEMA = "query_id long, vec_id long, score long"
BLOCK_SCHEMA = "cell long, ids binary, kind string, weights binary"
# Queries scored at a time, and query blocks whose best a task holds.
LANES, HELD = 32, 64


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, w: floor(scale * x) of each component; only vectors that take part."""
    x = F.col("v")
    fine = F.size(x).__gt__(0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    limit = float(1 << 62)
    return raw.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        "vec_id", F.transform(x, lambda e: F.greatest(F.least(F.floor(e * F.lit(float(scale))).cast("double"), F.lit(limit)), F.lit(-limit)).cast("long")).alias("w")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    out = np.zeros((len(size), size.max(initial=0)), np.int64)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _pack(rows: int, groups: int | None = None):
    """Blocks of vectors in the narrowest type that holds them. groups: blocks are dealt out to them, whatever their cell."""

    def block(cell: int, parts: list):
        ids = np.concatenate([i for i, _ in parts])
        out = np.zeros((len(ids), max(w.shape[1] for _, w in parts)), np.int64)
        at = 0
        for i, w in parts:
            out[at : at + len(i), : w.shape[1]] = w
            at += len(i)
        kind = next(t for t in ("i2", "i4", "i8") if t == "i8" or np.abs(out.astype(float)).max(initial=0) < 2 ** (8 * int(t[1]) - 1))
        return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([kind]), pa.array([out.astype(f"<{kind}").tobytes()], pa.binary())], ["cell", "ids", "kind", "weights"])

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() if groups else 0
        for batch in batches:
            cells, ids, weights = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("w"))
            for cell in np.unique(cells):
                mine = np.flatnonzero(cells == cell)
                for a in range(0, len(mine), rows):
                    part = mine[a : a + rows]
                    parts = held.setdefault(int(cell), [])
                    if parts and sum(len(i) for i, _ in parts) + len(part) > rows:
                        yield block(number % groups if groups else int(cell), parts)
                        held[int(cell)], number = [], number + 1
                    held[int(cell)].append((ids[part], weights[part]))
        for cell, parts in held.items():
            yield block(number % groups if groups else cell, parts)
            number += 1

    return run


def _unpack(ids: pa.Scalar, kind: str, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), "<i8")
    return ids, np.frombuffer(weights.as_buffer(), f"<{kind}").reshape(len(ids), -1)


def _narrow(weights: np.ndarray, other: np.ndarray) -> type:
    """The quickest type whose sums are exact: 32-bit floats hold integers up to 2**24."""
    bound = float(np.abs(weights.astype(float)).max(initial=0)) * float(np.abs(other.astype(float)).max(initial=0)) * max(1, weights.shape[1])
    return np.float32 if bound < 2**24 else np.int32 if bound < 2**31 - 1 else np.int64


def best_of_block(query_ids, queries, ids, block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best of a block of candidates."""
    order = np.argsort(ids, kind="stable")
    ids, block = ids[order], block[order]
    kind = _narrow(queries, block)
    terms = min(queries.shape[1], block.shape[1])
    postings = []
    for t in range(terms):
        at = np.flatnonzero(block[:, t])
        # a posting list that holds a quarter of the block or more is kept with its zeros: adding them is quicker than choosing
        postings.append((None, np.ascontiguousarray(block[:, t], kind)) if 4 * len(at) >= len(ids) else (at, block[at, t].astype(kind)))
    out: list[tuple] = []
    spare = np.empty((LANES, len(ids)), kind)
    for a in range(0, len(queries), LANES):
        some = queries[a : a + LANES].astype(kind)
        scores = np.zeros((len(some), len(ids)), kind)
        for t, (at, weight) in enumerate(postings):
            live = np.flatnonzero(some[:, t])
            if at is None and 4 * len(live) >= len(some):
                np.multiply(some[:, t, None], weight, out=spare[: len(some)])
                scores += spare[: len(some)]
            elif at is None:
                scores[live] += some[live, t, None] * weight
            elif len(at) and len(live):
                scores[np.ix_(live, at)] += some[live, t, None] * weight
        for row, own in zip(scores, query_ids[a : a + LANES]):
            use = np.flatnonzero(ids != own)
            s = row[use]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                chosen = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
                use, s = use[chosen], s[chosen]
            out.append((np.full(len(use), own), ids[use], s.astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(
    df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    query_rows: int = 2048, candidate_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of df with the highest scores for each row of queries."""
    spark = df.sparkSession
    bound_batches(spark)
    asked = spill(quantise(queries, id_col, vector_col, scale).dropDuplicates(["vec_id", "w"]), "asked")
    blocks = max(1, -(-asked.count() // query_rows))
    groups = -(-2 * spark.sparkContext.defaultParallelism // blocks)
    asked = asked.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).select("cell", "vec_id", "w")
    asked = asked.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_pack(query_rows)), BLOCK_SCHEMA)
    asked = asked.select(F.col("cell").alias("q"), F.col("ids").alias("query_ids"), F.col("kind").alias("query_kind"), F.col("weights").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    held = quantise(df, id_col, vector_col, scale).select(F.lit(0).cast("long").alias("cell"), "vec_id", "w").mapInArrow(tidy(_pack(candidate_rows, groups)), BLOCK_SCHEMA)
    held = held.select(F.col("cell").alias("g"), "ids", "kind", "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("q"))
    found = held.join(asked, ["q", "g"]).mapInArrow(tidy(_searcher(k)), SCHEMA)
    # k rows a query and task
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(best, new, k: int):
    """The k best of each query so far: one sort of what is held."""
    q, v, s = (np.concatenate(c) for c in zip(best, new)) if best is not None else new
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], v[keep], s[keep]


def _searcher(k: int):
    def run(batches):
        best: dict[int, tuple] = {}

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                q = batch.column("q")[r].as_py()
                asked = _unpack(batch.column("query_ids")[r], batch.column("query_kind")[r].as_py(), batch.column("queries")[r])
                held = _unpack(batch.column("ids")[r], batch.column("kind")[r].as_py(), batch.column("weights")[r])
                best[q] = _merged(best.pop(q, None), best_of_block(*asked, *held, k), k)
                if len(best) > HELD:  # the query block seen longest ago; if it comes again, the merge by rank sees to it
                    yield out(best.pop(next(iter(best))))
        for found in best.values():
            if len(found[0]):
                yield out(found)

    return run
