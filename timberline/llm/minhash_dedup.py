"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A document is its set of five-word shingles, each weighted by (1 + ln tf) * idf. With p the share of all documents that
have the shingle, idf = ln(1 + 1 / (p + smooth)), over its value at p = 0: smooth, for every shingle, and by shares
alone, so that a table and its tenfold have equal weights. ``smooth`` bounds how much rarer is heavier: in the plain
ln(1 + N / df) a family of copies loses weight for being copied, until its members are no longer alike (README has
figures). Shares come from a count-min sketch over all documents, of fixed size: each task counts its documents, blocks
of counters are added by key. A count is exact but for collisions, which add about (shingles a document) / 2**19 to p.
Weights are held on a grid of 2 %, so that shingles in few documents weigh exactly 1.

Steps:

1. Each document gets ``bands * rows`` consistent weighted samples (the chance that two documents agree on one is their
   weighted Jaccard similarity). Equal texts are joined by digest; only one text of each goes on.
2. Texts that agree on all samples of a band share a bucket. Each text is verified against its bucket's first text: the
   weighted Jaccard similarity of the whole texts, from all their shingles, must reach ``threshold``.
3. Connected components are found by alternating large-star and small-star steps.
4. A bucket whose texts are still in several components is taken up again: its texts outside the largest component meet
   all its texts, in blocks of bounded size. Pairs of different components whose share of equal samples is at least
   ``sample_floor`` (5.5 standard deviations below the threshold), and that share no earlier band, are candidates. Blocks
   first hold samples alone; only texts that are in a candidate pair go on to blocks with texts, where candidates are
   verified as in step 2, of each text and component the likeliest first, until the two are linked or all their pairs are
   done. Then components are found anew. So a link within a bucket is either verified, or lies within a component, or its
   samples rule it out; no bucket is capped, and no pair leaves a block but a verified link. What remains is the square of
   the texts of a bucket that are nearly, but not quite, alike: their samples, and what may be a link, are all compared.

Defined results: a null text counts as empty; all texts without a word that are equal are one class, as equal texts are;
rows that repeat an id and a text are one document; a row with a null id has a null class; an empty table gives no rows.
Of an id with several texts, each text is compared and the id gets the smallest class of them (keep_one tells them apart).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm._shared import HASH_BITS, bound_batches, chunks, drop, join_unique, mix, shingles, spill, text_buffer, tidy

WIDTH = 5
# Rows of a block of samples, and of texts, which are about BLOCK_BYTES long together.
SAMPLE_BLOCK, TEXT_BLOCK = 1024, 128
BLOCK_BYTES = 1 << 20
# Rows of ids (8 bytes each) that are broadcast at most.
SEND_ROWS = 1_000_000

# --- document frequencies -----------------------------------------------------------------------------------------

CELL_BITS, CELL_ROWS, CELL_BLOCK = 19, 2, 8192


def _cells(h: np.ndarray) -> list[np.ndarray]:
    """Each shingle's counter in each row of the sketch."""
    return [((h >> np.uint64(k * CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64) for k in range(CELL_ROWS)]


def _sketch(batches):
    """A task's counters, in blocks (c); those of c = -1 are its number of documents."""
    total, docs, held = np.zeros((CELL_ROWS, 1 << CELL_BITS), np.int64), 0, []

    def count():
        for row, place in zip(total, _cells(np.concatenate(held) if held else np.zeros(0, np.uint64))):
            row += np.bincount(place, minlength=len(row))
        held.clear()

    for batch in batches:
        buf, at = text_buffer(batch.column("t"))
        docs += len(at) - 1
        for i, j in chunks(at):
            held.append(shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], WIDTH)[0])
            if sum(map(len, held)) >= 1 << 18:
                count()
    count()
    blocks = total.reshape(-1, CELL_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([np.int64(docs).tobytes(), *(blocks[u].tobytes() for u in used)], pa.binary())], ["c", "n"])


def _added(batches):
    """The sums of the blocks with equal c; a task holds one sum a c."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, n in zip(batch.column("c").to_pylist(), batch.column("n")):
            n = np.frombuffer(n.as_buffer(), np.int64)
            held[c] = held[c] + n if c in held else n.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n.tobytes() for n in held.values()], pa.binary())], ["c", "n"])


def document_shares(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents (rows of t), and the sketch's counters: of fixed size, whatever the table's."""
    added = texts.select("t").mapInArrow(tidy(_sketch), "c int, n binary").repartition("c").mapInArrow(tidy(_added), "c int, n binary")
    blocks, docs = np.zeros((CELL_ROWS * (1 << CELL_BITS) // CELL_BLOCK, CELL_BLOCK), np.int64), 0
    for r in added.collect():
        if r["c"] < 0:
            docs += int(np.frombuffer(r["n"], np.int64)[0])
        else:
            blocks[r["c"]] += np.frombuffer(r["n"], np.int64)
    return docs, blocks.reshape(CELL_ROWS, -1)


class Weights:
    """Weight of a shingle in a document: (1 + ln tf) * idf, the idf of its least counter."""

    def __init__(self, docs: int, counts: np.ndarray, smooth: float, grid: float = 0.02):
        share = np.minimum(1.0, counts / max(docs, 1))
        idf = np.log1p(1 / (share + smooth)) / np.log1p(1 / smooth)
        self.idf = np.exp(np.round(np.log(idf) / grid) * grid).astype(np.float32)

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.zeros(len(h), np.float32)
        for row, place in zip(self.idf, _cells(h)):
            np.maximum(idf, row[place], out=idf)
        return (1 + np.log(tf)) * idf


# --- consistent weighted sampling ---------------------------------------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling.

    For sample k and shingle s, hash bits of (k, s) choose one of 2**16 draws of r, c ~ Gamma(2, 1) and b ~ U(0, 1).
    With t = floor(ln w / r + b), the sample is the shingle with the least ln a = ln c - r (t - b + 1). It is known by
    ln a (which holds t) and further hash bits, so two documents agree on a sample if they chose the same s and t.
    """

    def __init__(self, samples: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        self.r = rng.gamma(2, 1, 1 << 16)
        self.c = np.log(rng.gamma(2, 1, 1 << 16))
        self.b = rng.random(1 << 16)
        self.unit = self._code(self.c - self.r * (1 - self.b))

    @staticmethod
    def _code(x: np.ndarray) -> np.ndarray:
        """Numbers in the order of the 32-bit floats x, in the upper half of 64 bits."""
        bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def samples(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row a document, a column a sample; no document may be empty."""
        out = np.empty((len(starts), len(self.factor)), np.uint64)
        odd = np.flatnonzero(w != 1)
        log_w = np.log(w[odd])
        low, far = np.uint64(0xFFFFFFFF), np.uint64(48)
        base = mix(h)
        for k, f in enumerate(self.factor):
            x = base * f
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            place = (x >> far).astype(np.int64)
            code = self.unit[place]
            if len(odd):
                p = place[odd]
                r = self.r[p]
                code[odd] = self._code(self.c[p] - r * (np.floor(log_w / r + self.b[p]) - self.b[p] + 1))
            x &= low
            x |= code
            out[:, k] = np.minimum.reduceat(x, starts)
        return out


def _sign(weights, samples: int, rows: int):
    def run(batches):
        sampler, known = Sampler(samples), weights.value
        lanes = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(rows)], np.uint64)
        for batch in batches:
            buf, at = text_buffer(batch.column("t"))
            bands = np.zeros((len(at) - 1, samples // rows), np.int64)
            short = np.zeros((len(at) - 1, samples), np.uint16)
            full = np.zeros(len(at) - 1, bool)
            for i, j in chunks(at):
                h, tf, off = shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], WIDTH)
                some = np.flatnonzero(np.diff(off))
                if not len(some):
                    continue
                s = sampler.samples(h, known.of(h, tf), off[some])
                bands[i + some] = mix((mix(s).reshape(len(some), -1, rows) * lanes).sum(axis=2, dtype=np.uint64)).view(np.int64)
                short[i + some] = mix(s) >> np.uint64(48)
                full[i + some] = True
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("g"), pa.ListArray.from_arrays(offsets, pa.array(bands[full].ravel())), pa.array([r.tobytes() for r in short], pa.binary()), pa.array(np.diff(at))],
                ["id", "g", "bands", "samples", "bytes"],
            )

    return run


# --- verification -------------------------------------------------------------------------------------------------


def weighted_jaccard(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """The weighted Jaccard similarity of each text of a with the text of b beside it; 0 where one has no word."""
    (buf_a, at_a), (buf_b, at_b) = text_buffer(a), text_buffer(b)
    out = np.zeros(len(at_a) - 1)
    for i, j in chunks(at_a + at_b):
        keys, vals = [], []
        for buf, at in ((buf_a, at_a), (buf_b, at_b)):
            h, tf, off = shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], WIDTH)
            keys.append((np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(off)) << np.uint64(HASH_BITS)) | h)
            vals.append(weights.of(h, tf))
        sums = sum(np.bincount((k >> np.uint64(HASH_BITS)).astype(np.int64), v, j - i) for k, v in zip(keys, vals))
        _, x, y = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
        both = np.bincount((keys[0][x] >> np.uint64(HASH_BITS)).astype(np.int64), np.minimum(vals[0][x], vals[1][y]), j - i)
        out[i:j] = both / np.maximum(sums - both, 1e-300)
    return out


def _verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' similarity reaches the threshold; either may be in many pairs. Spilled."""
    ids = spill(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired")
    few = ids.count() <= SEND_ROWS
    used = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    total, both, counts = pairs.count(), pairs, []
    for side in ("a", "b"):
        per = spill(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), "paired")
        each = used.select(F.col("id").alias(side), F.col("t").alias(f"t{side}")).join(per, side)
        both = join_unique(both, each, [side], "n", total, per)
        counts.append(per)
    both = both.select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            ok = weighted_jaccard(batch.column("ta"), batch.column("tb"), weights.value) >= threshold
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    found = spill(both.mapInArrow(tidy(run), "a long, b long"), "edges")
    drop(ids, *counts)
    return found


# --- components ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, label: the least id of each connected component of the edges (a, b). Ids without an edge are absent.

    Alternating large-star and small-star steps; every step is joins and partial aggregation on keys, hot keys apart.
    """
    e = spill(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph")
    for _ in range(most_rounds):
        # done when all edges lead to nodes that lead nowhere: then every component is a star
        if e.select("u").distinct().join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spill(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        total = least.agg(F.sum("n")).first()[0]
        large = join_unique(both.filter("v > u"), least, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = spill(large.filter("u <> v").distinct(), "graph")
        drop(e, least)
        down = spill(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        kept = down.select("u", F.col("m").alias("v"))
        total = down.agg(F.sum("n")).first()[0]
        moved = join_unique(large, down.filter("n > 1"), ["u"], "n", total)
        moved = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = spill(kept.union(moved).distinct(), "graph")
        drop(large, down)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots)


# --- links inside a bucket ----------------------------------------------------------------------------------------


def _cell(column: pa.Array, r: int, samples: int):
    """The ids, labels and samples of one block, and its texts, if it has them."""
    a, b = column.offsets[r].as_py(), column.offsets[r + 1].as_py()
    part = column.values.slice(a, b - a)
    bits = np.frombuffer(b"".join(part.field("samples").to_pylist()), np.uint16).reshape(b - a, samples)
    texts = part.field("t") if part.type.get_field_index("t") >= 0 else None
    return part.field("id").to_numpy(), part.field("label").to_numpy(), bits, texts


def _likely_pairs(sa, sb, la, lb, band: int, rows: int, floor: float):
    """Places x, y of pairs with different labels, enough equal samples and no common band before ``band``; and their number."""
    equal, earlier = np.zeros((len(sa), len(sb)), np.int16), np.zeros((len(sa), len(sb)), bool)
    for j in range(sa.shape[1] // rows):
        whole = np.ones(equal.shape, bool)
        for k in range(j * rows, (j + 1) * rows):
            same = sa[:, k, None] == sb[:, k]
            equal += same
            whole &= same
        if j < band:
            earlier |= whole
    x, y = np.nonzero((equal >= floor * sa.shape[1]) & (la[:, None] != lb) & ~earlier)
    return x, y, equal[x, y]


def _pairs_of_cells(batch: pa.RecordBatch, samples: int, rows: int, floor: float):
    """Of each cell: the two blocks, and the candidate pairs' places in them with their number of equal samples."""
    for r in range(batch.num_rows):
        minors, members = (_cell(batch.column(c), r, samples) for c in ("minors", "members"))
        found = []
        for at in range(0, len(members[0]), 128):
            x, y, equal = _likely_pairs(minors[2], members[2][at : at + 128], minors[1], members[1][at : at + 128], batch.column("band")[r].as_py(), rows, floor)
            # of two texts outside the largest component each meets the other: once will do
            once = (members[1][y + at] == batch.column("main")[r].as_py()) | (minors[0][x] > members[0][y + at])
            found.append((x[once], y[once] + at, equal[once]))
        yield batch.column("bucket")[r].as_py(), minors, members, *(np.concatenate(c) for c in zip(*found))


def _with_candidates(samples: int, rows: int, floor: float):
    """The texts of each cell that are in a candidate pair."""

    def run(batches):
        for batch in batches:
            for bucket, minors, members, x, y, _ in _pairs_of_cells(batch, samples, rows, floor):
                ids = np.union1d(minors[0][x], members[0][y])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket)), pa.array(ids)], ["bucket", "id"])

    return run


def _links(samples: int, rows: int, floor: float, threshold: float, weights):
    """The verified links of each cell, one of each text and component."""

    def run(batches):
        for batch in batches:
            for _, (ia, _, _, ta), (ib, lb, _, tb), x, y, equal in _pairs_of_cells(batch, samples, rows, floor):
                goal = np.unique(np.stack([x, lb[y]]), axis=1, return_inverse=True)[1].ravel() if len(x) else x
                order = np.lexsort((-equal, goal))
                x, y, goal = x[order], y[order], goal[order]
                while len(x):  # of each text and component the likeliest pairs, until it is linked
                    now = np.arange(len(goal)) - np.searchsorted(goal, goal) < 8
                    sim = weighted_jaccard(ta.take(pa.array(x[now])), tb.take(pa.array(y[now])), weights.value)
                    hit = np.flatnonzero(sim >= threshold)
                    _, one = np.unique(goal[now][hit], return_index=True)
                    a, b = ia[x[now][hit[one]]], ib[y[now][hit[one]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
                    rest = ~now & ~np.isin(goal, goal[now][hit])
                    x, y, goal = x[rest], y[rest], goal[rest]

    return run


def _in_cells(members: DataFrame, full: DataFrame, what: list[str], block: int, bytes_: int | None, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cells (bucket, band, main, minors, members) of the buckets with several labels; and what to drop after their use.

    members: bucket, band, id, label, bytes. full: id and the columns ``what``. Every text outside the label that most
    have, the main one, meets every text of its bucket in one cell. A block has at most about ``block`` rows and bytes_.
    """
    per = members.groupBy("bucket", "band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    per = per.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("top"),
        F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", "label")).alias("top_bytes"),
    )
    blocks_of = lambda n, most, size: F.ceil(F.greatest(n / F.lit(most), size / F.lit(bytes_) if bytes_ else F.lit(0.0))).cast("int")
    mixed = per.filter("top < n").select(
        "bucket", "main", "n", blocks_of(F.col("n") - F.col("top"), block // 2, F.col("bytes") - F.col("top_bytes")).alias("parts"), blocks_of(F.col("n"), block, F.col("bytes")).alias("blocks"),
    )
    mixed = spill(mixed, "mixed")
    open_ = spill(join_unique(members.drop("bytes"), mixed, ["bucket"], "n", total), "open")
    rows = open_.join(full, "id").withColumn("spot", F.xxhash64(F.lit(3), "id"))
    cell, at = F.struct("id", "label", *what), ["bucket", "band", "main", "part", "block"]
    minors = rows.filter("label <> main").withColumn("part", F.pmod("spot", "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = rows.withColumn("block", F.pmod("spot", "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    minors = minors.groupBy(*at).agg(F.collect_list(cell).alias("minors"))
    others = others.groupBy(*at).agg(F.collect_list(cell).alias("members"))
    return minors.join(others, at).select("bucket", "band", "main", "minors", "members"), [mixed, open_]


def _link_open(members: DataFrame, unique: DataFrame, texts: DataFrame, weights, threshold: float, samples: int, rows: int, floor: float, total: int) -> DataFrame:
    """Verified links (a, b) between the components that meet in a bucket. Spilled. members: bucket, band, id, label, bytes."""
    signs = unique.select("id", "g", "samples")
    cells, used = _in_cells(members, signs.select("id", "samples"), ["samples"], SAMPLE_BLOCK, None, total)
    found = spill(cells.mapInArrow(tidy(_with_candidates(samples, rows, floor)), "bucket long, id long").distinct(), "candidates")
    drop(*used)
    needed = spill(found.select("id").distinct(), "needed")
    few = needed.count() <= SEND_ROWS
    mine = texts.join(F.broadcast(needed) if few else needed, "id", "left_semi").withColumn("g", F.unhex(F.sha2("t", 256))).dropDuplicates(["id", "g"])
    full = signs.join(mine, ["id", "g"]).select("id", "samples", "t")
    members = spill(members.join(found, ["bucket", "id"], "left_semi"), "members")
    cells, used = _in_cells(members, full, ["samples", "t"], TEXT_BLOCK, BLOCK_BYTES, total)
    out = spill(cells.mapInArrow(tidy(_links(samples, rows, floor, threshold, weights)), "a long, b long"), "edges")
    drop(found, needed, members, *used)
    return out


# --- the operator -------------------------------------------------------------------------------------------------


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 5,
    smooth: float = 0.2, sample_floor: float = 0.6,
) -> DataFrame:
    """The id column and class_id (the least id of the class), one row a distinct id. Ids are 64-bit integers."""
    spark = docs.sparkSession
    bound_batches(spark)
    samples = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("id is not null")
    total, counts = document_shares(texts)
    weights = spark.sparkContext.broadcast(Weights(total, counts, smooth))  # of fixed size

    signed = texts.select("id", "t", F.unhex(F.sha2("t", 256)).alias("g"))
    signed = spill(signed.mapInArrow(tidy(_sign(weights, samples, rows)), "id long, g binary, bands array<long>, samples binary, bytes long"), "samples")
    # equal texts: one id each
    same = spill(signed.groupBy("g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "same")
    owner = spill(join_unique(signed.select("id", "g"), same, ["g"], "n", total).groupBy("id", "rep").agg(F.count(F.lit(1)).alias("n")), "owner")
    # an id with several texts can stand for several: its texts are compared under its id, one at a time
    unique = spill(signed.join(same.select("g", F.col("rep").alias("id")), ["g", "id"], "left_semi").dropDuplicates(["g", "id"]).select("id", "g", "bands", "samples", "bytes"), "unique")
    drop(signed, same)
    in_band = unique.select("id", "bytes", F.posexplode("bands").alias("band", "h")).select("id", "bytes", "band", F.xxhash64("band", "h").alias("bucket"))
    groups = spill(in_band.groupBy("bucket").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    all_bands = max(1, total * bands)
    members = spill(join_unique(in_band, groups, ["bucket"], "n", all_bands), "members")
    drop(groups)

    first = spill(members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    linked = _verify(first, texts, weights, threshold)
    drop(first)
    links = linked.union(owner.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    label = spill(components(links), "labels")

    # buckets that still hold several components
    sizes = spill(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = sizes.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "n")
    labelled = spill(join_unique(members.select("bucket", "band", "id", "bytes"), own, ["id"], "n", all_bands), "members")
    drop(members, sizes, label)
    more = _link_open(labelled, unique, texts, weights, threshold, samples, rows, sample_floor, all_bands)
    final = spill(components(links.union(more)), "labels")
    ids = owner.groupBy("id").agg(F.min("rep").alias("rep"))
    found = ids.join(final, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("class_id"))
    drop(labelled, unique)
    weights.destroy()
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class stays: that with the class's least id; rows with a null id stay.

    Rows that share an id and have different texts are documents of their own, under a hash of id and text as their id.
    """
    key, mark = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    several = docs.filter(key.isNotNull()).groupBy(key.alias("__tl_same")).agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.count(F.lit(1)).alias("n"))
    several = spill(several.filter("n > 1"), "repeated")
    doubtful = several.filter("a <> b").select("__tl_same")
    named = docs.withColumn("__tl_id", key)
    if not doubtful.isEmpty():
        own = F.when(F.col("__tl_same").isNotNull(), F.xxhash64(key, mark)).otherwise(key)
        named = docs.join(doubtful, key == F.col("__tl_same"), "left").withColumn("__tl_id", own).drop("__tl_same")
    found = spill(classes(named, "__tl_id", text_col, **options), "classes")
    keep = found.filter(F.col("__tl_id") == F.col("class_id")).select("__tl_id")
    few = keep.count() <= SEND_ROWS
    kept = named.join(F.broadcast(keep) if few else keep, "__tl_id", "left_semi")
    if not several.isEmpty():
        kept = kept.dropDuplicates(["__tl_id"])
    return kept.select(*docs.columns).unionByName(docs.filter(key.isNull()))
