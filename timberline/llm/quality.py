"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

A text becomes a few numeric features (lengths, shares of character kinds, repetition). Each feature is cut into bins
at quantiles of a bounded training sample. Boosting goes round the features again and again; each step fits a shallow
tree (three cuts at most) on one feature's bins and adds a small part of it to that feature's lookup table. Then the
pairs whose residuals interact most get tables of their own, boosted the same way. A score is the sigmoid of the sum of
one table entry a feature and a pair: scoring is a vectorised look-up and addition.

Defined results: null and empty texts are scored by their (zero) features; repeated rows get equal scores; without any
training label every score is 0.5; with labels of one kind only every score is their share, kept within 0.001 of 0 or 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm._shared import IS_SPACE, bound_batches, chunks, give_back, text_buffer, tidy, word_hashes

FEATURES = (
    "log_bytes", "log_words", "log_lines", "bytes_per_word", "words_per_line", "upper_share", "digit_share", "symbol_share",
    "punctuation_share", "exclaim_share", "pipe_share", "wide_share", "blank_share", "word_variety", "pair_variety", "line_variety", "longest_repeat",
)

_KINDS = np.zeros((8, 256), bool)
for _c in range(256):
    _s = chr(_c)
    _KINDS[0, _c] = _s.isascii() and _s.isupper()
    _KINDS[1, _c] = _s.isascii() and _s.isdigit()
    _KINDS[2, _c] = _s in "#$%&*+<=>@\\^_`{}~[]/"
    _KINDS[3, _c] = _s in ".,;:'\"()-?"
    _KINDS[4, _c] = _s == "!"
    _KINDS[5, _c] = _s == "|"
    _KINDS[6, _c] = _c >= 128
    _KINDS[7, _c] = bool(IS_SPACE[_c])


def _distinct(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the number of distinct keys, and the number of times of the most frequent one."""
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(at))
    k = (owner << np.uint64(52)) | (keys >> np.uint64(12))
    k.sort()
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    where = np.flatnonzero(new)
    if not len(where):
        return np.zeros(texts), np.zeros(texts)
    of = (k[where] >> np.uint64(52)).astype(np.int64)
    most = np.zeros(texts)
    np.maximum.at(most, of, np.diff(np.append(where, len(k))))
    return np.bincount(of, minlength=texts).astype(float), most


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """The features of each text, by the whole text."""
    all_buf, all_at = text_buffer(column)
    out = np.zeros((len(all_at) - 1, len(FEATURES)))
    for i, j in chunks(all_at):
        buf, at = all_buf[all_at[i] : all_at[j]], all_at[i : j + 1] - all_at[i]
        size = np.diff(at).astype(float)
        words, woff = word_hashes(buf, at)
        n = np.diff(woff).astype(float)
        kinds = [_sums(t[buf], at) for t in _KINDS]
        breaks = np.flatnonzero(buf == 10)
        begins = np.unique(np.concatenate([at[:-1][size > 0], breaks + 1]))
        begins = begins[begins < len(buf)]
        lines = np.diff(np.searchsorted(begins, at)).astype(float)
        # a line's hash: of its words in order
        w_at = np.searchsorted(_word_starts(buf, at), np.append(begins, len(buf)))
        steps = np.arange(len(words), dtype=np.uint64)
        rolled = np.zeros(len(words) + 1, np.uint64)
        within = steps - np.repeat(w_at[:-1], np.diff(w_at)).astype(np.uint64) if len(words) else steps
        np.cumsum(words * (within * np.uint64(2) + np.uint64(1)), out=rolled[1:])
        line_keys = (rolled[w_at[1:]] - rolled[w_at[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
        pairs = words.copy()
        pairs[:-1] += words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        ends = woff[1:][n > 0] - 1  # a text's last word has no next one, whatever text follows
        pairs[ends] = words[ends]
        kinds_w, most_w = _distinct(words, woff)
        kinds_p, _ = _distinct(pairs * np.uint64(0x9E3779B97F4A7C15), woff)
        kinds_l, _ = _distinct(line_keys, np.searchsorted(begins, at))
        full, per, rows = np.maximum(size, 1), np.maximum(n, 1), np.maximum(lines, 1)
        x = [np.log1p(size), np.log1p(n), np.log1p(lines), size / per, n / rows]
        x += [k / full for k in kinds]
        x += [kinds_w / per, kinds_p / per, kinds_l / rows, most_w / per]
        out[i:j] = np.column_stack(x)
    return out


def _word_starts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(buf)]
    first[edges] = solid[edges]
    return np.flatnonzero(first)


@dataclass(frozen=True)
class AdditiveModel:
    """cuts: each feature's inner bin edges; tables: by feature; pairs: (i, j, table by bin of i and of j)."""

    base: float
    cuts: tuple = ()
    tables: tuple = ()
    pairs: tuple = field(default=())

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        z, b = np.full(len(x), self.base), self.bins(x)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2, smooth: float = 1.0) -> np.ndarray:
    """The best tree of the given depth over ordered bins with gradients g and weights h: a value a bin."""

    def grow(a: int, b: int, left: int, out: np.ndarray) -> None:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        out[a:b] = gs[-1] / (hs[-1] + smooth)
        if left == 0 or b - a < 2:
            return
        lg, lh = gs[:-1], hs[:-1]
        gain = lg**2 / (lh + smooth) + (gs[-1] - lg) ** 2 / (hs[-1] - lh + smooth) - gs[-1] ** 2 / (hs[-1] + smooth)
        m = int(gain.argmax())
        if gain[m] > 1e-9:
            grow(a, a + m + 1, left - 1, out)
            grow(a + m + 1, b, left - 1, out)

    out = np.zeros(len(g))
    grow(0, len(g), depth, out)
    return out


def fit_table(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_bins: int = 8) -> AdditiveModel:
    """Cyclic boosting on features x and 0/1 labels y."""
    if not len(y):
        return AdditiveModel(0.0)
    share = float(np.clip(y.mean(), 0.001, 0.999))
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return AdditiveModel(base)
    cuts = tuple(np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1]))
    b = AdditiveModel(base, cuts).bins(x)
    width = [len(c) + 1 for c in cuts]
    tables, z = [np.zeros(w) for w in width], np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, w in enumerate(width):
            g, h = slopes()
            t = rate * _shallow(np.bincount(b[:, f], g, w), np.bincount(b[:, f], h, w))
            tables[f] += t
            z += t[b[:, f]]
    coarse = [np.arange(w) * pair_bins // w if w > pair_bins else np.arange(w) for w in width]
    g, h = slopes()
    gains = []
    for i in range(len(width)):
        for j in range(i):
            cell = coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]
            gs, hs = np.bincount(cell, g, pair_bins**2), np.bincount(cell, h, pair_bins**2)
            gains.append((float((gs**2 / (hs + 5)).sum()), i, j))
    pairs = []
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        pairs.append([i, j, np.zeros((pair_bins, pair_bins))])
    for _ in range(rounds // 3):
        for i, j, t in pairs:
            g, h = slopes()
            ci, cj = coarse[i][b[:, i]], coarse[j][b[:, j]]
            cell = ci * pair_bins + cj
            gs, hs = (np.bincount(cell, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (g, h))
            rows, step = _shallow(gs.sum(axis=1), hs.sum(axis=1), 1), np.zeros_like(gs)
            for group in np.unique(rows):  # a cut on one feature, then cuts on the other within each side
                inside = rows == group
                step[inside] = _shallow(gs[inside].sum(axis=0), hs[inside].sum(axis=0), 2, 5.0)
            t += rate * step
            z += rate * step[ci, cj]
    return AdditiveModel(base, cuts, tuple(tables), tuple((i, j, t[np.ix_(coarse[i], coarse[j])]) for i, j, t in pairs))


def _feature_batches(batches):
    for batch in batches:
        x = features(batch.column("t"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "h", "x"])


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id",
    train: Column | None = None, sample_rows: int = 8000, seed: int = 11,
) -> AdditiveModel:
    """Fits on at most sample_rows labelled rows, chosen by a hash of the id; only features reach the driver.

    ``train`` (a condition on the id) says which rows may be learned from. Null labels, and ids that have no text row,
    are left out; of several labels of an id the largest counts.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter("y is not null")
    marked = marked.filter(train) if train is not None else marked
    marked = marked.groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = marked.withColumn("h", place).orderBy("h", id_col).limit(sample_rows)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("t")).join(F.broadcast(chosen), id_col)  # sample_rows small rows
    # equal features are equal rows to the fit: with them, an id's several texts have one order
    found = texts.select("y", "h", "t").mapInArrow(tidy(_feature_batches), "y int, h long, x binary").orderBy("h", "x").limit(sample_rows).collect()
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), len(FEATURES))
    return fit_table(x, np.array([float(r["y"] > 0) for r in found]))


def scorer(spark, model: AdditiveModel):
    """A column function: text -> score from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        found = pa.array(shared.value.score(features(text)), pa.float64())
        give_back()
        return found

    return of


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds double column ``out``; an input column of that name is replaced."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, scorer(docs.sparkSession, model)(F.col(text_col)))
