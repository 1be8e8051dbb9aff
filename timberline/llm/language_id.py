"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams (n = 2, 3, 4) of its lower-cased words, hashed into buckets. Each bucket has an
embedding; a text is the average of its subwords' embeddings, and a linear softmax turns it into language
probabilities. Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled texts. A temperature fitted on texts kept out of the training calibrates the probabilities, and a threshold
from the same texts says when a prediction is rejected.

For scoring, the embedding and softmax matrices are multiplied once, so that a text costs one table lookup a subword.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; white space and
punctuation never count; repeated rows get equal results; an empty training table gives ``und`` for every text, score 0;
every language with a labelled text that has a letter is learned from, whether the texts can tell it apart or not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm._shared import bound_batches, give_back, text_buffer, tidy

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
UND = "und"

# ASCII letters stay (lower-cased), bytes of other scripts' letters stay, all else parts words.
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _FOLD[_b] = _b
_LANE = np.array([0x9E37_79B1, 0x85EB_CA77, 0xC2B2_AE3D, 0x27D4_EB2F], np.uint32)


def _subwords(buf: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: n, the bucket of the n-gram that begins at each byte, and whether it lies in one word.

    A word's n-grams may hold the blank before or after it, never a blank inside.
    """
    out = []
    blank = buf == 32
    wide = buf.astype(np.uint32)
    for n in SIZES:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x1656_67B1 & 0xFFFF_FFFF, np.uint32)
        for j in range(n):
            h = (h ^ wide[j : j + m]) * _LANE[j]
            h ^= h >> np.uint32(15)
        ok = ~(blank[:m] & blank[n - 1 :])
        for j in range(1, n - 1):
            ok &= ~blank[j : j + m]
        out.append((n, (h % np.uint32(BUCKETS)).astype(np.int32), ok))
    return out


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts folded in one buffer, each between blanks; text i begins at the blank at offset i."""
    buf, at = text_buffer(pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(column, "")), " "))
    return np.append(_FOLD[buf], np.uint8(32)), at


def _counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and counts of each text; at most BUCKETS numbers, however long the text."""
    out = []
    for i in range(len(column)):
        buf, _ = _folded(column[i : i + 1])
        total = np.zeros(BUCKETS, np.int64)
        for a in range(0, len(buf), 1 << 20):
            for n, h, ok in _subwords(buf[a : a + (1 << 20) + max(SIZES) - 1]):
                h, ok = h[: 1 << 20], ok[: 1 << 20]
                total += np.bincount(h[ok], minlength=BUCKETS)
        ids = np.flatnonzero(total)
        out.append((ids, total[ids]))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """languages: the learned labels; table: each bucket's share of each language's logit."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text, and its number of subwords; long buffers are taken in pieces."""
        buf, at = _folded(column)
        texts = len(at) - 1
        sums, seen = np.zeros((texts, len(self.languages))), np.zeros(texts, np.int64)
        step, over = 1 << 17, max(SIZES) - 1
        for a in range(0, len(buf), step):
            i = max(0, int(np.searchsorted(at, a, side="right")) - 1)
            j = min(texts, int(np.searchsorted(at, min(a + step, len(buf)), side="left")))
            if j <= i:
                continue
            starts = np.maximum(at[i:j] - a, 0)
            for _, h, ok in _subwords(buf[a : a + step + over]):
                h, ok = h[:step], ok[:step]
                s = np.minimum(starts, len(h))
                h = np.where(ok, h, BUCKETS)
                pad = np.append(h, BUCKETS)
                sums[i:j] += np.add.reduceat(self.table[pad], s, axis=0)
                seen[i:j] += np.add.reduceat(np.append(ok, False).astype(np.int64), s)
        return sums / np.maximum(seen, 1)[:, None] + self.bias, seen

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether the prediction is rejected, for each text."""
        texts = len(column)
        if not self.languages or not texts:
            return [UND] * texts, np.zeros(texts), np.ones(texts, bool)
        z, _ = self.logits(column)
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(texts), best]
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        score = np.where(letters, score, 0.0)
        return [self.languages[b] if x else UND for b, x in zip(best, letters)], score, ~letters | (score < self.threshold)


def _sgd(rows, labels, k: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Trains embeddings and softmax; rows: (bucket numbers, counts) a text. Returns the joint table and the bias."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1.0 / dim, (BUCKETS, dim))
    w, bias = np.zeros((dim, k)), np.zeros(k)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 32):
            batch = order[a : a + 32]
            ids = np.concatenate([rows[i][0] for i in batch])
            size = np.array([len(rows[i][0]) for i in batch])
            val = np.concatenate([rows[i][1] / rows[i][1].sum() for i in batch])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            x = np.add.reduceat(e[ids] * val[:, None], starts, axis=0)
            z = x @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            g = p / len(batch)
            back = g @ w.T
            w -= step * x.T @ g
            bias -= 0.01 * step * g.sum(axis=0)
            np.subtract.at(e, ids, step * val[:, None] * np.repeat(back, size, axis=0))
    return e @ w, bias


def fit(
    docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train: Column | None = None,
    sample_rows: int = 3000, sample_bytes: int = 256 << 20, dim: int = 16, epochs: int = 8, rate: float = 40.0, false_reject: float = 0.001, seed: int = 7,
) -> LanguageModel:
    """Fits on about sample_rows labelled texts, as many of each language (one at least), chosen by a hash of the id.

    What reaches the driver is bounded by max(sample_rows, number of languages) texts, as counts of at most BUCKETS
    subwords each, and by sample_bytes of these (a language's first text is always taken). ``train`` says which rows may
    be learned from. false_reject: the share of known-language texts that the rejection may cost, by the texts kept out
    of the training.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.filter(train) if train is not None else docs
    rows = rows.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    sizes = sorted((r["l"], r["n"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect())
    names = tuple(l for l, _ in sizes)
    if not names:
        return _nothing()
    each = max(1, sample_rows // len(names))
    # a text goes on if its hash is low enough for about 1.3 times the texts wanted of its language, and 20 more
    cut = [(l, min(2**63 - 1, int((1.3 * each + 20) / n * 2**63))) for l, n in sizes]
    cut = F.broadcast(spark.createDataFrame(cut, "l string, cut long"))  # a row a language
    near = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("k")).bitwiseAND(F.lit(2**63 - 1))).join(cut, "l").filter("h <= cut")
    near = near.select("l", "h", "t").repartition(spark.sparkContext.defaultParallelism).mapInArrow(tidy(_count_batches), "l string, h long, ids binary, n binary")
    order = Window.partitionBy("l").orderBy("h", "ids", "n")  # equal counts are equal rows to the fit
    size = F.octet_length("ids") + F.octet_length("n")
    near = near.filter(F.octet_length("ids") > 0).withColumn("place", F.row_number().over(order)).withColumn("bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = near.filter((F.col("place") == 1) | ((F.col("place") <= each) & (F.col("bytes") <= sample_bytes // len(names))))
    kept = kept.select("l", "place", "ids", "n").toArrow()  # a few large buffers, not many objects
    turn = sorted(range(len(kept)), key=lambda i, l=kept["l"].to_pylist(), p=kept["place"].to_pylist(): (p[i], l[i]))
    data = [tuple(np.frombuffer(kept[c][i].as_buffer(), kind) for c, kind in (("ids", np.uint16), ("n", np.int32))) for i in turn]
    number = {l: i for i, l in enumerate(names)}
    labels = np.array([number[kept["l"][i].as_py()] for i in turn], np.int64)
    if not len(data):
        return _nothing()
    # a language's first four texts of five are learned from
    out = np.array([kept["place"][i].as_py() % 5 == 0 for i in turn]) if len(data) >= 50 else np.zeros(len(data), bool)
    learn = np.flatnonzero(~out)
    table, bias = _settled([data[i] for i in learn], labels[learn], len(names), dim, epochs, rate, seed)
    held = np.flatnonzero(out) if out.any() else learn
    z = np.stack([(table[data[i][0]] * (data[i][1] / data[i][1].sum())[:, None]).sum(axis=0) + bias for i in held])
    temperature, p = _calibrate(z, labels[held])
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == labels[held]])
    threshold = float(min(0.5, right[int(false_reject * len(right))] * 0.9)) if len(right) else 0.0
    full = np.vstack([table, np.zeros((1, len(names)))]).astype(np.float32)
    return LanguageModel(names, full, bias, temperature, threshold)


def _nothing() -> LanguageModel:
    return LanguageModel((), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)


def _settled(rows, labels, k: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """_sgd at the rate, or at a quarter of it and so on, until it is finite and no worse than equal odds for all languages."""
    for _ in range(8):
        with np.errstate(all="ignore"):
            table, bias = _sgd(rows, labels, k, dim, epochs, rate, seed)
            z = np.stack([(table[ids] * (n / n.sum())[:, None]).sum(axis=0) + bias for ids, n in rows])
            z -= z.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean()
        if np.isfinite(table).all() and np.isfinite(bias).all() and loss <= np.log(k) + 0.05:
            return table, bias
        rate /= 4
    return np.zeros((BUCKETS, k)), np.zeros(k)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The temperature with the least log loss, and the probabilities it gives; 1 before all others."""
    best = (np.inf, 1.0, None)
    for t in [1.0, *np.geomspace(0.1, 20, 60)]:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
        if best[2] is None or loss < best[0] - 1e-12:
            best = (loss, float(t), p)
    return best[1], best[2]


def _count_batches(batches):
    for batch in batches:
        found = _counts(batch.column("t"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("l"), batch.column("h"), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())],
            ["l", "h", "ids", "n"],
        )


def predictor(spark, model: LanguageModel):
    """A column function: text -> struct(lang, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang string, score double, rejected boolean")
    def of(text: pa.Array) -> pa.Array:
        lang, score, rejected = shared.value.predict(text)
        give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], fields=list(kind))

    return of


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds struct column ``out`` (lang, score, rejected); an input column of that name is replaced."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text_col)))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose prediction isn't rejected, with their columns as they were."""
    of = predictor(docs.sparkSession, model)
    bound_batches(docs.sparkSession)
    return docs.filter(~of(F.col(text_col))["rejected"])
