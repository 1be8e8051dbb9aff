import inspect
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import _shared
from timberline.llm import minhash_dedup as M
from timberline.llm._shared import shingles, text_buffer


def _bag(text):
    words = (text or "").encode().split()
    if not words:
        return {}
    grams = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return {g: 1 + math.log(n) for g, n in grams.items()}


def _idf(rows, smooth=0.2):
    """The weight of each shingle by its exact number of documents (rows with an id), on the grid."""
    docs = [t for i, t in rows if i is not None]
    counts = Counter(g for t in docs for g in _bag(t))
    level = lambda p: math.log(1 + 1 / (p + smooth)) / math.log(1 + 1 / smooth)
    return {g: math.exp(round(math.log(level(n / len(docs))) / 0.02) * 0.02) for g, n in counts.items()}


def _sim(a, b, idf=None):
    w = idf or Counter()
    a, b = ({g: x * (w[g] if idf else 1) for g, x in bag.items()} for bag in (a, b))
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _brute(rows):
    """Classes by single linkage over all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = sorted({(t or "", i) for i, t in rows if i is not None})
    bags, idf = [(i, t, _bag(t)) for t, i in texts], _idf(rows)
    for x in range(len(bags)):
        for y in range(x):
            if bags[x][1] == bags[y][1] or _sim(bags[x][2], bags[y][2], idf) >= 0.8:
                a, b = find(bags[x][0]), find(bags[y][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    return {r["doc_id"]: r["class_id"] for r in M.classes(docs, **options).collect()}


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _family(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_shingles_are_those_of_the_text():
    rng = random.Random(2)
    texts = [" ".join(_words(rng, n)) for n in (0, 1, 3, 4, 5, 6, 50)] + ["a  b\n\nc\td e f a b c d e f", " x ", None]
    buf, at = text_buffer(pa.array(texts))
    h, tf, off = shingles(buf, at)
    for i, t in enumerate(texts):
        bag = _bag(t)
        assert off[i + 1] - off[i] == len(bag)
        assert np.isclose((1 + np.log(tf[off[i] : off[i + 1]])).sum(), sum(bag.values()))
    assert len(np.unique(h)) == len(set().union(*[_bag(t) for t in texts]))


def test_samples_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 52, 400, dtype=np.uint64))
    wa, wb = rng.choice([1.0, 0.8, 1.7, 2.4], len(h)), rng.choice([1.0, 0.8, 1.7, 2.4], len(h))
    a, b = slice(0, 300), slice(60, len(h))
    s = M.Sampler(4000)
    x, y = s.samples(h[a], wa[a], np.array([0])), s.samples(h[b], wb[b], np.array([0]))
    full_a, full_b = np.zeros(len(h)), np.zeros(len(h))
    full_a[a], full_b[b] = wa[a], wb[b]
    want = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    assert abs((x == y).mean() - want) < 0.03


def _nothing():
    return M.Weights(1, np.zeros((M.CELL_ROWS, 1 << M.CELL_BITS)), 0.2)


def test_verification_is_exact():
    rng = random.Random(5)
    base = _words(rng, 200)
    a, b = [_family(rng, base, e) for e in (0, 3, 9)], [_family(rng, base, 2), " ".join(base), ""]
    got = M.weighted_jaccard(pa.array(a), pa.array(b), _nothing())
    assert np.allclose(got, [_sim(_bag(x), _bag(y)) for x, y in zip(a, b)])


def test_weights_by_definition(spark):
    """Shares over several partitions, and the weights they give, whatever the table's size."""
    rng = random.Random(8)
    hot = " ".join(_words(rng, 12))
    rows = [(i, (hot + " " if i % 3 == 0 else "") + " ".join(_words(rng, 30))) for i in range(400)]
    idf = _idf(rows)
    seen = []
    for times in (1, 10):
        texts = spark.createDataFrame([(t,) for _, t in rows * times], "t string").repartition(4)
        docs, counts = M.document_shares(texts)
        assert docs == 400 * times and counts.sum() == M.CELL_ROWS * times * sum(len(_bag(t)) for _, t in rows)
        weights = M.Weights(docs, counts, 0.2)
        for _, t in rows[:30]:
            buf, at = text_buffer(pa.array([t]))
            h, tf, _ = shingles(buf, at)
            assert np.allclose(sorted(weights.of(h, tf)), sorted(w * idf[g] for g, w in _bag(t).items()), rtol=1e-5)
        seen.append(weights.idf)
    assert np.array_equal(*seen) and len(set(idf.values())) >= 2 and min(idf.values()) < 0.7


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for f in range(25):
        base = _words(rng, rng.randrange(60, 400))
        for e in (0, 1, 2, 4, 6, 9):
            rows.append((len(rows), _family(rng, base, e)))
    rows += [(len(rows) + i, " ".join(_words(rng, 80))) for i in range(60)]
    rows += [(900, rows[3][1]), (901, ""), (902, ""), (903, None), (904, "two words"), (905, "two words"), (906, "two wordz"), (3, rows[3][1])]
    got, want = _run(spark, rows), _brute(rows)
    assert got == want
    # most documents in one family: its shingles weigh less, and fewer of its pairs are links
    base = _words(rng, 120)
    rows = [(i, _family(rng, base, i % 5)) for i in range(60)] + [(100 + i, " ".join(_words(rng, 80))) for i in range(40)]
    assert _run(spark, rows) == _brute(rows)


def test_large_family_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE_BLOCK", 32)
    monkeypatch.setattr(M, "TEXT_BLOCK", 16)
    monkeypatch.setattr(M, "BLOCK_BYTES", 20_000)
    rng = random.Random(7)
    base = _words(rng, 150)
    rows = [(i, _family(rng, base, rng.randrange(0, 14))) for i in range(150)]
    assert _run(spark, rows) == _brute(rows)


@pytest.mark.parametrize("send,share", [(0, 200), (10**6, 3)])
def test_every_way_to_join(spark, monkeypatch, send, share):
    """Ids by shuffle or broadcast, hot keys beside cold ones, gives the same classes."""
    monkeypatch.setattr(M, "SEND_ROWS", send)
    monkeypatch.setattr(_shared, "HOT_SHARE", share)
    rng = random.Random(11)
    base, other = _words(rng, 150), _words(rng, 90)
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, _family(rng, base, i % 8)) for i in range(40)] + [(200 + i, _family(rng, other, i % 4)) for i in range(20)]
    rows += [(300, " ".join(_words(rng, 30_000)))]
    assert _run(spark, rows) == _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in M.keep_one(docs).collect()} == {i for i, c in _brute(rows).items() if i == c}


@pytest.mark.parametrize("edges", [[], [(2, 1)], [(i + 1, i) for i in range(40)], [(i, 0) for i in range(1, 300)], [(5, 3), (3, 9), (8, 7), (9, 1), (7, 6)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["label"] for r in M.components(df).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(want[a], want[b])
            if want[a] != m or want[b] != m:
                want[a] = want[b] = m
                changed = True
    assert got == want


def test_keep_one(spark):
    rng = random.Random(9)
    base = _words(rng, 100)
    rows = [(4, " ".join(base)), (2, _family(rng, base, 1)), (7, " ".join(_words(rng, 50))), (7, " ".join(base)), (None, " ".join(base)), (4, " ".join(base))]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _keep string")
    assert M.keep_one(docs).columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in M.keep_one(docs).collect()]
    assert (7, rows[2][1]) in kept  # a text of its own, whatever shares its id
    assert (None, " ".join(base)) in kept and len(kept) == 3
    assert M.keep_one(docs.limit(0)).count() == 0


def test_sample_floor_loses_fewer_pairs_than_the_bands():
    default = {k: v.default for k, v in inspect.signature(M.classes).parameters.items()}
    n, p = default["bands"] * default["rows"], default["threshold"]
    least = math.ceil(default["sample_floor"] * n)
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
    assert missed < 1e-6 < (1 - p ** default["rows"]) ** default["bands"]
