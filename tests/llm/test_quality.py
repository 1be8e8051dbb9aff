import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timberline.llm import quality as Q
from timberline.llm.defaults import held_out


def test_features_by_hand():
    text = "THE cat!\nthe cat |\nTHE cat!"
    x = dict(zip(Q.FEATURES, Q.features(pa.array([text, None, ""]))[0]))
    n = len(text)
    assert np.isclose(x["log_bytes"], np.log1p(n)) and np.isclose(x["log_words"], np.log1p(7)) and np.isclose(x["log_lines"], np.log1p(3))
    assert np.isclose(x["upper_share"], 6 / n) and np.isclose(x["exclaim_share"], 2 / n) and np.isclose(x["pipe_share"], 1 / n)
    assert np.isclose(x["word_variety"], 5 / 7) and np.isclose(x["line_variety"], 2 / 3) and np.isclose(x["longest_repeat"], 2 / 7)
    assert not Q.features(pa.array([None, ""]))[:, :3].any()


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["one two two\nthree", None, "x " * 300000, "a\n\nb\na", "é è é"]
    together = Q.features(pa.array(texts))
    assert np.allclose(together, np.vstack([Q.features(pa.array([t], pa.string())) for t in texts]))


def test_pairs_end_with_their_text():
    """A text's features are the same alone, and beside texts that go on with other or the same words."""
    texts = ["a b a", "b c", "a b a", "z", "", "a b", "a b", None, "a b a\n"]
    alone = {t: Q.features(pa.array([t], pa.string()))[0] for t in texts}
    for order in (texts, texts[::-1], sorted(t or "" for t in texts)):
        assert np.array_equal(Q.features(pa.array(order, pa.string())), np.array([alone.get(t, alone[None]) for t in order]))


def _by_definition(text):
    """The features of a text, word by word and byte by byte."""
    b = (text or "").encode()
    lines = [x for x in b.split(b"\n")]
    lines = lines[:-1] if lines[-1] == b"" else lines
    words = b.split()
    pairs = list(zip(words, words[1:])) + [(w,) for w in words[-1:]]
    full, per, rows = max(len(b), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda test: sum(map(test, b)) / full
    kind = [
        lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: chr(c) in "#$%&*+<=>@\\^_`{}~[]/", lambda c: chr(c) in ".,;:'\"()-?",
        lambda c: c == 33, lambda c: c == 124, lambda c: c >= 128, lambda c: c in b" \t\n\r\x0b\x0c",
    ]
    return [
        np.log1p(len(b)), np.log1p(len(words)), np.log1p(len(lines)), len(b) / per, len(words) / rows, *[share(k) for k in kind],
        len(set(words)) / per, len(set(pairs)) / per, len({tuple(x.split()) for x in lines}) / rows, max((words.count(w) for w in set(words)), default=0) / per,
    ]


def test_score_by_definition(spark, sf):
    """Every document's score, from features taken by definition and one look-up a table, is the operator's."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, train=~held_out())
    got = {(r["doc_id"], r["text"]): r["score"] for r in Q.score(docs, model, out="score").collect()}
    for (_, text), score in got.items():
        x = _by_definition(text)
        at = [sum(v >= c for c in cuts) for v, cuts in zip(x, model.cuts)]
        z = model.base + sum(t[i] for t, i in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert np.isclose(1 / (1 + np.exp(-z)), score)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((3000, len(Q.FEATURES)))
    x[:, :2] = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit_table(x[:2000], y[:2000])
    # a bin of either feature that straddles the cut costs a thirty-second of the rows
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    z = m.base + sum(t[m.bins(x)[:, f]] for f, t in enumerate(m.tables)) + sum(t[m.bins(x)[:, i], m.bins(x)[:, j]] for i, j, t in m.pairs)
    assert np.allclose(1 / (1 + np.exp(-z)), m.score(x))


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs.filter(held_out()), Q.fit(docs, labels, train=~held_out()), out="score").join(labels, "doc_id")
    right = got.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "word " * 9, 3), (3, "word " * 9, 3), (None, "x", 3)], "doc_id long, text string, quality_score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["quality_score"] for r in Q.score(docs, Q.fit(docs, none)).collect()] == [0.5] * 5
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, None), (99, 0), (None, 0)], "doc_id long, quality int")
    got = [r["quality_score"] for r in Q.score(docs, Q.fit(docs, ones)).collect()]
    assert all(0.9 < g <= 1 for g in got) and got[2] == got[3]
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), ones)).count() == 0
