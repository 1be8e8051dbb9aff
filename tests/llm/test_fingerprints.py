import hashlib
import random

from pyspark.sql import functions as F

from timberline.llm import fingerprints as P


def _shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    x, y = _shingles(a), _shingles(b)
    return 1.0 if a == b else len(x & y) / len(x | y) if x and y else 0.0


def _edited(t, n):
    k = len(t) // 3
    return t[: len(t) - k] + n[:k]


def _run(spark, rows):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")
    return {r["doc_id"]: r for r in P.compare(docs).collect()}


def _check(got, rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        e, r = _edited(t, after), got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        for name, other in (("near_edited", e), ("near_next", after)):
            assert 0 <= r[name] <= 1
            errors.append(abs(r[name] - _jaccard(t, other)))
    return errors


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_ROWS", 2)  # many ranges
    rng = random.Random(1)
    rows = []
    for i in range(200):
        rows.append((i * i * 7 + 3, " ".join(rng.choice(["alpha", "βeta", "gamma", "δ", "eps"]) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 400)))))
    rows += [(10**12, rows[5][1]), (10**12 - 1, rows[5][1])]
    got = _run(spark, rows)
    errors = _check(got, rows)
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    assert got[10**12]["near_next"] == 1.0 and got[10**12]["fingerprint"] == got[10**12 - 1]["fingerprint"] == got[rows[5][0]]["fingerprint"]
    assert all(len(r["fingerprint"]) == P.BINS for r in got.values())


def test_real_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    errors = _check(_run(spark, rows), rows)
    assert sum(errors) / len(errors) < 0.03


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two three"), (5, " \n "), (6, "a b c d e"), (7, "a b c d e f"), (8, "🙂🙂🙂 x"), (-5, "neg")]
    got = _run(spark, rows)
    _check(got, rows)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[5]["fingerprint"] == ""
    assert got[2]["near_next"] == 1.0 and got[3]["near_next"] == 0.0
    alone = _run(spark, [(1, "only this text here now")])
    assert alone[1]["near_next"] == 1.0
    assert _run(spark, []) == {}
    docs = spark.createDataFrame([(None, "x y z"), (1, "p q r"), (1, "p q r"), (None, None)], "doc_id long, text string")
    assert P.compare(docs).count() == 4


def test_densification_keeps_the_estimate_for_short_texts(spark):
    rng = random.Random(3)
    errors = []
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(25)]
        rows += [(2 * i + 1, " ".join(base)), (2 * i, " ".join(base[:20] + [f"v{rng.randrange(10**6)}" for _ in range(5)]))]
    got = _run(spark, rows)
    text = dict(rows)
    for i in range(60):
        errors.append(got[2 * i + 1]["near_next"] - _jaccard(text[2 * i + 1], text[2 * i]))
    assert abs(sum(errors) / len(errors)) < 0.06


def test_ranges_follow_the_rows(spark, monkeypatch):
    """No range holds more rows than MOST_ROWS in the mean, however large the table; heads by shuffle too."""
    for rows in (1, 10**4, 10**6, 10**9, 10**11):
        ranges = P.COARSE * P.parts_of(rows)
        assert rows / ranges <= P.MOST_ROWS and ranges <= max(P.MANY, 2 * rows // P.MOST_ROWS, P.COARSE)
    monkeypatch.setattr(P, "LEAST_ROWS", 1)
    monkeypatch.setattr(P, "MOST_ROWS", 2)
    monkeypatch.setattr(P, "MANY", 8)
    rng = random.Random(4)
    rows = [(rng.randrange(10**9) if i % 2 else i, " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(300)]
    _check(_run(spark, rows), rows)


def test_least_id_and_long_text(spark):
    """The least 64-bit id is an id, and comes before null ids; a text of 200,000 words is whole."""
    low = -(1 << 63)
    rows = [(low, "the least of all ids here"), ((1 << 63) - 1, "w " * 200_000 + "end"), (0, "zero")]
    got = _run(spark, rows)
    assert set(got) == {i for i, _ in rows}
    _check(got, rows)
    docs = spark.createDataFrame([*rows, (None, "a null id")], "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("z", F.lit("z"))
    after = {r["doc_id"]: r["edited_sha256"] for r in P.compare(docs).collect()}
    assert after[low] == hashlib.sha256(_edited(rows[0][1], "a null id").encode()).hexdigest()
    assert after[None] == hashlib.sha256(_edited("a null id", rows[1][1]).encode()).hexdigest()
