import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timberline.llm import language_id as L
from timberline.llm.defaults import held_out

TEXTS = {"en": "the cat and the dog with that thing is there", "fr": "le chat est dans la maison avec une rose où vous êtes"}


def _docs(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(words, 30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs, train=~held_out())
    found = L.identify(docs.filter(held_out()), model)
    share = found.agg(F.avg((F.col("language.lang") == F.col("lang")).cast("double")), F.avg(F.col("language.rejected").cast("double"))).first()
    assert share[0] >= 0.98 and share[1] <= 0.02


def test_sums_by_piece_equal_sums_by_text(spark):
    """The fast path over joined buffers gives what counting each text alone gives."""
    model = L.fit(_docs(spark))
    column = pa.array(["the cat", "", None, "été à la maison " * 50000, "1 2 3", "x", "the dog\nand"])
    z, seen = model.logits(column)
    for i, (ids, n) in enumerate(L._counts(column)):
        assert n.sum() == seen[i]
        want = (model.table[ids].astype(float) * n[:, None]).sum(axis=0) / max(1, n.sum()) + model.bias
        assert np.allclose(z[i], want, atol=1e-4)


def test_edges(spark):
    model = L.fit(_docs(spark))
    rows = [(1, None, "en", 7), (2, "", None, 7), (3, "123 ###", "en", 7), (4, "the cat and the dog", None, 7), (4, "the cat and the dog", None, 7), (None, "le chat dans la maison", "fr", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    got = L.identify(docs, model).collect()
    by = [(r["doc_id"], r["language"]["lang"], r["language"]["rejected"]) for r in got]
    assert by[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert by[3] == by[4] == (4, "en", False) and by[5][1] == "fr"
    assert all(0 <= r["language"]["score"] <= 1 for r in got)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    empty = docs.limit(0)
    assert L.identify(empty, model).count() == 0
    assert [r["language"]["lang"] for r in L.identify(docs, L.fit(empty)).collect()] == ["und"] * 6


def test_learns_from_the_stated_number_of_texts(spark, monkeypatch):
    """README: at most 3,000 labelled texts; a fifth of them is kept out of the training."""
    learned = []
    monkeypatch.setattr(L, "_sgd", lambda rows, labels, k, *_: (learned.append(len(rows)), (np.zeros((L.BUCKETS, k)), np.zeros(k)))[1])
    L.fit(_docs(spark, 4000))
    assert learned == [2400]


def test_sample_is_bounded_in_bytes_and_reruns_agree(spark, monkeypatch):
    docs = _docs(spark, 400)
    seen = []
    real = L._settled
    monkeypatch.setattr(L, "_settled", lambda rows, labels, *a: (seen.append((sum(i.nbytes + n.nbytes for i, n in rows), set(labels.tolist()))), real(rows, labels, *a))[1])
    a, b = L.fit(docs, sample_bytes=20000), L.fit(docs.repartition(7), sample_bytes=20000)
    assert all(0 < size <= 20000 and kinds == {0, 1} for size, kinds in seen)
    assert np.array_equal(a.table, b.table) and (a.temperature, a.threshold) == (b.temperature, b.threshold)
    L.fit(docs, sample_bytes=1)  # one text a language
    assert seen[-1][1] == {0, 1}


def test_many_languages_that_texts_cannot_tell_apart(spark):
    """200 labels on the same words: finite, every one learned, scores from 0 to 1."""
    rng = np.random.default_rng(3)
    words = TEXTS["en"].split()
    rows = [(i, " ".join(rng.choice(words, 12)), f"l{i % 200:03d}") for i in range(2000)] + [(5000 + i, "le chat est dans la maison", "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert len(model.languages) == 201 and np.isfinite(model.table).all() and np.isfinite(model.bias).all()
    got = L.identify(docs, model).collect()
    assert all(0 <= r["language"]["score"] <= 1 for r in got)


def test_every_language_has_rows(spark, monkeypatch):
    """Ten rare languages beside 110 frequent ones."""
    rows = [(i, f"word{i % 110} and more{i}", f"big{i % 110:03d}") for i in range(110 * 60)] + [(100000 + i, f"rare{i % 10} text", f"rare{i % 10}") for i in range(50)]
    seen = []
    real = L._settled
    monkeypatch.setattr(L, "_settled", lambda data, labels, k, *a: (seen.append(np.bincount(labels, minlength=k)), real(data, labels, k, *a))[1])
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=1)
    assert len(model.languages) == 120 and seen[0].min() >= 1


def _by_definition(text, model):
    """Subword by subword, in plain Python: the language, its probability, whether it is rejected."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    fold = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f"{text.lower()}".encode())
    found = []
    padded = b" " + fold + b" "
    for n in L.SIZES:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if 32 in gram[1:-1] or gram[0] == gram[-1] == 32:
                continue
            h = n * 0x1656_67B1 & 0xFFFF_FFFF
            for j, c in enumerate(gram):
                h = (h ^ c) * int(L._LANE[j]) & 0xFFFF_FFFF
                h ^= h >> 15
            found.append(h % L.BUCKETS)
    z = (sum(model.table[b].astype(float) for b in found) / max(1, len(found)) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], p.max(), p.max() < model.threshold


def test_predictions_by_definition(spark):
    model = L.fit(_docs(spark))
    texts = ["the cat", "Le Chat ÉTAIT là", "x", "a b c", "", None, "123", "the dog\n\tand 4 dogs", "où êtes-vous?"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in L.identify(docs, model).collect():
        lang, score, rejected = _by_definition(r["text"], model)
        assert (r["language"]["lang"], r["language"]["rejected"]) == (lang, rejected) and np.isclose(r["language"]["score"], score, atol=1e-4)
