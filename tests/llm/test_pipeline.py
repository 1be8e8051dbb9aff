import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_language_id import _by_definition as by_language
from test_line_dedup import _brute as by_lines
from test_minhash_dedup import _brute as by_pairs
from test_mixing import _served as in_order
from timberline.llm import language_id as L
from timberline.llm import packing as P
from timberline.llm import registry
from timberline.llm.defaults import TOKENIZER, held_out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, kept[-1], sf)
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    columns = [set(k.columns) for k in kept]
    assert all(c == columns[0] for c in columns[:-1])
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert len(ids[1]) >= 0.98 * len(ids[0]) and ids[2] <= ids[1] and ids[3] < ids[2]
    assert kept[2].filter(F.col("n_chars") != F.length("text")).count() == 0
    assert ids[5] == ids[4]  # packing drops no document
    copies = {r["doc_id"]: r["n"] for r in kept[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    pieces = defaultdict(int)
    total = {}
    for r in kept[5].collect():
        pieces[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert all(pieces[d] == copies[d] * total[d] for d in copies) and max(copies.values()) <= 2


def test_stages_begin_with_free_executors(monkeypatch):
    class Freed(Exception):
        pass

    def free(spark):
        raise Freed

    monkeypatch.setattr(C, "free_executors", free)
    for _, stage in C.STAGES:
        with pytest.raises(Freed):
            stage(None, None, "")


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    order = want.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[k] for k in order)) for r in got.collect())


def test_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]


def _stage(spark, name, df):
    out = dict(C.STAGES)[name](spark, df, "")
    rows = out.collect()
    return spark.createDataFrame(rows, df.schema) if out.columns == df.columns else out, rows


def _make(spark):
    """Two languages, shared lines, exact and near copies, nulls, repeated ids and rows, names that clash."""
    rng = random.Random(8)
    words = {"en": [f"the{i}ing" for i in range(300)], "fr": [f"leçon{i}é" for i in range(300)]}
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        lines = [" ".join(rng.choice(words[lang]) for _ in range(12)) for _ in range(8)]
        lines += ["read more about it on the other pages"] * (i % 3 == 0) + ["click"] * (i % 4 == 0)
        rows.append([i, "\n".join(lines), lang, f"s{i % 12}"])
    for i in range(40):  # copies and near copies
        base = rows[i % 10][1].split("\n")
        if i % 2:
            base[3] = base[3].replace(base[3].split()[0], "changed", 1)
        rows.append([200 + i, "\n".join(base), rows[i % 10][2], f"s{i % 5}"])
    rows += [[300, None, "en", None], [301, "", None, "s1"], [302, "123 456 !!", "fr", "s2"], [303, "lone line of words here", None, None], [None, rows[3][1], "fr", "s3"]]
    rows += [list(rows[5]), [5, " ".join(rng.choice(words["en"]) for _ in range(40)), "en", "s4"], [304, " ".join(rng.choice(words["en"]) for _ in range(40_000)), "en", "s7"]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h int, id string, size int, finish double, class_id long"
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, "x", 2, 0.5, 9) for r in rows], schema)


def _key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_against_brute_force(spark):
    """Each stage's rows, on all that its predecessor kept, are those of a plain version."""
    docs = _make(spark)
    # language: subword by subword, with the model that the stage fits
    model = L.fit(docs, train=~held_out())
    identified, rows = _stage(spark, "language_id", docs)
    want = [r for r in docs.collect() if not by_language(r["text"], model)[2]]
    assert _key(rows) == _key(want) and 100 < len(rows) < docs.count()
    # lines
    cleaned, rows = _stage(spark, "line_dedup", identified)
    before = [(r["doc_id"], r["text"], r["source"]) for r in want]
    after = by_lines(before)
    assert sorted(map(str, _key(rows))) == sorted(str((i, t)) for (i, t), (_, was, _) in zip(after, before) if t == was or (t or "").strip())
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    # near copies: an id that has two texts is two documents
    kept, rows = _stage(spark, "minhash_dedup", cleaned)
    before = sorted({(r["doc_id"], r["text"]) for r in cleaned.collect() if r["doc_id"] is not None})
    twice = {i for i, _ in before if sum(j == i for j, _ in before) > 1}
    assert twice == {5}
    names = {(i, t): 10_000 + n if i in twice else i for n, (i, t) in enumerate(before)}
    classes = by_pairs([(names[x], x[1]) for x in before])
    got = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    assert len(got) == len(set(got)) == len(set(classes.values())) and {classes[names[x]] for x in got} == set(classes.values())
    doubtful = {classes[names[x]] for x in before if x[0] in twice}  # there a hash may be the least id
    assert [x for x in sorted(got) if classes[names[x]] not in doubtful] == [x for x in before if classes[names[x]] == names[x] and names[x] not in doubtful]
    # mixing: each copy is served in the order of virtual finish times
    mixed, rows = _stage(spark, "mixing", kept)
    source = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    taken = [t // n if n else 0 for _, n, _, _, t in in_order(source)]
    assert _key(rows) == sorted((x[:2] for x, n in zip(source, taken) for _ in range(n)), key=str)
    # packing: every id of every row lies in one piece
    _, pieces = _stage(spark, "packing", mixed)
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += len(P.encode(r["text"], TOKENIZER)) + 1
    have = Counter()
    for r in pieces:
        have[r["doc_id"]] += r["length"]
    assert have == want


def test_stages_on_an_empty_table(spark):
    docs = _make(spark).limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        docs = spark.createDataFrame([], out.schema)
