import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from timberline.llm import packing as P
from timberline.llm.defaults import TOKENIZER


def test_ids_are_those_of_the_tokenizers_library(spark, sf):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a  b \n\n c\t", "it's we'll <|endoftext|> x", "日本語テキスト 123", "é" * 40, "\x00\x01", "a" * 300, "😀😀 ok", "x\u00a0y \u2003z"]
    for x in texts:
        assert P.encode(x, TOKENIZER).tolist() == t.encode(x, add_special_tokens=False).ids
    rng = random.Random(1)
    long = "".join(rng.choice(["word", " ", "  ", "\n", "é", "12", "!?", "\u3000"]) for _ in range(120000))
    assert len(long) > P.PART_CHARS and P.encode(long, TOKENIZER).tolist() == t.encode(long, add_special_tokens=False).ids


def test_cut():
    for n in range(1, 5000):
        pieces = P.cut(n, 1024)
        assert sum(pieces) == n and max(pieces) <= 1024 and all(pieces)


def _check(rows, lengths, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    return by_doc, by_seq


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.pack(docs, TOKENIZER).collect()
    by_doc, by_seq = _check(got, None)
    for r in docs.collect():
        ids = np.append(P.encode(r["text"], TOKENIZER), np.uint32(0))
        at = 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].astype("<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    used = sum(r["length"] for r in got)
    assert used / (1024 * len(by_seq)) > 0.98


def test_harmonic_bins_hold_a_fixed_number_of_pieces():
    packer, rows = P.HarmonicPacker(1024, 10), []
    for i in range(200):
        rows += packer.add(i, np.full(340, i, np.uint32))
    counts = defaultdict(int)
    for r in rows:
        counts[r[5]] += 1
        assert 1024 // r[2] >= counts[r[5]]
    rows += packer.close()
    assert sum(r[2] for r in rows) == 200 * 340 and packer.close() == []


def _plain(lengths, capacity):
    """Pieces (document, start, length) of each sequence, by the rules: reciprocal shares, classes of fixed count, the rest end to end."""
    bins, waiting = [], defaultdict(list)
    for doc, n in enumerate(lengths):
        start = 0
        while start < n:
            left = n - start
            if left >= capacity:
                size = capacity
            elif left <= capacity // 32:
                size = left
            else:  # the largest share capacity / k that fits
                size = next(capacity // k for k in range(1, capacity + 1) if capacity <= k * left)
            mates = waiting[capacity // size]
            mates.append((doc, start, size))
            if len(mates) == capacity // size:
                bins.append(waiting.pop(capacity // size))
            start += size
    rest, room = [], capacity
    for k in sorted(waiting):
        for doc, start, size in waiting[k]:
            while size:
                part = min(size, room)
                rest.append((doc, start, part))
                start, size, room = start + part, size - part, room - part
                if not room:
                    bins.append(rest)
                    rest, room = [], capacity
    return bins + ([rest] if rest else [])


@pytest.mark.parametrize("seed,capacity", [(1, 1024), (2, 64), (3, 100), (4, 32)])
def test_packer_against_plain_rules(seed, capacity):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randrange(1, 60), rng.randrange(1, 3 * capacity), capacity]) for _ in range(400)]
    packer, rows = P.HarmonicPacker(capacity, 5), []
    for doc, n in enumerate(lengths):
        rows += packer.add(doc, np.arange(n, dtype=np.uint32))
    rows += packer.close()
    got = defaultdict(list)
    for doc, start, size, crc, total, sequence, offset in rows:
        assert total == lengths[doc] and offset == sum(x[2] for x in got[sequence])
        assert crc == zlib.crc32(np.arange(start, start + size, dtype="<u4").tobytes())
        got[sequence].append((doc, start, size))
    assert sorted(got) == list(range(5, 5 + len(got))) and [got[s] for s in sorted(got)] == _plain(lengths, capacity)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b c", 5), (3, "a b c", 5), (None, "x", 5)], "doc_id long, text string, length int")
    got = P.pack(docs, TOKENIZER).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 4), (3, 4)]
    _check(got, None)
    assert P.pack(docs.limit(0), TOKENIZER).count() == 0
