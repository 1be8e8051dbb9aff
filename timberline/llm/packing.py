"""Packing token sequences: harmonic packing into bins of a fixed capacity.

A document's ids are cut into pieces so that each piece fills a reciprocal share of the capacity: full bins first, then
the largest 1/k share that fits the rest, until the rest is short (at most capacity / 32), which stays one piece. A
piece of length l belongs to class k = capacity // l, and each bin of class k holds exactly k pieces. Every worker fills
its own bins, class by class. What is left in a worker's open bins at its end is laid end to end and cut at the
capacity, so a worker pads at most one bin besides the few ids that k pieces leave (at most 1/32).

Defined results: a null or empty text is its end-of-document id alone; repeated rows are packed each on its own; an
empty table gives no piece.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm._shared import bound_batches, tidy

SHORT = 32
# Texts longer than this are tokenised in parts, cut where white space begins: no token reaches over such a place.
PART_CHARS = 1 << 17
_CUT = regex.compile(r"(?<=\S)(?=\s)")

# The byte-level alphabet of byte-level BPE vocabularies: printable Latin-1 stands for itself, the rest from 256 up.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_LETTER = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def encoder(path: str):
    """text -> ids (numpy) for a byte-level BPE vocabulary in the tokenizers library's JSON format.

    The ids are those of that library; a merge's rank is the id it makes, so the same vocabulary runs in the faster
    tiktoken engine. A vocabulary whose merges are in another order is run by the tokenizers library itself.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, special = data["model"], {t["content"] for t in data.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [vocab.get(a + b, -1) for a, b in merges]
        byte_level = (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not (data.get("pre_tokenizer") or {}).get("add_prefix_space")
        if byte_level and not data.get("normalizer") and made == sorted(made) and -1 not in made and all(c in _LETTER for t in vocab for c in t):
            import tiktoken

            ranks = {bytes(_LETTER[c] for c in t): i for t, i in vocab.items()}
            _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _encoders[path] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit numbers, long texts in parts."""
    run, text = encoder(path), text or ""
    if len(text) <= PART_CHARS:
        return np.array(run(text), np.uint32)
    parts, a = [], 0
    while a < len(text):
        found = _CUT.search(text, a + PART_CHARS) if a + PART_CHARS < len(text) else None
        b = found.start() if found else len(text)
        parts.append(np.array(run(text[a:b]), np.uint32))
        a = b
    return np.concatenate(parts)


def cut(length: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``length`` ids: full bins, reciprocal shares, a short rest."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest > capacity // SHORT:
        share = capacity // -(-capacity // rest)
        out.append(share)
        rest -= share
    return out + [rest] * (rest > 0)


class HarmonicPacker:
    """One worker's bins. add() and close() give rows (key, start, length, crc, total, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list] = {}

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        """Rows of the bins that this document's pieces fill."""
        rows, start = [], 0
        for n in cut(len(ids), self.capacity):
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((key, start, ids[start : start + n], len(ids)))
            start += n
            if len(held) == k:
                rows += self._bin(self.open.pop(k))
        return rows

    def _bin(self, pieces: list) -> list[tuple]:
        number, at, rows = self._number(), 0, []
        for key, start, ids, total in pieces:
            rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
            at += len(ids)
        return rows

    def close(self) -> list[tuple]:
        """Rows of the bins that never filled: their pieces laid end to end, cut at the capacity."""
        rows, held, room = [], [], self.capacity
        for k in sorted(self.open):
            for key, start, ids, total in self.open[k]:
                while len(ids):
                    part = ids[:room]
                    held.append((key, start, part, total))
                    start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                    if not room:
                        rows += self._bin(held)
                        held, room = [], self.capacity
        if held:
            rows += self._bin(held)
        self.open = {}
        return rows


SCHEMA = "{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row a piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Other columns, whatever their names, are left behind. sequence_id holds the worker's partition number in its upper
    bits. No shuffle: each input partition is packed where it is read.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 40)
        names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        key_type = None

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names)

        for batch in batches:
            key_type = batch.column("k").type
            rows = []
            for key, text in zip(batch.column("k").to_pylist(), batch.column("t")):
                rows += packer.add(key, np.append(encode(text.as_py(), tokenizer_path), np.uint32(end_id)))
            if rows:
                yield batch_of(rows)
        rows = packer.close()
        if rows:
            yield batch_of(rows)

    return narrow.mapInArrow(tidy(run), SCHEMA.format(key="k", kind=kind)).withColumnRenamed("k", id_col)
