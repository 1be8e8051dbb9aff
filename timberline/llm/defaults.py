"""What the queries and the pipeline have in common."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the CRC-32 of its id; models never learn from these."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
