"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, unused

#: A long text is cut into pieces of about this many characters.
PIECE_CHARS = 1 << 16
#: Longer white space runs overflow the stack of tiktoken's regex engine.
LONG_SPACE = 4096
#: A rank file is broadcast, so its size is checked.
MAX_RANK_BYTES = 64 << 20

SPACE = r"[\t-\r\x20\x85\xa0  -     　]"
SAFE = regex.compile(r"[\p{L}\p{N}][\x20\n]")
LONG_RUN = regex.compile(SPACE + "{%d}" % LONG_SPACE)


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, refused above ``MAX_RANK_BYTES``."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is over {MAX_RANK_BYTES} bytes")
    return data


@lru_cache(2)
def encoding(data: bytes, pattern: str):
    """One tiktoken encoding for each Python worker and rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` where no match of the pattern can reach across.

    No alternative of the pattern takes white space after a letter or digit, so
    the place between such a character and a blank or line feed is a match
    boundary whatever stands around it. Without such a place the piece grows.
    """
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def encode_text(enc, pattern: str, text: str | None) -> list[int]:
    ids: list[int] = []
    for part in pieces(text or ""):
        if LONG_RUN.search(part):
            for m in regex.finditer(pattern.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\s", SPACE).replace(r"\S", "[^" + SPACE[1:]), part):
                ids += enc._encode_single_piece(m[0].encode())
        else:
            ids += enc.encode_ordinary(part)
    return ids


def bpe_encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give zero ids. Special tokens are never made. A column
    already named ``out`` is replaced, all others stay. Packed ids keep a row at
    four bytes an id; ``unpack_ids`` gives an array. The file is read once on
    the driver (size checked) and broadcast, so executors need no copy.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        enc = encoding(shared.value, pattern)
        for texts in batches:
            yield pd.Series([np.array(encode_text(enc, pattern, t), dtype="<u4").tobytes() for t in texts], dtype=object)

    return df.withColumn(out, encode(F.col(text)))


def bpe_decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of packed ids, exactly as encoded (no UTF-8 repair).

    Null ids give empty bytes; an id outside the vocabulary raises.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        enc = encoding(shared.value, pattern)
        for packed in batches:
            yield pd.Series([enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in packed], dtype=object)

    return df.withColumn(out, decode(F.col(ids)))


def bpe_round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add both ``ids``, as ``bpe_encode`` does, and ``decoded``, the bytes that ``bpe_decode`` makes of them, in one pass.

    Columns already so named are replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("struct<ids:binary,decoded:binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        enc = encoding(shared.value, pattern)
        for texts in batches:
            packed = [np.array(encode_text(enc, pattern, t), dtype="<u4").tobytes() for t in texts]
            yield pd.DataFrame({"ids": packed, "decoded": [enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in packed]})

    made = unused("bpe", df)
    return df.withColumn(made, both(F.col(text))).withColumns({ids: F.col(f"{made}.ids"), decoded: F.col(f"{made}.decoded")}).drop(made)


def unpack_ids(packed: Column) -> Column:
    """Packed ids as ``array<long>``, by built-in functions; null or empty gives an empty array."""
    byte = lambda i, k: F.conv(F.hex(F.substring(packed, i * 4 + k, F.lit(1))), 16, 10).cast("long")
    last = (F.octet_length(packed) / 4).cast("int") - 1
    some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65536 + byte(i, 4) * 16777216)
    return F.when(F.coalesce(last, F.lit(-1)) < 0, F.array().cast("array<bigint>")).otherwise(some)
