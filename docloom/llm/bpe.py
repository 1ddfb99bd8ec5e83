"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is a parameter; the driver reads it once and sends its bytes to
the executors (MAX_RANK_BYTES bounds them), so executors need no copy of it.

Texts longer than CHUNK characters are cut at places which no match of the
split pattern can span, and each piece is encoded by itself: the ids are those
of the whole text, while the library's working memory stays that of a piece.
A text without such a place (one run of letters, say) is encoded in one piece.

Defined results: a null text counts as empty; an empty text has no ids and the
digests of the empty string; special-token strings are ordinary text; repeated
rows give repeated results; an empty table gives an empty table.  Input columns
other than the named ones never matter; an input column named like an output
column of encode() or decode() is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_arrow, map_texts

#: Characters after which a text is cut at the next safe place.
CHUNK = 1 << 16
#: Largest rank file that is sent to executors.
MAX_RANK_BYTES = 64 << 20

# White space as the library's regular expressions know it (Unicode White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Every alternative of the split pattern ends before white space that follows another
# character, and before an ASCII mark that follows a letter.
_SAFE = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])|(?<=[A-Za-zぁ-ゖ一-鿿가-힣])(?=[!-/:-@\\[-`{{-~])")


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """text in parts of a little over chunk characters, cut where no match spans the cut."""
    start = 0
    while len(text) - start > chunk:
        found = _SAFE.search(text, start + chunk)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(text: str, ranks: bytes, pattern: str, chunk: int = CHUNK) -> np.ndarray:
    enc = encoding(ranks, pattern)
    parts = [np.asarray(enc.encode_to_numpy(p), dtype="<u4") for p in pieces(text, chunk)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(ids: np.ndarray, ranks: bytes, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(ids.tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of ids (array<int>) of the text column."""
    ranks = load_ranks(ranks_path)
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [encode_text(t or "", ranks, pattern).astype(np.int32) for t in part.column(text).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, out])

    return map_texts(rest, schema, work, text)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) of its ids column; a null list counts as empty."""
    ranks = load_ranks(ranks_path)
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            found = [decode_ids(np.asarray(x or [], dtype=np.int64), ranks, pattern) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return map_arrow(rest, run, schema)


def digests(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256 and decoded_sha256, without keeping the ids of more than one piece."""
    ranks = load_ranks(ranks_path)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, coded, decoded = [], [], []
        for t in part.column(text).to_pylist():
            n, a, b = 0, hashlib.sha256(), hashlib.sha256()
            for piece in pieces(t or ""):
                ids = encode_text(piece, ranks, pattern, len(piece) + 1)
                n += len(ids)
                a.update(ids.tobytes())
                b.update(decode_ids(ids, ranks, pattern))
            counts.append(n)
            coded.append(a.hexdigest())
            decoded.append(b.hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_texts(rows, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work).withColumnRenamed("key", key)


__all__ = ["decode", "decode_ids", "digests", "encode", "encode_text", "load_ranks", "pieces"]
