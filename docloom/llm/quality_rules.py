"""Quality rules: counted rules, then a log-likelihood ratio of hashed n-grams.

The verdict compares two multinomials over hashed word n-grams (one and two
words, upper and lower case kept apart, BUCKETS buckets, add-SMOOTHING): that
of the trusted target (documents with a positive label) and that of the raw
corpus (all documents).  Words and pairs have halves of the buckets of their own.  The score of a text is the mean over its n-grams of
log p_target - log p_raw; it is kept if the score is at least THRESHOLD and no
counted rule fails it.  Both multinomials count whole documents, all of them;
they are tables of fixed size.  Labels are joined by broadcast while they have
at most BROADCAST_ROWS distinct ids, and by a shuffle beyond.

Defined results: a null text has no words; a text of fewer than 20 words fails
the counted rules; equal lines and windows are compared by their bytes; without
trusted documents the ratio is 0 and says nothing; an id with several labels is
trusted if one is positive; a null id is never trusted; repeated rows give
repeated results and count each time; texts may be of any length and are read
whole; a score at the threshold is kept; an empty table gives an empty table;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_broadcast, map_arrow, map_texts

BUCKETS = 1 << 18
#: Counts travel in blocks of so many buckets.
BLOCK = 1 << 12
SMOOTHING = 1.0
THRESHOLD = -0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Words:
    """The words of a slice of texts, numbered; start has where each text begins, and the end."""

    numbers: np.ndarray
    start: np.ndarray
    hashes: np.ndarray  # of each number


def number_words(texts: list[bytes]) -> Words:
    known: defaultdict[bytes, int] = defaultdict(count().__next__)  # numbers words as they come
    out, start = [], [0]
    for b in texts:
        out += map(known.__getitem__, b.split())
        start.append(len(out))
    return Words(np.array(out, dtype=np.int64), np.array(start), np.fromiter(map(zlib.crc32, known), dtype=np.uint64, count=len(known)))


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and of each pair that starts at a word (BUCKETS where the text ends)."""
    h = words.hashes[words.numbers] if len(words.numbers) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 2)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> shift
    two = np.full(len(h), BUCKETS, dtype=np.int64)
    if len(h) > 1:
        pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
        pair ^= pair >> np.uint64(29)
        two[:-1] = ((pair * np.uint64(0x165667B19E3779F9)) >> shift) + np.uint64(BUCKETS // 2)
    last = words.start[1:][words.start[1:] > words.start[:-1]] - 1
    two[last] = BUCKETS
    return one.astype(np.int64), two


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the number of words in windows that occur twice or more in the text."""
    texts = len(words.start) - 1
    n = len(words.numbers)
    if n < window:
        return np.zeros(texts, dtype=np.int64)
    # Numbers of runs of 1, 2, 4, 8 words: equal runs, equal numbers; exact, by doubling.
    ids, length = words.numbers, 1
    while length < window:
        step = min(length, window - length)
        a, b = ids[: len(ids) - step], ids[step:]
        ids = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
        length += step
    doc = np.repeat(np.arange(texts), np.diff(words.start))
    inside = doc[: len(ids)] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    key = doc[at] * (int(ids.max()) + 1) + ids[at]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[inverse] > 1]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[words.start[1:]] - sums[words.start[:-1]]


def duplicate_lines(b: bytes) -> int:
    if b"\n" not in b:
        return 0
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def trusted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """text and target (whether a positive label marks the row) of each row of docs."""
    ids = labels.where((F.col(label) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    marks = bounded_broadcast(ids.withColumn("target", F.lit(True)), ids.count())
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(marks, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))


def fit(marked: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from rows of text and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 200):
                for chosen, total in ((True, target), (False, raw)):
                    part = [t.encode("utf-8", "replace") for t, f in zip(texts[i : i + 200], flags[i : i + 200], strict=True) if t and f is chosen]
                    one, two = grams(number_words(part))
                    total += np.bincount(one, minlength=BUCKETS + 1) + np.bincount(two, minlength=BUCKETS + 1)
        raw += target  # the raw corpus holds the trusted documents too
        blocks = [i for i in range(BUCKETS // BLOCK) if raw[i * BLOCK : (i + 1) * BLOCK].any()]
        cols = [pa.array([x[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks], pa.binary()) for x in (raw, target)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *cols], names=["block", "raw", "target"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(block, np.zeros((2, BLOCK), dtype=np.int64))
                for i, x in enumerate(pair):
                    total[i] += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i in (0, 1))], names=["block", "raw", "target"])

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    schema = "block int, raw binary, target binary"
    for block, r, t in map_arrow(map_arrow(marked, run, schema).repartition(F.col("block")), add, schema).collect():
        raw[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(r), dtype=np.int64)
        target[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(t), dtype=np.int64)
    if not target.any():
        return np.zeros(BUCKETS)
    smooth = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return smooth(target) - smooth(raw)


def judge(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the key, the counts of the rules, base_failed, kept and the score llr (null without n-grams)."""
    table = docs.sparkSession.sparkContext.broadcast(np.append(ratio, 0.0))

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        raw = [t.encode("utf-8", "replace") for t in texts]
        words = number_words(raw)
        n = np.diff(words.start)
        one, two = grams(words)
        # Summed text by text, so that a score does not depend on the rows around it.
        total = np.bincount(np.repeat(np.arange(len(n)), n), table.value[one] + table.value[two], len(n))
        score = total / np.maximum(2 * n - 1, 1)
        repeats = repeated_words(words)
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        cols = [
            pa.array(n, pa.int64()),
            pa.array([len(t) - t.count(" ") - t.count("\n") - t.count("\t") - t.count("\r") - t.count("\x0b") - t.count("\x0c") for t in texts], pa.int64()),
            pa.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in raw], pa.int64()),
            pa.array([duplicate_lines(b) for b in raw], pa.int64()),
            pa.array(repeats, pa.int64()),
            pa.array(failed),
            pa.array(~failed & (score >= threshold)),
            pa.array(score, pa.float64(), mask=n == 0),
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return map_texts(rows, schema, work).withColumnRenamed("key", key)
