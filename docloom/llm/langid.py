"""Language identification by nearest centroids.

A text becomes counts of hashed byte n-grams (1 to 4 bytes of its lower-cased
UTF-8, letters only, marks and digits as spaces), weighted by the square root
of the count and by inverse document frequency, and scaled to length one.
Training vectors of each language are clustered (spherical k-means); a text
takes the language of the centroid with the largest cosine.  A text whose
cosine is below the radius of its centroid is rejected: the radius is
RADIUS_SHARE of a low quantile (RADIUS_QUANTILE) of the cosines of all training
rows nearest to that centroid among those of their language, so that a few odd
rows do not widen it.  A centroid with fewer than RADIUS_ROWS such rows takes the
quantile of its language.

Document frequencies and radii come from every training row.  Centroids are fitted on a
bounded sample: about SAMPLE_PER_LANGUAGE rows of each language, those with the
smallest seeded hashes of the id.  The model is a table of a size that the
languages alone set: BUCKETS weights for each of CENTROIDS centroids of every
language (192 KB a language, whatever the number of rows).

Defined results: a null text or one without a letter is "und" with score 0 and
is rejected; ties go to the language first in code-point order; a null id is
neither held out nor trained on; rows without a language are not trained on; no
training rows: every text is "und".  Repeated rows give repeated results; texts
may be of any length and are read whole; an empty table gives an empty table;
further columns are kept, but for those of the names put out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_arrow, map_texts, slices

BUCKETS = 1 << 14
CENTROIDS = 3
SAMPLE_PER_LANGUAGE = 500
RADIUS_SHARE = 0.35
RADIUS_QUANTILE = 0.02
RADIUS_ROWS = 100
#: Steps of a cosine in which training rows are counted.
RADIUS_BINS = 512
UND = "und"

_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_PAD = b"    "
_GRAMS = ((1, 0xFF, 2654435761), (2, 0xFFFF, 2246822519), (3, 0xFFFFFF, 3266489917), (4, 0xFFFFFFFF, 668265263))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, a row for each n, and where each text starts in a row (one more at the end)."""
    parts, starts, at = [], [0], 0
    for t in texts:
        b = t.lower().encode("utf-8", "replace").translate(_SPACED) + _PAD
        parts.append(b)
        at += len(b)
        starts.append(at)
    data = np.frombuffer(b"".join(parts) + _PAD, dtype=np.uint8)
    n = at
    word = data[:n].astype(np.uint32) | data[1 : n + 1].astype(np.uint32) << 8 | data[2 : n + 2].astype(np.uint32) << 16 | data[3 : n + 3].astype(np.uint32) << 24
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    rows = np.empty((len(_GRAMS), n), dtype=np.uint16)
    for i, (_, mask, factor) in enumerate(_GRAMS):
        rows[i] = ((word & np.uint32(mask)) * np.uint32(factor)) >> shift
    return rows, np.array(starts)


def vectors(texts: list[str], weights: np.ndarray | None = None) -> np.ndarray:
    """A row of BUCKETS numbers for each text: counts, or weighted and scaled to length one."""
    rows, starts = _hashed(texts)
    out = np.empty((len(texts), BUCKETS), dtype=np.float32)
    for i in range(len(texts)):
        # The n-grams at the last spaces of the padding would reach into the next text.
        out[i] = np.bincount(rows[:, starts[i] : starts[i + 1] - 3].ravel(), minlength=BUCKETS)
    if weights is not None:
        np.sqrt(out, out=out)
        out *= weights
        out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _groups(texts: list[str], size: int = 64) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS
    centroids: np.ndarray  # rows of BUCKETS
    languages: list[str]  # of each row
    radius: np.ndarray  # of each row

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, cosines and whether each text is rejected."""
        langs, scores, rejected = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        live = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for group in _groups(live):
            cosines = vectors([texts[i] for i in group], self.weights) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, k, row in zip(group, best, cosines, strict=True):
                langs[i] = self.languages[k]
                scores[i] = float(min(1.0, max(0.0, row[k])))
                rejected[i] = bool(row[k] < self.radius[k])
        return langs, scores, rejected


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row, then rows far from those chosen."""
    first = int((x @ x.mean(axis=0)).argmax())
    chosen = [first]
    near = x @ x[first]
    while len(chosen) < min(k, len(x)):
        # Of the rows least like those chosen, one at the tenth percentile: the very last ones are odd.
        chosen.append(int(np.argsort(near, kind="stable")[len(x) // 10]))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c.astype(np.float32)


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if has_letter(t)]
            df[BUCKETS] += len(texts)
            for t in texts:
                hashed, _ = _hashed([t])
                seen = np.zeros(BUCKETS, dtype=bool)
                seen[hashed[:, :-3].ravel()] = True
                df[:BUCKETS] += seen
        live = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(df[live])], names=["bucket", "n"])

    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, n in map_arrow(rows, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total[:BUCKETS], int(total[BUCKETS])


def _quantile(counts: np.ndarray) -> float:
    """The lower edge of the step that holds the quantile."""
    seen = np.cumsum(counts)
    return float(np.searchsorted(seen, RADIUS_QUANTILE * seen[-1], side="right")) / RADIUS_BINS if seen[-1] else 0.0


def _radii(rows: DataFrame, weights: np.ndarray, centroids: np.ndarray, languages: list[str]) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast((weights, centroids, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centroids, languages = shared.value
        own = {name: np.array([i for i, x in enumerate(languages) if x == name]) for name in set(languages)}
        counts = np.zeros((len(languages), RADIUS_BINS), dtype=np.int64)
        for part in slices(batches, "text"):
            live = [(t, own[name]) for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True) if name in own and has_letter(t)]
            for group in _groups(live):
                cosines = vectors([t for t, _ in group], weights) @ centroids.T
                for (_, among), row in zip(group, cosines, strict=True):
                    k = among[row[among].argmax()]
                    counts[k, min(RADIUS_BINS - 1, max(0, int(row[k] * RADIUS_BINS)))] += 1
        k, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[k, step])], names=["centroid", "step", "n"])

    total = np.zeros((len(languages), RADIUS_BINS), dtype=np.int64)
    for k, step, n in map_arrow(rows.select("text", "lang"), run, "centroid int, step int, n long").groupBy("centroid", "step").agg(F.sum("n")).collect():
        total[k, step] = n
    whole = {name: sum(total[i] for i, x in enumerate(languages) if x == name) for name in set(languages)}
    return RADIUS_SHARE * np.array([_quantile(total[i] if total[i].sum() >= RADIUS_ROWS else whole[x]) for i, x in enumerate(languages)])


def fit(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learns from the rows of df for which train is true and lang is not null."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("centroids"), F.col(key)).alias("at")).where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not counts:
        return Model(weights, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    frequency, n = _document_frequencies(rows.select("text"))
    weights = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    weights[_hashed([""])[0].ravel()] = 0  # n-grams of spaces alone say nothing
    # at is uniform over the longs, so its range is cut at the share of a language's rows that is wanted.
    edge = F.create_map(*[F.lit(x) for name, c in counts.items() for x in (name, min(2**63 - 1, 2**64 * SAMPLE_PER_LANGUAGE // max(c, SAMPLE_PER_LANGUAGE) - 2**63))])
    sample = rows.where(F.col("at") <= edge[F.col("lang")]).select("lang", "at", "text")

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = part.column("text").to_pylist()
        live = [i for i, t in enumerate(texts) if has_letter(t)]
        for group in _groups(live):
            x = vectors([texts[i] for i in group], weights)
            nz = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(group)), part.column("at").take(pa.array(group)), pa.array([i.astype("<u2").tobytes() for i in nz], pa.binary()), pa.array([r[i].astype("<f2").tobytes() for r, i in zip(x, nz, strict=True)], pa.binary())],
                names=["lang", "at", "buckets", "numbers"],
            )

    found: dict[str, list] = {}
    for r in map_texts(sample, "lang string, at long, buckets binary, numbers binary", work).collect():
        found.setdefault(r["lang"], []).append((r["at"], bytes(r["buckets"]), bytes(r["numbers"])))
    centroids, languages = [], []
    for name in sorted(found):
        picked = sorted(set(found[name]))[: 2 * SAMPLE_PER_LANGUAGE]
        x = np.zeros((len(picked), BUCKETS), dtype=np.float32)
        for i, (_, b, v) in enumerate(picked):
            x[i, np.frombuffer(b, "<u2")] = np.frombuffer(v, "<f2")
        for row in _cluster(x, CENTROIDS):
            centroids.append(row)
            languages.append(name)
    if not centroids:
        return Model(weights, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    return Model(weights, np.array(centroids), languages, _radii(rows, weights, np.array(centroids), languages))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected; input columns of these names are replaced."""
    names = ("lang_pred", "score", "rejected")
    rest = df.drop(*names)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores, rejected = shared.value.predict(part.column(text).to_pylist())
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names, *names])

    return map_texts(rest, schema, work, text)


def drop_rejected(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the rows that the model rejects."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, _, rejected = shared.value.predict(part.column(text).to_pylist())
        yield part.filter(pa.array([not r for r in rejected], pa.bool_()))

    return map_texts(df, df.schema, work, text)
