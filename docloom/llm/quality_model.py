"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text (STATISTICS), computed by byte operations in
   Arrow batches.
2. Small regression trees, boosted on a bounded sample of labelled rows
   (SAMPLE_ROWS, those with the smallest seeded hashes of the id); the path to
   each of their nodes is a rule, a conjunction of comparisons.
3. Logistic weights of the rules under an L1 penalty (proximal gradient); most
   become zero.
4. The remaining rules are compiled into one Spark column expression.

Defined results: a null text counts as empty and is scored like it; rows with a
null id or label are not learned from; of repeated labels of an id the largest
counts; without labelled rows every score is 0.5, with one class only it is
0.99 or 0.01.  Repeated rows give repeated results; texts may be of any length
and are read whole; ties between splits go to the first statistic; an empty
table gives an empty table; other columns, whatever their names, are not read.

The statistics are counts over bytes and words in Arrow batches: repeated words
and lines have no cheap built-in form, and one pass gives all thirteen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts

SAMPLE_ROWS = 20_000
TREES = 24
DEPTH = 3
BINS = 24
PENALTY = 0.002

STATISTICS = (
    "log_words",
    "word_bytes",
    "distinct_words",
    "next_repeats",
    "symbols",
    "marks",
    "capitals",
    "digits",
    "ascii",
    "dup_lines",
    "line_words",
    "capital_words",
    "stops",
)
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?\"'()[]{}/\\@^_~=+:;-"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> tuple[float, ...]:
    b = (text or "").encode("utf-8", "replace")
    n = max(1, len(b))
    words = b.split()
    m = max(1, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    return (
        float(np.log1p(len(words))),
        sum(map(len, words)) / m,
        len(set(words)) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        share(_SYMBOLS),
        share(_MARKS),
        share(_CAPITALS),
        share(_DIGITS),
        1.0 - share(_HIGH),
        1.0 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / m,
        (b.count(b". ") + b.count(b".\n") + b.endswith(b".")) / m,
    )


def with_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the statistics (doubles s_NAME) of each row."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [statistics(t) for t in part.column("text").to_pylist()]
        cols = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", *("s_" + n for n in STATISTICS)])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_texts(rows, f"key {kind}, " + ", ".join(f"s_{n} double" for n in STATISTICS), work).withColumnRenamed("key", key)


#: A rule: (statistic, threshold, whether at most the threshold) for each comparison.
Rule = tuple[tuple[int, float, bool], ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for i, edge, below in rule:
                c = F.col("s_" + STATISTICS[i])
                holds = holds & ((c <= edge) if below else (c > edge))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, columns: np.ndarray) -> None:
    out[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 10:
        return
    g, h = gradient[rows], hessian[rows]
    whole, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, -1, -1)
    for j in columns:
        if not len(edges[j]):
            continue
        c = codes[rows, j]
        gs, hs = np.cumsum(np.bincount(c, g, len(edges[j]) + 1))[:-1], np.cumsum(np.bincount(c, h, len(edges[j]) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), k)
    _, j, k = best
    if j < 0:
        return
    left = codes[rows, j] <= k
    for part, below in ((rows[left], True), (rows[~left], False)):
        step = (*path, (j, float(edges[j][k]), below))
        rules.append(tuple(sorted(step)))
        _grow(codes, edges, gradient, hessian, part, depth - 1, step, rules, out, columns)


def _paths(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct paths of boosted trees, in the order found."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        out = np.zeros(len(y))
        found: list[Rule] = []
        _grow(codes, edges, y - p, p * (1 - p), rows, DEPTH, (), found, out, np.sort(columns))
        rules += found
        for rule in found:
            if len(rule) == DEPTH:
                hit = holds(rule, x)
                if hit.any():
                    margin[hit] += 0.3 * (y - p)[hit].sum() / ((p * (1 - p))[hit].sum() + 1.0)
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, edge, below in rule:
        out &= (x[:, j] <= edge) if below else (x[:, j] > edge)
    return out


def learn(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(float(np.log(99) if y[0] else -np.log(99)), ())
    rules = _paths(x, y.astype(float))
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    mean = z.mean(axis=0)
    keep = (mean > 0) & (mean < 1)
    rules, z = [r for r, k in zip(rules, keep, strict=True) if k], z[:, keep]
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1.0)
    w, bias = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, v_bias, t = w.copy(), bias, 1.0
    for _ in range(600):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(z @ v + v_bias))) - y
        new = v - step * (z.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_bias = v_bias - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return RuleModel(float(bias), tuple((r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", label: str = "quality", text: str = "text") -> RuleModel:
    """Learns from the rows of labels for which train is true; train reads the key."""
    chosen = (
        labels.where(train & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64(F.lit("rules"), F.col(key)), key)
        .limit(SAMPLE_ROWS)
    )
    picked = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen.select(key)), key, "left_semi")
    stats = with_statistics(picked, key, text).dropDuplicates([key])
    rows = stats.join(F.broadcast(chosen), key).orderBy(key).collect()
    x = np.array([[r["s_" + n] for n in STATISTICS] for r in rows]).reshape(len(rows), len(STATISTICS))
    return learn(x, np.array([int(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the statistics and the score (0 to 1) of each row."""
    return with_statistics(docs, key, text).withColumn("score", model.column())
