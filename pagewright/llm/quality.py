"""Line-by-line quality with a linear-chain conditional random field (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents and lines of each label that the field is fitted on, at most; the only bounds, and the scoring has none.
TRAIN_DOCS, TRAIN_LINES = 1500, 200_000
THRESHOLD = 0.7
#: Code points that one feature pass takes apart at once.
SLICE = 2_000_000
FEATURES = ("length", "upper", "digit", "bar", "odd", "end_mark", "comma", "word", "space", "ends", "copy", "short", "blank", "again")


def _classes() -> np.ndarray:
    """The class of each code point: 0 other letters, 1 upper case, 2 digit, 3 space, 4 bar, 5 . and ?, 6 comma, 7 plain punctuation, 8 odd symbol."""
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else 0 if ch.isalpha() else 8
    for chars, n in (("|", 4), (".?", 5), (",", 6), ("'-:;()\"’“”–—", 7)):
        for ch in chars:
            table[ord(ch)] = n
    return table


CLASSES = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lengths of the lines, and the number of lines of each text. An empty text is one empty line."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = CLASSES[np.minimum(points, len(CLASSES) - 1)]
    stops = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.append(0, stops[:-1] + 1)
    length = (stops - starts).astype(np.float64)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask, dtype=np.int32))
        return (sums[stops] - sums[starts]).astype(np.float64)

    upper, digit, space, bar, end_mark, comma, odd = (total(kinds == k) for k in (1, 2, 3, 4, 5, 6, 8))
    letters = total(kinds <= 1)
    blank = kinds == 3
    words = total(~blank & np.append(True, blank[:-1])) if len(kinds) else np.zeros(len(stops))
    size = np.maximum(length, 1)
    last = np.where(length > 0, kinds[np.maximum(stops - 1, 0)] if len(kinds) else 0, 0)
    copy, again = np.zeros(len(stops)), np.zeros(len(stops))
    at = 0
    for x in lines:
        for i, line in enumerate(x):
            w = line.split()
            again[at + i] = sum(map(eq, w, w[1:]))
        if len(x) > 1 and len(set(x)) < len(x):
            seen: dict[str, int] = {}
            for line in x:
                seen[line] = seen.get(line, 0) + 1
            copy[at : at + len(x)] = [seen[line] > 1 for line in x]
        at += len(x)
    each = np.maximum(words, 1)
    out = np.stack([np.log1p(np.minimum(length, 400)) / 5, upper / np.maximum(letters, 1), digit / size * 4, np.minimum(bar / each, 2), np.minimum(odd / each, 2), np.minimum(end_mark / each, 1), np.minimum(comma / each, 1), np.minimum(letters / each, 30) / 10, space / size * 4, (last == 5) * 1.0, copy, (length < 20) * 1.0, (length == 0) * 1.0, again / each], 1)
    return out, length, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its document (zero beyond the ends), and a constant."""
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def forward_backward(scores: np.ndarray, step: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """Marginals P(good) of each line, the documents' log partition functions and, on request, the expected transitions.

    scores: the score of good against bad, per line; step: transition scores, 2 by 2. All chains go along together,
    longest first, so the number of numpy calls is that of the longest chain.
    """
    order = np.argsort(-counts, kind="stable")
    firsts, size = (np.cumsum(counts) - counts)[order], counts[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains with a line t
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    emit = np.stack([np.zeros(len(scores)), scores], 1)
    fold = lambda m, axis: np.logaddexp(m.take(0, axis), m.take(1, axis))
    alpha[firsts] = emit[firsts]
    for t in range(1, size[0]):
        at = firsts[: live[t]] + t
        alpha[at] = emit[at] + fold(alpha[at - 1][:, :, None] + step[None], 1)
    for t in range(size[0] - 2, -1, -1):
        at = firsts[: live[t + 1]] + t
        beta[at] = fold(step[None] + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
    z = np.empty(len(counts))
    z[order] = fold(alpha[firsts + size - 1], 1)
    lines_z = np.repeat(z, counts)
    marginal = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - lines_z, -700, 0))
    if not pairs:
        return marginal, z, None
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    expected = np.exp(alpha[at - 1][:, :, None] + step[None] + (emit[at] + beta[at])[:, None, :] - lines_z[at][:, None, None])
    return marginal, z, (at, expected)


def fit_field(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 120, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent (Adam) on the weighted conditional log likelihood of the line labels."""
    theta = np.zeros(x.shape[1] + 4) if start is None else np.append(start[0], start[1].ravel())
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    line_weight = np.repeat(weight, counts)
    total = line_weight.sum()
    for k in range(1, rounds + 1):
        marginal, _, (at, expected) = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), counts, True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), line_weight[at])
        grad = np.append(x.T @ ((labels - marginal) * line_weight), (seen - (expected * line_weight[at][:, None, None]).sum(0)).ravel()) / total - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def evidence(marginal: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' P(good), as a log odds; each line weighs its length plus one."""
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(marginal * (length + 1), starts) / np.add.reduceat(length + 1, starts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class QualityModel:
    """The field, and the two numbers that turn its evidence into a probability of label 1."""

    def __init__(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray, quality: np.ndarray, odds: float = 1.0) -> None:
        full = with_neighbours(x, counts)
        weight = np.where(quality == 1, 0.5 / max(1, (quality == 1).mean() * len(quality)), 0.5 / max(1, (quality == 0).mean() * len(quality))) * len(quality)
        weight = weight / np.sqrt(counts)
        of_doc = np.repeat(quality, counts)
        self.field = fit_field(full, counts, of_doc, weight)
        # lines that the first fit finds good in a bad document are taken as good; its worst line stays bad
        marginal = forward_backward(full @ self.field[0], self.field[1], counts)[0]
        worst = np.repeat(np.minimum.reduceat(marginal, np.cumsum(counts) - counts), counts)
        self.field = fit_field(full, counts, np.where((of_doc == 0) & (marginal > 0.5) & (marginal > worst), 1, of_doc), weight, 60, self.field)
        e = evidence(forward_backward(full @ self.field[0], self.field[1], counts)[0], length, counts)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression on the evidence, slightly held back
            p = sigmoid(a * e + b)
            g = np.array([((quality - p) * e).sum() - 1e-2 * (a - 1), (quality - p).sum() - 1e-2 * b])
            w = p * (1 - p)
            h = np.array([[(w * e * e).sum() + 1e-2, (w * e).sum()], [(w * e).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        # the sample holds as many of each label; odds says how much likelier label 1 is among all labelled rows
        self.scale = (max(a, 1e-3), b + np.log(odds))

    def score(self, texts: list[str]) -> np.ndarray:
        x, length, counts = line_features(texts)
        marginal = forward_backward(with_neighbours(x, counts) @ self.field[0], self.field[1], counts)[0]
        return sigmoid(self.scale[0] * evidence(marginal, length, counts) + self.scale[1])


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    yield first, len(texts)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Fits on labelled rows whose crc32(doc_id) mod 4 is not 2: TRAIN_DOCS of each label and TRAIN_LINES of their lines at most, the first by a hash of doc_id.

    Rows that repeat a sampled doc_id are one, the one with the smallest hash of its text; a document whose lines would
    overrun the bound isn't fitted on. Executors turn the sample's texts into line features; the driver sees these
    alone. None if a label is missing.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id")).limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.union(part)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("h"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes_of = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("h", n_lines.alias("n"))).alias("m"))
    upto = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    chosen = sizes_of.select("doc_id", "quality", F.col("m.h").alias("h"), F.sum("m.n").over(upto).alias("so_far")).where(F.col("so_far") <= TRAIN_LINES)
    sample = rows.join(F.broadcast(chosen.select("doc_id", "quality", "h")), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "quality", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in slices(pdf["text"].tolist()):
                part = pdf.iloc[a:b]
                x, length, counts = line_features(part["text"].tolist())
                ends = np.cumsum(counts)
                x = x.astype(np.float32)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "quality": part["quality"].to_numpy(), "n": counts, "x": [x[e - n : e].tobytes() for n, e in zip(counts, ends, strict=True)], "length": [length[e - n : e].tobytes() for n, e in zip(counts, ends, strict=True)]})

    rows = sorted((r.asDict() for r in sample.mapInPandas(features, "doc_id bigint, quality int, n long, x binary, length binary").collect()), key=lambda r: (r["doc_id"], r["n"], bytes(r["x"])))
    if len({r["quality"] for r in rows}) < 2:
        return None
    x = np.vstack([np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows]).astype(np.float64)
    n = [sum(r["quality"] == q for r in rows) for q in (0, 1)]
    odds = sizes[1] / sizes[0] * n[0] / n[1]
    return QualityModel(x, np.concatenate([np.frombuffer(r["length"]) for r in rows]), np.array([r["n"] for r in rows]), np.array([r["quality"] for r in rows]), odds)


def quality_scores(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """docs with a column score: the probability of label 1. Texts are scored where they are; null texts count as empty.

    Without a model (no labelled rows of both kinds) every score is 1: nothing is known against a document. Rows are
    independent, so nulls, repeated rows and other columns stay as they are; a column called score is replaced.
    """
    if model is None:
        return docs.withColumn("score", F.lit(1.0))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        return pd.Series(np.concatenate([model.score(texts[a:b]) for a, b in slices(texts)])) if texts else pd.Series(dtype="float64")

    return docs.withColumn("score", score("text"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
