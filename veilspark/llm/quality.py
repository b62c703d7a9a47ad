"""Quality classifier by co-training a text view and a page-metadata view.

The content view sees a text's characters and words; the metadata view sees source,
language, length and layout. Each view has a logistic regression. Both start from a
bounded sample of labelled rows; then, in each round, every unlabelled document of
the corpus that one view is sure about joins the other view's training set with that
label. A round's Newton step needs only sums over rows (gradient and curvature), so
a round is one pass over the feature table and a few thousand numbers to the driver.
At the end each view is calibrated on labelled rows and the calibrated log-odds are
combined by a third regression, which scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, session

#: Most labelled rows that are fitted on, picked by a hash of the id.
LABELLED_ROWS = 20_000
ROUNDS, SURE, PSEUDO_WEIGHT, RIDGE = 3, 0.95, 0.25, 1.0
HASHED = 24
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CONTENT, META = 14 + HASHED, 11 + 8 + 16


def content_features(text: bytes) -> list[float]:
    """Shares of kinds of characters and words, and hashed word-ending counts."""
    n = len(text)
    if not n:
        return [0.0] * CONTENT
    less = lambda kinds: len(text.translate(None, kinds)) / n
    letters = 1 - less(LETTERS)
    upper = 1 - less(bytes(range(65, 91)))
    words = text.split()
    m = max(1, len(words))
    ends = [0.0] * HASHED
    for w in words:
        ends[crc32(w[-2:]) % HASHED] += 1
    distinct = len(set(words)) / m
    kinds = [1 - less(b"0123456789"), 1 - less(b"#$%&*@^~"), 1 - less(b"!?"), 1 - less(b"|<>{}[]\\_="), 1 - less(b".,;:"), 1 - less(b"\"'()-"), 1 - less(b" \t\n\r")]
    shout = sum(map(bytes.isupper, words)) / m
    return [1.0, letters, upper, *[math.sqrt(x) for x in kinds], min(3.0, n / m / 6), distinct, shout, math.sqrt(upper), *[math.sqrt(x / m) for x in ends]]


def meta_features(text: bytes, lang: str | None, source: str | None, n_chars: float) -> list[float]:
    """Length, language, source and the layout of lines."""
    rows = text.split(b"\n")
    sizes = [len(x) for x in rows]
    n = max(1, len(text))
    n_chars = n_chars if n_chars == n_chars and n_chars is not None else 0.0
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in rows)
    stats = [
        1.0, math.log1p(max(0.0, n_chars)) / 10, math.log1p(len(rows)) / 5, math.log1p(max(sizes)) / 10, math.log1p(n / len(rows)) / 10,
        sum(s < 40 for s in sizes) / len(rows), 1 - len(set(rows)) / len(rows), float(len(text) == 0),
        ended / len(rows), min(4.0, len(text) / max(1.0, n_chars)) / 4, math.sqrt(text.count(b"http") / n),
    ]
    langs, sources = [0.0] * 8, [0.0] * 16
    langs[crc32(repr(lang).encode()) % 8] = 1.0
    sources[crc32(repr(source).encode()) % 16] = 1.0
    return [*stats, *langs, *sources]


def features(docs: DataFrame) -> Column:
    """Both views of a row of documents as one ``array<float>``; nulls count as empty."""

    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, langs, sources, sizes in batches:
            yield pd.Series([content_features(t or b"") + meta_features(t or b"", a, s, n) for t, a, s, n in zip(texts, langs, sources, sizes, strict=True)])

    has = lambda name, kind: F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    return F.pandas_udf(each, "array<float>")(F.col("text").cast("binary"), has("lang", "string"), has("source", "string"), has("n_chars", "double"))


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log-loss, flattened."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    g = x.T @ (weight * (y - p))
    return np.concatenate((g, ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()))


def newton_step(sums: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = len(w)
    return w + np.linalg.solve(sums[d:].reshape(d, d) + RIDGE * np.eye(d), sums[:d] - RIDGE * w)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression on rows in memory."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w = newton_step(newton_sums(x, y, np.ones(len(y)), w), w)
    return w


def views(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :CONTENT], x[:, CONTENT:]


def round_sums(table: DataFrame, models: list[np.ndarray]) -> list[np.ndarray]:
    """Newton sums of both views over all rows of ``table(x, y)``: rows with a label, and rows of which the other view is sure."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(w) * (len(w) + 1)) for w in models]
        for batch in batches:
            if not len(batch):
                continue
            both, y = views(np.stack(batch["x"].to_numpy()).astype(float)), batch["y"].to_numpy(float)
            p = [1 / (1 + np.exp(-np.clip(v @ w, -30, 30))) for v, w in zip(both, models, strict=True)]
            for k in (0, 1):
                other, known = p[1 - k], ~np.isnan(y)
                sure = ~known & (np.maximum(other, 1 - other) >= SURE)
                use = known | sure
                label = np.where(known, np.nan_to_num(y), other >= 0.5)[use]
                total[k] += newton_sums(both[k][use], label, np.where(known, 1.0, PSEUDO_WEIGHT)[use], models[k])
        yield pd.DataFrame({"at": np.arange(sum(map(len, total))), "s": np.concatenate(total)})

    flat = np.zeros(sum(len(w) * (len(w) + 1) for w in models))
    for row in table.mapInPandas(each, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        flat[row["at"]] = row["s"]
    first = len(models[0]) * (len(models[0]) + 1)
    return [flat[:first], flat[first:]]


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> dict:
    """Weights of the two views and of their combination, from all of ``docs`` and ``labels(doc_id, quality)``.

    About ``labelled_rows`` labelled rows, picked by a hash of the id, are used: two quarters
    calibrate the views and fit their combination, the rest train; labelled rows that are not picked
    take no part in training. Of several labels of a document the least counts. Without labels of both
    kinds nothing can be learned: all documents are kept.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_vs_d")).agg(F.min("quality").cast("double").alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), features(docs).alias("x"))
    n = known.count()
    picked = F.pmod(F.xxhash64("_vs_d"), F.lit(max(n, 1))) < labelled_rows
    quarter = F.pmod(F.xxhash64(F.lit("quarter"), "_vs_d"), F.lit(4))
    role = F.when(F.col("_vs_d").isNull(), "open").when(~picked, "left").when(quarter == 0, "platt").when(quarter == 1, "both").otherwise("train")
    table = materialize(own.join(known, F.col("doc_id") == F.col("_vs_d"), "left").select("doc_id", "x", "y", role.alias("role")))
    sample = table.where("role in ('platt', 'both', 'train')").limit(2 * labelled_rows).toPandas().sort_values("doc_id", kind="stable")
    rows = {r: (np.stack(g["x"].to_numpy()).astype(float), g["y"].to_numpy(float)) for r, g in sample.groupby("role")}
    if any(len(np.unique(rows[r][1] if r in rows else [])) < 2 for r in ("platt", "both", "train")):
        return {"content": [0.0] * CONTENT, "meta": [0.0] * META, "both": [10.0, 0.0, 0.0]}
    models = [fit(v, rows["train"][1]) for v in views(rows["train"][0])]
    for _ in range(ROUNDS):
        models = [newton_step(s, w) for s, w in zip(round_sums(table.where("role in ('open', 'train')").select("x", "y"), models), models, strict=True)]
    odds = lambda r: [np.clip(v @ w, -12, 12) for v, w in zip(views(rows[r][0]), models, strict=True)]
    platt = [fit(np.stack((np.ones(len(o)), o), 1), rows["platt"][1]) for o in odds("platt")]
    both = fit(np.stack((np.ones(len(rows["both"][1])), *[c[0] + c[1] * o for c, o in zip(platt, odds("both"), strict=True)]), 1), rows["both"][1])
    return {"content": models[0].tolist(), "meta": models[1].tolist(), "platt": [c.tolist() for c in platt], "both": both.tolist()}


def score_columns(docs: DataFrame, model: dict) -> tuple[Column, Column, Column]:
    """Calibrated probability of good quality by content, by metadata and by both."""
    x = F.col("_vs_x")
    dot = lambda a, w: F.aggregate(F.zip_with(a, F.array(*[F.lit(v) for v in w]), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    clip = lambda z: F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    logistic = lambda z: 1 / (1 + F.exp(-z))
    platt = model.get("platt", [[0.0, 1.0], [0.0, 1.0]])
    odds = [clip(dot(F.slice(x, a, n), model[k])) * c[1] + c[0] for k, a, n, c in (("content", 1, CONTENT, platt[0]), ("meta", CONTENT + 1, META, platt[1]))]
    b = model["both"]
    return logistic(odds[0]), logistic(odds[1]), logistic(odds[0] * b[1] + odds[1] * b[2] + b[0])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``_vs_content, _vs_meta, _vs_quality`` for every row.

    Null texts, languages, sources and lengths count as empty values; repeated rows score alike; whole texts are
    read, whatever their length; a probability of exactly one half keeps. An empty table stays empty. Columns of
    ``docs`` other than those that a view reads pass through, so none of their names can clash but ``_vs_*``.
    """
    content, meta, both = score_columns(docs, model)
    marked = docs.withColumn("_vs_x", features(docs))
    return marked.select(*docs.columns, content.alias("_vs_content"), meta.alias("_vs_meta"), both.alias("_vs_quality"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``docs`` and ``labels`` and score all of ``docs``."""
    session(docs)
    return score(docs, train(docs, labels))


def op1(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select(
        "doc_id", F.col("_vs_content").alias("p_content"), F.col("_vs_meta").alias("p_metadata"), F.col("_vs_quality").alias("p_quality"), (F.col("_vs_quality") >= 0.5).alias("keep")
    )
