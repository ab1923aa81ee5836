"""Language ID: nearest of several clustered TF-IDF n-gram centroids per language, by cosine, with rejection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngrams(text: str) -> np.ndarray | None:
    """Counts of character 1- to 3-grams in ``BINS`` hashed bins; None without a letter.

    Of the lower-cased text, all that is no letter counts as a space, runs of it as one.
    """
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(NO_LETTER)
    words = words.split()
    if not words:
        return None
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    h1 = c * PRIMES[0]
    h2 = (h1[:-1] ^ (c[1:] + np.uint32(0x27D4EB2F))) * PRIMES[1]
    h3 = (h2[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * PRIMES[2]
    return np.bincount(np.concatenate([h >> np.uint32(20) for h in (h1, h2, h3)]), minlength=BINS)


NO_LETTER = {i: " " for i in range(128) if not chr(i).isalpha()}


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vector, term frequencies by 1 + log."""
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts are rows far from those before, so that runs agree."""
    centers = [x.sum(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(np.stack([x @ (c / (np.linalg.norm(c) or 1)) for c in centers]), axis=0)
        centers.append(x[int(np.argmin(near))])
    c = np.stack(centers)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        best = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[best == j].sum(axis=0) if (best == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Model:
    """``labels`` (language of each centroid), ``centers``, ``idf``, and ``floor`` per centroid: the similarity that all
    but a hundredth of its training texts reach."""

    def __init__(self, labels: list[str], centers: np.ndarray, floor: np.ndarray, idf: np.ndarray):
        self.labels, self.centers, self.floor, self.idf = labels, centers, floor, idf

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language of the nearest centroid, cosine clipped to [0, 1], whether it lies too far from all training texts)."""
        counts = ngrams(text) if text else None
        if counts is None or not self.labels:
            return "und", 0.0, True
        sims = self.centers @ vector(counts, self.idf)
        j = int(np.argmax(sims))
        s = float(min(1.0, max(0.0, sims[j])))
        return self.labels[j], s, bool(sims[j] < 0.5 * self.floor[j])


def train(labelled: DataFrame, per_language: int = 1000, clusters: int = 4) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``: at most ``per_language`` texts of each language, chosen by a hash of the id.

    That bound is the model's sample. Ids alone are ranked, and Spark prunes them to the bound in each task before the
    shuffle (it does so up to 1000 rows a group). Each language's vectors
    are clustered in one task that holds its sample only. Null languages and texts without a letter teach nothing.
    """
    known = labelled.where("lang is not null and text is not null").withColumn("order", F.xxhash64("doc_id", F.lit(7)))
    order = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen = known.select("lang", "order", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    rows = known.join(chosen.select("lang", "order").distinct(), ["lang", "order"], "left_semi")  # texts move only if chosen
    rows = rows.groupBy("lang", "order").agg(F.min("text").alias("text"))  # one of an id's texts, however often it is repeated
    counted = rows.select("lang", "text").mapInArrow(_count_batches, "lang string, counts binary").persist()
    seen = [np.frombuffer(r.df, np.int64) for r in counted.groupBy("lang").applyInPandas(_document_frequency, "df binary").collect()]
    total = np.sum(seen, axis=0) if seen else np.zeros(BINS + 1, np.int64)
    idf = (np.log((1 + total[BINS]) / (1 + total[:BINS])) + 1).astype(np.float32)
    packed = idf.tobytes()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(packed, np.float32)
        x = np.stack([vector(np.frombuffer(b, np.int32), w) for b in pdf["counts"].sort_values()])
        c = cluster(x, clusters)
        best = x @ c.T
        near = np.argmax(best, axis=1)
        floor = [float(np.quantile(best[near == j, j], 0.01)) if (near == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "j": range(len(c)), "center": [r.tobytes() for r in c], "floor": floor})

    found = counted.groupBy("lang").applyInPandas(fit, "lang string, j int, center binary, floor double").collect()
    counted.unpersist()
    found = sorted(found, key=lambda r: (r.lang, r.j))  # clusters x languages rows of BINS floats
    centers = np.stack([np.frombuffer(r.center, np.float32) for r in found]) if found else np.zeros((0, BINS), np.float32)
    return Model([r.lang for r in found], centers, np.array([r.floor for r in found]), idf)


def _count_batches(batches):
    for batch in batches:
        rows = [(lang, c) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if (c := ngrams(t)) is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary())], names=["lang", "counts"]
        )


def _document_frequency(pdf: pd.DataFrame) -> pd.DataFrame:
    df = np.zeros(BINS + 1, np.int64)
    for b in pdf["counts"]:
        df[:BINS] += np.frombuffer(b, np.int32) > 0
    df[BINS] = len(pdf)
    return pd.DataFrame({"df": [df.tobytes()]})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row's whole text; only the text is read.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learned); ``rejected`` also where the
    nearest centroid is too far. Repeated rows are judged alike; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = [model.predict(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 3
            out = batch.drop_columns(["text"])
            for name, c, kind in zip(("lang_pred", "score", "rejected"), cols, (pa.string(), pa.float64(), pa.bool_())):
                out = out.append_column(name, pa.array(c, kind))
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
