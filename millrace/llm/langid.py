"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

Each language has several centroids, found by spherical k-means over a bounded sample of labelled
texts. A text is given the language of the most similar centroid (cosine), and is rejected if it is
farther from that centroid than nearly all of the sample's texts were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Lower-cases ASCII letters and makes of all other ASCII characters a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNDETERMINED = "und"


def counts(text: str, size: int) -> np.ndarray:
    """Hashed counts of the whole text's byte 1- to 4-grams, within and around words."""
    b = np.frombuffer((" " + " ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(size)
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        out += np.bincount((gram * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(size), minlength=size)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Centroids (rows of unit length) with their languages and the least similarity that each accepts."""

    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        return weigh(counts(text, len(self.idf)), self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, similarity (0 to 1), whether it is rejected."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        near = self.centroids @ self.vector(text)
        best = int(np.argmax(near))
        return self.languages[self.of[best]], round(float(min(1.0, max(0.0, near[best]))), 6), bool(near[best] < self.least[best])


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / (np.linalg.norm(v) or 1.0)


def cluster(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from points far from one another; unit centroids, fewer where points coincide."""
    centres = [vectors.mean(0)]
    centres[0] = centres[0] / (np.linalg.norm(centres[0]) or 1.0)
    while len(centres) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.stack(centres).T, axis=1)
        if nearest.min() > 1 - 1e-9:
            break
        centres.append(vectors[int(np.argmin(nearest))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ c.T, axis=1)
        sums = np.stack([vectors[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def sampled(labelled: DataFrame, per_language: int) -> DataFrame:
    """text, lang, picked (a hash of the text) of rows that have one of the per_language least hashes of their language, or some rows more.

    Hashes are counted once each, so a text that repeats is one text. The share of hashes that is looked at comes from
    their approximate number, with a margin; the rest of the choice is exact in chosen().
    """
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("picked", F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 40)))
    n = rows.groupBy("lang").agg(F.approx_count_distinct("picked").alias("n")).collect()
    if not n:
        return rows.where("false")
    most = F.element_at(F.create_map(*[F.lit(x) for r in n for x in (r["lang"], int(min(1.0, 2 * per_language / max(1, r["n"])) * (1 << 40)))]), F.col("lang"))
    return rows.where(F.col("picked") < most)


def train(labelled: DataFrame, per_language: int = 400, clusters: int = 4, size: int = 4096, slack: float = 0.6) -> Model:
    """Learns from (text, lang) rows with both present and a letter in the text.

    At most per_language different texts of each language are the sample, those with the least hashes, so it does not
    depend on how rows lie or repeat; per_language x languages vectors of size numbers reach the driver. least is slack
    times the similarity that 99 of 100 sample texts of the centroid reach. No labelled row: an empty model.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # as many as are sampled
        for batch in common.slices(batches):
            rows = []
            for text, lang, picked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, picked) not in seen and has_letter(text):
                    seen.add((lang, picked))
                    rows.append((lang, picked, counts(text, size).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "picked", "tf"])

    each = sampled(labelled, per_language).mapInArrow(vectors, "lang string, picked long, tf binary").groupBy("lang", "picked").agg(F.min("tf").alias("tf"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("picked"))
    chosen = each.withColumn("nth", nth).where(F.col("nth") <= per_language)
    sample: dict[str, list] = {}
    for r in chosen.select("lang", "tf").collect():
        sample.setdefault(r["lang"], []).append(bytes(r["tf"]))
    languages = sorted(sample)
    if not languages:
        return Model([], np.zeros((0, size)), np.zeros(0, int), np.zeros(0), np.ones(size))
    tf = {g: np.stack([np.frombuffer(b, "<u4").astype(np.float32) for b in sorted(sample[g])]) for g in languages}
    total = sum(map(len, tf.values()))
    idf = np.log((1 + total) / (1 + sum((v > 0).sum(0) for v in tf.values()))) + 0.1
    centroids, of, least = [], [], []
    for i, g in enumerate(languages):
        v = np.stack([weigh(x, idf) for x in tf[g]])
        c = cluster(v, clusters)
        near = v @ c.T
        own = np.argmax(near, axis=1)
        for k in range(len(c)):
            mine = near[own == k, k]
            centroids.append(c[k])
            of.append(i)
            least.append(slack * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    return Model(languages, np.stack(centroids), np.array(of), np.array(least), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of (doc_id, text); und, score 0 and rejected for a text that is null or has no letter.

    Equal texts are judged alike; an empty table gives no rows; an empty model rejects all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x size numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "lang_pred", "score", "rejected"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected: null texts and those without a letter go."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), common.place_of(docs, "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, at):
            yield batch.filter(pa.array([not shared.value.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return common.bounded(docs).mapInArrow(judge, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
