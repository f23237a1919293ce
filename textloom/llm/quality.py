"""Quality scores from compression: two zstandard dictionaries and a calibrated size difference.

One dictionary is built from good and one from bad labelled text. A text is compressed in windows of WINDOW bytes with
each; the difference of the total sizes by its bytes is turned into a probability by a logistic curve, which is fitted on
labelled rows that the dictionaries have not seen. Scoring is a pass without a shuffle; the dictionaries (bounded size)
travel with the tasks.

Training takes a bounded sample of the labelled rows: of each label the SAMPLE rows with the smallest hash of their id, or
the first of these that have BYTES bytes together (one at least). Each is taken as a whole, and every text is scored as a
whole.
Edge cases: null and empty texts get the share of good rows in the sample as their score; labels other than 0 and 1, null
ids and further rows of an id are left out in training, and an id with both labels counts as 0; where a label is missing
altogether, every score is the share of good rows (0.5 without any rows); where a label has less text than zstandard trains
a dictionary of (20,000 bytes), its text is the dictionary. Repeated rows have equal scores. Other columns pass through,
but one named as the score is replaced; the text's own name can't be given to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import frugal

SAMPLE, BYTES, WINDOW, DICTIONARY, LEVEL = 3000, 32_000_000, 512, 112_640, 3


@dataclass(frozen=True)
class Model:
    prior: float
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    window: int = WINDOW


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.by = []
        for data in (model.good, model.bad) if model.good and model.bad else ():
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: bytes) -> float:
        good, bad = self.by
        w = self.model.window
        return sum(len(bad(p)) - len(good(p)) for p in (text[i : i + w] for i in range(0, len(text), w))) / len(text)

    def score(self, text: bytes) -> float:
        m = self.model
        if not text or not self.by:
            return m.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * self.difference(text) + m.intercept))))


def fit(rows: list[tuple[bytes, int]], window: int = WINDOW, size: int = DICTIONARY) -> Model:
    """rows: (text, label); the even ones build the dictionaries, the odd ones the curve."""
    prior = sum(y for _, y in rows) / len(rows) if rows else 0.5
    known = {}
    for label in (0, 1):
        own = [t for t, y in rows[::2] if y == label]
        parts = [t[i : i + window] for t in own for i in range(0, len(t), window)]
        parts = [p for p in parts if len(p) >= 8]  # zstandard takes no shorter samples
        total = sum(map(len, parts))
        known[label] = zstandard.train_dictionary(min(size, total // 4), parts).as_bytes() if total >= 20_000 else b"".join(parts)
    seen = [(t, y) for t, y in rows[1::2] if t]
    if not known[0] or not known[1] or len({y for _, y in seen}) < 2:
        return Model(prior)
    scorer = Scorer(Model(prior, known[1], known[0], window=window))
    x, y = np.array([scorer.difference(t) for t, _ in seen]), np.array([y for _, y in seen], float)
    a, b = np.zeros(2), np.stack([x / (x.std() or 1.0), np.ones(len(x))], 1)
    for _ in range(50):  # Newton steps of a logistic fit, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        step = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + 1e-3 * np.eye(2), b.T @ (y - p) - 1e-3 * a)
        a = a + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return Model(prior, known[1], known[0], float(a[0] / (x.std() or 1.0)), float(a[1]), window)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Learns from the labelled rows given; the caller leaves out those that are held out.

    Null ids, labels other than 0 and 1 and further rows of an id are left out; null texts are empty; without rows the score
    is 0.5. At most 2 * sample rows and 2 * most bytes (or one text of each label) reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    ids = [r for y in (0, 1) for r in known.where(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()]
    if not ids:
        return Model(0.5)
    chosen = spark.createDataFrame([tuple(r) for r in ids], known.schema)
    texts = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # the bytes of the sampled rows, numbers only, tell which of them fit
    sizes = {r["_id"]: r["n"] for r in texts.select("_id", F.octet_length("_text").alias("n")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("n").alias("n")).collect()}
    held, fitting = [0, 0], []
    for r in ids:
        held[r["_y"]] += sizes.get(r["_id"], 0)
        if r["_id"] in sizes and (held[r["_y"]] <= most or held[r["_y"]] == sizes[r["_id"]]):
            fitting.append(tuple(r))
    chosen = spark.createDataFrame(fitting, known.schema)
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("_id"), "_id").collect()
    return fit([(r["_text"].encode(), r["_y"]) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1; a column named as the result is replaced."""
    if out == text:
        raise ValueError("the score cannot replace the text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            scores = pa.array([scorer.score(x.as_py() or b"") for x in column], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, out])

    return kept.mapInArrow(frugal(run), StructType([*kept.schema.fields, StructField(out, DoubleType())]))
