"""A supervised quality classifier on averaged subword embeddings (see text_model).

Null and empty texts have no features; their score is the model's bias. Rows of documents
with equal ids, or ids that are null, are scored one by one; an empty table gives no rows.
Very long texts are read whole. A column of the output's name is replaced; all others are
kept. Ties between labelled rows are settled by hashes of id and text, so the model doesn't
depend on the order of files. Without any usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes
from .text_model import bags, scores, train


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are for testing alone. A null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most per_class ids of each class that are not held out, in the order of a hash, and their texts.

    Of ids that many rows of documents share the first 4 * per_class texts in all are taken, in the order of hashes of id and text.
    """
    rows = labels.where(~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    ids = [(r.doc_id, r.y) for r in picked.collect()]  # at most 2 * per_class ids
    if not ids:
        return []
    small = documents.sparkSession.createDataFrame(ids, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int")
    found = documents.select("doc_id", "text").join(F.broadcast(small), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id", "y").limit(4 * per_class)
    return [(r.text or "", r.y) for r in found.select("text", "y").collect()]


def score_texts(documents: DataFrame, table: np.ndarray, bias: float, text: str = "text", out: str = "score") -> DataFrame:
    """documents with a column `out`. Narrow; the table is of a fixed size (one float for each bucket)."""
    model = documents.sparkSession.sparkContext.broadcast((table, bias))
    others = [c for c in documents.columns if c != out]
    schema = T.StructType([documents.schema[c] for c in others] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        t, b = model.value
        for batch in batches:
            raw, off = text_bytes(batch.column(others.index(text)))
            got = [scores(raw[off[i] : off[j]], off[i : j + 1] - off[i], t, b) for i, j in slices(off, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*others, out])

    return documents.select(*others).mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000) -> tuple[np.ndarray, float]:
    """Train on a sample of at most per_class labelled texts of each class (the bound on what reaches the driver)."""
    sample = labelled_sample(documents, labels, label, per_class)
    y = np.array([v for _, v in sample], np.int64)
    if len(set(y.tolist())) < 2:
        from .text_model import BUCKETS

        return np.zeros(BUCKETS, np.float32), 0.0
    docs = []
    for k in range(0, len(sample), 256):
        raw, off = text_bytes(pa.array([t for t, _ in sample[k : k + 256]], pa.string()))
        docs += bags(raw, off)
    weight = np.where(y == 1, 1.0, (y == 1).sum() / max(1, (y == 0).sum()))
    return train(docs, y, weight)
