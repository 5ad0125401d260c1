"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word gives its lower-case core, a mark for upper case and one for each run of punctuation around it.
Features are the hashes of these tokens and of pairs of neighbours; a pair of equal tokens has one hash
for all tokens, as repetition matters more than what is repeated. A value is the share of the text's
tokens times ``SCALE``. Training runs over a bounded sample of labelled rows (``rows`` of each label, of at most
``samples.LONGEST`` characters) whose sparse vectors, not texts, come to the driver. A score is one sparse dot product, computed while the text is read.

Null and empty texts have no features and get the score of the bias. With no labelled rows, every score
is 0.5. Repeated rows get equal scores; null ids are scored and never learnt from. Empty tables give an
empty result. Texts of any length are scored as a whole. Only id and text are inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed
from .samples import Words, fold, hash32, labelled, parts

BITS = 18
SCALE = 20.0
#: Sampled rows of each label.
ROWS = 4000
EPOCHS = 4
_REPEAT = np.uint32(hash32("^repeat"))


def _tokens(word: str) -> bytes:
    before, core, after = parts(word)
    out = ["^mark " + before[:4]] if before else []
    if core:
        out.append(core.lower())
        if len(core) > 1 and core.isupper():
            out.append("^upper")
    if after:
        out.append("^mark " + after[:4])
    return np.array([hash32(x) for x in out], "<u4").tobytes()


_words = Words(_tokens)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of some texts one after another, and where each text begins (with the end)."""
    joined = [np.frombuffer(b"".join(_words(x.split())), "<u4") for x in texts]
    out, at = [], [0]
    for t in joined:
        a, b = t[:-1], t[1:]
        pairs = np.where(a == b, _REPEAT, (a * np.uint32(0x9E3779B1)) ^ (b + np.uint32(0x7F4A7C15)))
        both = np.concatenate([t, pairs])
        both ^= both >> np.uint32(15)
        out.append((both & np.uint32((1 << BITS) - 1)).astype(np.int32))
        at.append(at[-1] + len(both))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(at)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights from (feature ids, values, label) rows; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > l1, w, 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i, size - 1), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def _vectors(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            flat, at = features(part.column("text").to_pylist())
            out = []
            for b, e in zip(at[:-1], at[1:], strict=True):
                i, c = np.unique(flat[b:e], return_counts=True)
                out.append((i.astype("<i4").tobytes(), (c * (SCALE / max(1, e - b))).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["label", "ids", "values"])


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", rows: int = ROWS) -> np.ndarray:
    sample = labelled(docs, labels, label, allowed, rows)
    got = sample.select("doc_id", "label", "text").mapInArrow(_vectors, "label int, ids binary, values binary").collect()  # at most 2 * ``rows`` sparse vectors
    got = sorted((bytes(x["ids"]), bytes(x["values"]), x["label"]) for x in got)  # one order whatever the partitions
    return train([(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float), y) for i, v, y in got])


def score(docs: DataFrame, weights: np.ndarray, keep_text: bool = False, name: str = "score") -> DataFrame:
    """Add the score to rows with a ``text`` as a column that they don't have yet; the text is dropped unless it is to be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a vector of fixed size

    def run(batches):
        w = shared.value
        for batch in trimmed(batches):
            for part in slices(batch, "text"):
                flat, at = features([x or "" for x in part.column("text").to_pylist()])
                total = np.concatenate([[0.0], np.cumsum(w[flat], dtype=np.float64)])
                logit = w[-1] + (total[at[1:]] - total[at[:-1]]) * SCALE / np.maximum(np.diff(at), 1)
                values = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(values)], names=[*[f.name for f in kept], name])

    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{name}` double"])
    return docs.mapInArrow(run, ddl)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; rows whose fold is ``held`` are never learnt from."""
    weights = fit(docs, labels, fold(modulus) != held, rows=rows)
    inputs = docs.select("doc_id", (fold(modulus) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return score(inputs, weights).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
