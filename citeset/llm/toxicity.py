"""Toxicity by a convolutional text classifier, in numpy.

A word's vector is the scaled sum of hashed embeddings of the lower-case word and of its beginnings of 3 to 7
letters, so that unseen words of a known stem have a meaning. Filters of several widths slide over the
words, each filter's maximum over the whole text is kept, and a logistic layer gives the score. It is
trained by Adagrad on all labelled rows and their whole texts but every fifth by hash, and those calibrate a threshold per language, reported
beside the score: a score itself never depends on the language. Rows are dealt by hash to shards of about ``2 * rows``. One
task trains a first model on one shard in several passes; from it every shard's task goes on over its own rows, and the mean of these models is the
result. A task holds a shard's hashes, 12 bytes a word; only models, of fixed size, come to the driver.

Null and empty texts are scored as a text of padding. With no labelled rows every score is 0.5. Null ids
are scored and never learnt from; repeated rows get equal scores; an unknown or null language uses the
threshold of all languages. Empty tables give an empty result. Texts of any length are scored as a whole,
in overlapping blocks. Only id, text and language are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, lean, slices, stage
from .samples import Words, fold, hash32, parts

BITS, DIM, WIDTHS, FILTERS = 15, 12, (1, 2, 3), 8
#: Share of the words whose own hash is left out in a training step.
DROP = 0.4
STEMS = (3, 4, 5, 6, 7)
PARTS = 1 + len(STEMS)
#: Half of a shard's rows; passes over the first shard; least number of steps; texts a step.
ROWS, EPOCHS, LEAST_STEPS, BATCH = 3000, 6, 600, 32
PAD = max(WIDTHS) - 1
#: One of so many labelled rows calibrates thresholds and isn't trained on.
TUNE = 5
#: Pieces that models are summed in.
PIECES = 8
_NONE = 1 << BITS  # the row of the embedding that stays zero


def _hashes(word: str) -> np.ndarray:
    core = parts(word)[1].lower() or word[:8]
    found = [core, *("^" + core[:n] for n in STEMS if len(core) >= n)]
    ids = [hash32(x) >> 7 & (1 << BITS) - 1 for x in found]
    return np.array(ids + [_NONE] * (PARTS - len(ids)), np.int32)


def _root(n: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(n, 1)).astype(np.float32)


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.3, ((1 << BITS) + 1, DIM)).astype(np.float32)
        self.e[_NONE] = 0
        self.w = [r.normal(0, 1 / np.sqrt(DIM * k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.c = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.square = [np.full_like(a, 1e-6) for a in self.arrays()]  # of Adagrad

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.v, self.b, *self.w, *self.c]

    def vector(self) -> np.ndarray:
        """All numbers of the model and of its training."""
        return np.concatenate([a.reshape(-1) for a in (*self.arrays(), *self.square)])

    @classmethod
    def of(cls, vector: np.ndarray) -> Model:
        m, at = cls(), 0
        for a in (*m.arrays(), *m.square):
            a[...] = vector[at : at + a.size].reshape(a.shape)
            at += a.size
        return m

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """Word vectors from rows of hashes."""
        total = sum(self.e[ids[:, i]] for i in range(PARTS))
        return total / _root((ids != _NONE).sum(axis=1, keepdims=True))

    def maxima(self, x: np.ndarray, at: np.ndarray, where: bool = False):
        """For texts that begin at ``at[i]`` (with PAD zero rows after each, and once more at the end): the filters' maxima, and their places."""
        best, place = [], []
        void = (at[1:, None] - 1 - np.arange(PAD)).reshape(-1)  # windows that begin in padding hold nothing
        for w, c, k in zip(self.w, self.c, WIDTHS, strict=True):
            y = sum(x[j : len(x) - PAD + j] @ w[j] for j in range(k)) + c
            y[void] = c
            best.append(np.maximum.reduceat(y, at[:-1], axis=0))
            if where:
                place.append(np.stack([b + y[b:e].argmax(axis=0) for b, e in itertools.pairwise(at)]))
        return np.maximum(np.concatenate(best, axis=1), 0), place

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.v + self.b


def names(ids: np.ndarray) -> np.ndarray:
    """A number per row of hashes, the same for equal rows."""
    return ids.astype(np.int64) @ (np.int64(0x9E3779B97F4A7C1) * np.arange(1, 2 * PARTS, 2, dtype=np.int64))


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashes of texts one after another, each padded; where each begins, with the end."""
    gap = np.full((PAD, PARTS), _NONE, np.int32)
    at = np.concatenate([[0], np.cumsum([len(t) + PAD for t in texts])])
    return np.concatenate([*(x for t in texts for x in (t, gap)), gap]), at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, start: Model | None = None) -> Model:
    """A new model, or one pass of ``start`` over the texts."""
    m, r = start or Model(), np.random.default_rng(11)
    if start is None:
        m.b[:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    weight = np.where(labels == 1, max(1.0, (labels == 0).sum() / max(1, labels.sum())) ** 0.5, 1.0)
    square = dict(zip(["e", "v", "b", *[("w", i) for i in range(len(WIDTHS))], *[("c", i) for i in range(len(WIDTHS))]], m.square, strict=True))

    def step(key, a, g, rows=None):
        s = square[key]
        if rows is None:
            s += g * g
            a -= rate * g / np.sqrt(s)
        else:
            s[rows] += g * g
            a[rows] -= rate * g / np.sqrt(s[rows])

    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(texts)))) if start is None else 1):
        order = r.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            ids, at = lay_out([texts[i].astype(np.int32) for i in own])
            _, one, back = np.unique(names(ids), return_index=True, return_inverse=True)
            own_rows = ids[one]
            stemmed = (r.random(len(one)) < DROP) & (own_rows[:, 1] != _NONE)
            own_rows[stemmed, 0] = _NONE  # learn from the stems alone
            x, ids = m.vectors(own_rows)[back], own_rows[back]
            pooled, place = m.maxima(x, at, where=True)
            d = ((_sigmoid(m.logit(pooled)) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = d[:, None] * m.v * (pooled > 0)
            touched, grads = [], []
            void = np.zeros(len(x), bool)
            void[(at[1:, None] - 1 - np.arange(PAD)).reshape(-1)] = True
            step("v", m.v, pooled.T @ d)
            step("b", m.b, d.sum(keepdims=True))
            for i, width in enumerate(WIDTHS):
                g, p = back[:, i * FILTERS : (i + 1) * FILTERS], place[i]
                step(("c", i), m.c[i], g.sum(axis=0))
                g = np.where(void[p], 0, g).astype(np.float32)
                gw = np.zeros_like(m.w[i])
                for j in range(width):
                    near = x[p + j]  # text, filter, dimension
                    gw[j] = np.einsum("tf,tfd->df", g, near)
                    touched.append((p + j).reshape(-1))
                    grads.append((g[:, :, None] * m.w[i][j].T[None]).reshape(-1, DIM))
                step(("w", i), m.w[i], gw)
            rows = ids[np.concatenate(touched)]
            share = np.concatenate(grads) / _root((rows != _NONE).sum(axis=1, keepdims=True))
            flat, inverse = np.unique(rows.reshape(-1), return_inverse=True)
            g = np.zeros((len(flat), DIM), np.float32)
            np.add.at(g, inverse.reshape(-1), np.repeat(share, PARTS, axis=0))
            g[flat == _NONE] = 0
            step("e", m.e, g, flat)
    return m


_hashed = Words(_hashes)


def _rows(text: str) -> np.ndarray:
    found = _hashed(text.split())
    return np.array(found, np.int32).reshape(-1, PARTS)


def _hash_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            raw = [_rows(x).astype("<u2").tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "label", "lang")), pa.array(raw, pa.binary())], names=["key", "label", "lang", "words"])


def _trained(start):
    """For the rows of a shard: the model trained on them, anew or from the broadcast numbers of a model, in pieces."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        rows = rows.sort_by([("key", "ascending"), ("words", "ascending"), ("label", "ascending")])  # one order whatever the partitions
        texts = [np.frombuffer(x.as_py(), "<u2").reshape(-1, PARTS) for x in rows.column("words")]
        m = train(texts, rows.column("label").to_numpy(), start=Model.of(start.value) if start else None)
        pieces = [x.astype("<f4").tobytes() for x in np.array_split(m.vector(), PIECES)]
        return pa.table({"piece": pa.array(range(PIECES), pa.int32()), "shard": pa.array([shard] * PIECES, pa.int64()), "numbers": pa.array(pieces, pa.binary())})

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of one piece of the models, added up in one order."""
    rows = rows.sort_by("shard")
    total = sum(np.frombuffer(x.as_py(), "<f4").astype(float) for x in rows.column("numbers")) / len(rows)
    return pa.table({"piece": rows.column("piece").slice(0, 1), "numbers": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _learn(rows: DataFrame, start: np.ndarray | None = None) -> np.ndarray:
    """The numbers of the mean of the models that the shards train."""
    shared = None if start is None else rows.sparkSession.sparkContext.broadcast(start)  # of fixed size
    models = rows.select("shard", "key", "label", "words").groupBy("shard").applyInArrow(_trained(shared), "piece int, shard long, numbers binary")
    got = models.groupBy("piece").applyInArrow(_mean, "piece int, numbers binary").collect()  # PIECES rows
    return np.concatenate([np.frombuffer(x["numbers"], "<f4") for x in sorted(got, key=lambda x: x["piece"])])


def _limit(rows: pa.Table) -> pa.Table:
    scores, y = rows.column("score").to_numpy(), rows.column("label").to_numpy()
    order = np.lexsort((y, scores))
    return pa.table({"lang": rows.column("lang").slice(0, 1), "limit": pa.array([_threshold(scores[order], y[order])], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", rows: int = ROWS, lang: str | None = "lang") -> tuple[Model | None, dict[str | None, float]]:
    """The model, and thresholds by language (under None: of all)."""
    known = labels.where(allowed & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    known = stage(known, "toxicity-labels")
    spoken = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), spoken.alias("lang")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = texts.join(bounded(known), "doc_id").select("key", "label", "lang", "text")
    found = stage(found.mapInArrow(_hash_rows, "key long, label int, lang string, words binary"), "toxicity-words")
    tuned = F.pmod("key", F.lit(TUNE)) == TUNE - 1
    count = {(x["tuned"], x["label"]): x["count"] for x in found.groupBy(tuned.alias("tuned"), "label").count().collect()}  # at most 4 rows
    if not count:
        return None, {None: 0.5}
    # Of few rows a whole label may be among those that calibrate; all are trained on then.
    learnt = found if {y for _, y in count} != {y for u, y in count if not u} else found.where(~tuned)
    shards = math.ceil(sum(n for (u, _), n in count.items() if learnt is found or not u) / (2 * rows))
    learnt = learnt.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    first = learnt.agg(F.min("shard")).first()[0]
    numbers = _learn(learnt.where(F.col("shard") == first))
    if shards > 1:
        numbers = _learn(learnt, numbers)
    m = Model.of(numbers)
    shared = found.sparkSession.sparkContext.broadcast(m)

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                held = [np.frombuffer(x, "<u2").astype(np.int32).reshape(-1, PARTS) for x in part.column("words").to_pylist()]
                values = _sigmoid(shared.value.logit(pool(shared.value, held)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("lang"), pa.array(values)], names=["label", "lang", "score"])

    scores = stage(found.where(tuned).mapInArrow(scored, "label int, lang string, score double"), "toxicity-scores")
    of = lambda x: x.groupBy("lang").applyInArrow(_limit, "lang string, limit double").collect()  # noqa: E731  # a row a language
    limits = {None: next((x["limit"] for x in of(scores.withColumn("lang", F.lit("")))), 0.5)}
    limits |= {x["lang"]: x["limit"] for x in of(scores)}
    discard(known, found, scores)
    return m, limits


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1; in the middle between neighbouring scores. 0.5 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-scores)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((scores[order[k]] + below) / 2)


def pool(m: Model, texts: list[np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """Maxima of each text; long texts are taken in overlapping blocks."""
    out, k = np.zeros((len(texts), len(m.v)), np.float32), 0
    while k < len(texts):
        if len(texts[k]) > block:
            for b in range(0, len(texts[k]), block):
                x, at = lay_out([texts[k][b : b + block + PAD]])
                out[k] = np.maximum(out[k], m.maxima(m.vectors(x), at)[0][0])
            k += 1
            continue
        e, n = k, 0
        while e < len(texts) and n + len(texts[e]) <= block:
            n, e = n + len(texts[e]), e + 1
        x, at = lay_out(texts[k:e])
        out[k:e] = m.maxima(m.vectors(x), at)[0]
        k = e
    return out


class _Table:
    """Word vectors of a worker for one model: each distinct word's vector is made once."""

    def __init__(self, m: Model):
        self.m, self.x, self.n, self.known = m, np.zeros((1 << 16, DIM), np.float32), 1, {}

    def trim(self) -> None:
        """Begin anew if full; earlier ids are void then."""
        if self.n > 300_000:
            self.n, self.known = 1, {}

    def ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new:
            while self.n + len(new) > len(self.x):
                self.x = np.concatenate([self.x, np.zeros_like(self.x)])
            self.x[self.n : self.n + len(new)] = self.m.vectors(np.stack([_hashes(w) for w in new]))
            self.known.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _pool_words(table: _Table, texts: list[str], block: int = 1 << 15) -> np.ndarray:
    m, out = table.m, np.zeros((len(texts), len(table.m.v)), np.float32)
    held, owner, n = [], [], 0

    def flush():
        nonlocal held, owner, n
        if held:
            at = np.concatenate([[0], np.cumsum([len(h) + PAD for h in held])])
            ids = np.zeros(at[-1] + PAD, np.int64)
            for b, h in zip(at[:-1], held, strict=True):
                ids[b : b + len(h)] = h
            np.maximum.at(out, owner, m.maxima(table.x[ids], at)[0])
        held, owner, n = [], [], 0
        table.trim()

    for k, text in enumerate(texts):
        words = text.split()
        for b in range(0, max(1, len(words)), block):
            if n and n + len(words) - b > block:
                flush()
            held.append(table.ids(words[b : b + block + PAD]))
            owner.append(k)
            n += len(held[-1])
    flush()
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``score`` to rows; the column ``text`` is dropped."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    if model is None:
        return docs.drop("text").withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches):
        table = _Table(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                values = _sigmoid(table.m.logit(_pool_words(table, part.column("text").to_pylist())).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(values)], names=[*[f.name for f in kept], "score"])

    return docs.mapInArrow(lean(run), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double"]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = ROWS, lang: str | None = "lang") -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged`` per row.

    ``predicted`` cuts at 0.5; ``flagged`` cuts at the threshold calibrated for the row's language.
    """
    model, limits = fit(docs, labels, fold(modulus) != held, rows=rows, lang=lang)
    inputs = docs.select("doc_id", (fold(modulus) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string") if lang else F.lit(""), F.lit("")).alias("lang"))
    table = F.create_map(*[F.lit(x) for k, v in limits.items() if k is not None for x in (k, v)]) if len(limits) > 1 else F.create_map(F.lit(""), F.lit(limits[None]))
    out = score(inputs, model).withColumn("threshold", F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(limits[None])))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
