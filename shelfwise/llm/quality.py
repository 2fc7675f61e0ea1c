"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages of equal length.  A passage is encoded from its words (hashed) and their
shapes; gated attention weighs the passages, and a logistic layer scores the weighted sum.  Only documents
have labels, the weights of passages are learned from them.  The fit takes a bounded sample of labelled
documents and runs in one task; scoring walks every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import Out, batch, rows, spark_schema, text_bytes

BUCKETS = 1 << 13  # hashed words in the lower half, hashed shapes in the upper
WIDTH = 16
PASSAGE = 64  # words
MAX_DOCS = 6000  # labelled documents that the fit reads, as near as a hash of the id can say
EPOCHS = 12
CACHE_WORDS = 200_000
LONG = 200  # characters; a longer word counts as several words of so many
SAMPLE = pa.schema([("doc_id", pa.string()), ("label", pa.int64()), ("features", pa.binary())])
WEIGHTS = pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.binary())])

_UPPER, _LOWER, _DIGITS, _SAME = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]+", r"[^\W\d_A-Z]+", r"\d+", r"([^\w\s])\1+"))


def shape(word: str) -> str:
    """A word with runs of capitals, other letters, digits and equal marks each written once: ``Ab!!`` is ``Aa!``."""
    return _SAME.sub(r"\1", _DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))


def pieces(word: bytes) -> list[bytes]:
    if len(word) <= LONG:
        return [word]
    text = word.decode("utf-8", "replace")
    return [text[a:a + LONG].encode() for a in range(0, len(text), LONG)]


class Features(dict):
    """word -> (word bucket) * BUCKETS + (shape bucket)"""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        half = BUCKETS // 2
        text = word.decode("utf-8", "replace")
        got = (xxhash.xxh3_64_intdigest(text.lower()) % half) * BUCKETS + half + xxhash.xxh3_64_intdigest(shape(text)) % half
        self[word] = got
        return got

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.split()
        if max(map(len, words), default=0) > LONG:
            words = [piece for word in words for piece in pieces(word)]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def passages(size: int) -> np.ndarray:
    """First words of the passages of a text with so many words; a text without words is one empty passage."""
    return np.arange(0, max(size, 1), PASSAGE)


@dataclass
class Classifier:
    weights: dict[str, np.ndarray]

    def attend(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates, attention and scores of documents whose passages begin at ``starts``."""
        w = self.weights
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
        raw = (v * u) @ w["w"]
        sizes = np.diff(np.append(starts, len(h)))
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return v, u, a, z, 1 / (1 + np.exp(-(z @ w["c"] + w["c0"])))

    def encode(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.tanh(sums / np.maximum(sizes, 1)[:, None] + self.weights["b"])


def train(docs: list[tuple[int, np.ndarray]], seed: int = 3) -> Classifier:
    """Adam on the cross-entropy of (label, features) documents; the loss reaches words, gates and attention."""
    rng = np.random.default_rng(seed)
    table = rng.normal(size=(BUCKETS, WIDTH)) * 0.3
    w = {"table": table, "b": np.zeros(WIDTH), "v": rng.normal(size=(WIDTH, 8)) * 0.3, "u": rng.normal(size=(WIDTH, 8)) * 0.3,
         "w": rng.normal(size=8) * 0.3, "c": rng.normal(size=WIDTH) * 0.3, "c0": np.zeros(1)}
    model = Classifier(w)
    if not docs:
        return model
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}
    step = 0
    size = 128
    for epoch in range(EPOCHS):
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // size)):
            y = np.array([docs[i][0] for i in at], float)
            counts = [len(passages(len(docs[i][1]))) for i in at]
            starts = np.cumsum([0, *counts[:-1]])
            feats = np.concatenate([docs[i][1] for i in at])
            of = np.concatenate([first + np.arange(len(docs[i][1])) // PASSAGE for i, first in zip(at, starts)]).astype(np.int64)
            n = int(sum(counts))
            length = np.bincount(of, minlength=n)
            word, form = feats // BUCKETS, feats % BUCKETS
            sums = np.stack([np.bincount(of, w["table"][word, d] + w["table"][form, d], n) for d in range(WIDTH)], axis=1)
            h = model.encode(sums, length)
            v, u, a, z, p = model.attend(h, starts)
            of_doc = np.repeat(np.arange(len(at)), counts)
            ds = (p - y) / len(at)
            dz = ds[:, None] * w["c"]
            da = (h * dz[of_doc]).sum(axis=1)
            draw = a * (da - np.add.reduceat(a * da, starts)[of_doc])
            dvu = draw[:, None] * w["w"]
            dv, du = dvu * u * (1 - v ** 2), dvu * v * u * (1 - u)
            dh = a[:, None] * dz[of_doc] + dv @ w["v"].T + du @ w["u"].T
            dx = dh * (1 - h ** 2)
            per_word = (dx / np.maximum(length, 1)[:, None])[of]
            dt = np.stack([np.bincount(word, per_word[:, d], BUCKETS) + np.bincount(form, per_word[:, d], BUCKETS) for d in range(WIDTH)], axis=1)
            grads = {"table": dt + 1e-6 * w["table"], "b": dx.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "w": (v * u).T @ draw,
                     "c": z.T @ ds + 1e-4 * w["c"], "c0": np.array([ds.sum()])}
            step += 1
            for k, g in grads.items():
                m, s = moment[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, out = Features(), Out(SAMPLE)
    for key, label, raw in rows(batches, "key", "label", "text"):
        got = features.of(raw).astype("<u4")
        if out.add(key, label, got.tobytes(), size=got.nbytes):
            yield out.take()
    yield out.take()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted(rows(batches, "doc_id", "label", "features"))
    model = train([(label, np.frombuffer(f, "<u4").astype(np.int64)) for _, label, f in got])
    names = list(model.weights)
    yield batch(WEIGHTS, [names, [list(model.weights[k].shape) for k in names], [model.weights[k].astype("<f4").tobytes() for k in names]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS) -> Classifier:
    """Learn from documents that ``labels`` (id, 0 or 1) marks; other label values and nulls are left out, 1 wins where an id has both.

    Above ``max_docs`` labelled ids those with the smallest hashes serve, ``max_docs`` of them but for chance.  The ids of the sample
    are broadcast, so ``docs`` is filtered where it lies.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("long").alias("label"))
    share = min(1.0, max_docs / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    named = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("text"))
    sample = named.join(F.broadcast(chosen), "__id").select(F.col("__id").cast("string").alias("key"), "label", "text")
    fitted = sample.mapInArrow(_sample, spark_schema(SAMPLE)).repartition(1).mapInArrow(_fit, spark_schema(WEIGHTS)).collect()
    return Classifier({r.name: np.frombuffer(r["values"], "<f4").reshape(r["shape"]) for r in fitted} if fitted else train([]).weights)


def _scores(schema: pa.Schema, model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, out = Features(), Out(schema)
        table = model.weights["table"].astype(np.float32)

        def scored(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            feats = [features.of(raw) for _, raw in held]
            sizes = np.fromiter(map(len, feats), np.int64, len(feats))
            counts = np.maximum(1, -(-sizes // PASSAGE))
            starts = np.cumsum(counts) - counts
            flat = np.concatenate(feats)
            length = np.minimum(PASSAGE, np.repeat(sizes, counts) - PASSAGE * (np.arange(counts.sum()) - np.repeat(starts, counts)))
            sums = np.zeros((len(length), WIDTH))
            some = length > 0
            if some.any():
                x = table[flat // BUCKETS]
                x += table[flat % BUCKETS]
                begin = np.cumsum(length) - length
                sums[some] = np.add.reduceat(x, begin[some], axis=0)
            *_, p = model.attend(model.encode(sums, length), starts)
            for (key, _), score in zip(held, p.tolist()):
                if out.add(key, score):
                    yield out.take()

        held, size = [], 0
        for row in rows(batches, "doc_id", "text"):
            held.append(row)
            size += len(row[1])
            if size > 1 << 20:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)
        yield out.take()
    return run


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; 0 to 1, higher for label 1.  Null and empty texts are one empty passage and get its score."""
    from pyspark.sql.pandas.types import to_arrow_type

    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = pa.schema([("doc_id", to_arrow_type(named.schema["doc_id"].dataType)), ("score", pa.float64())])
    return named.mapInArrow(_scores(schema, model), spark_schema(schema))


def keep_scored(docs: DataFrame, model: Classifier, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns unchanged; rows are judged where they lie.

    Columns may have any names; a text that is no valid UTF-8 is scored with its bad bytes replaced and kept as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([f.with_nullable(True) for f in to_arrow_schema(docs.schema)])
    inner = _scores(pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]), model)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                text = [t or b"" for t in b.column(position).cast(pa.binary()).to_pylist()]
                numbered = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), pa.array(text, pa.binary())], names=["doc_id", "text"])
                good = [n for part in inner(iter([numbered])) for n, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if s >= least]
                if good:
                    yield pa.RecordBatch.from_arrays(b.take(pa.array(good)).columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)
