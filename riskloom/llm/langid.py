"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier per bit (logistic regression on hashed byte n-grams) predicts it.
Decoding takes the codeword of least loss, each bit weighted by its training margin, and flags ambiguity where the
runner-up is close.  The classifiers are fitted on about PER_LANGUAGE labelled documents of each language, chosen by a
hash of the id; predictions read whole texts and nothing else.  Every label is learned: a sample beyond TASK_ROWS is
fitted by many tasks, whose gradients are summed at each step.

Defined results: a text that is null or has no letter is `und` with score 0 and not ambiguous; without labelled
documents all texts are `und`; with one language it is predicted for every text with a letter; an empty table gives
no rows; other columns are carried along.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_side
from .tokens import LOWER

#: Documents of each language that classifiers are fitted on, on average, rows of 16 KB that one task may hold, and rows that are widened at once.
PER_LANGUAGE, TASK_ROWS, BLOCK = 500, 8000, 256
DIMS, EPOCHS, RATE, DECAY = 4096, 300, 0.5, 1e-4
#: A runner-up whose loss is within this share of the best one's distance is ambiguous.
AMBIGUOUS = 0.1
UND = "und"
#: Classes up to which the best of many random codes is taken.
TRIED = 100


def has_letter(text: str) -> bool:
    """Whether a character is a letter (of a Unicode category L); other numerals and signs aren't."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 4-grams of the whole text, A-Z lower-cased."""
    a = LOWER[np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)].astype(np.uint32)
    counts, code = np.zeros(DIMS), a * np.uint32(0)
    for n in range(1, 5):
        code = code[: len(a) - n + 1] * np.uint32(257) + a[n - 1 :] + np.uint32(1)
        if not len(code):
            break
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return np.sqrt(counts / counts.sum())


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A row of -1 and 1 for each class: the exhaustive code up to six classes, else a random one of many tries."""
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((-1, 1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T.reshape(n, -1)
    r, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    # random words of this length are far apart as they are; few classes can be told apart by trying, many needn't
    for _ in range(200 if n <= TRIED else 1):
        code = r.choice((-1.0, 1.0), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = (code @ code.T - 2 * code.shape[1] * np.eye(n)).max() if n <= TRIED else 0
        if best is None or near / code.shape[1] < best[0]:
            best = (near / code.shape[1], code)
    return best[1]


@dataclass(frozen=True)
class Codes:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    margin: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and ambiguity of each row of features."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x)), np.zeros(len(x), dtype=bool)
        bit = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        bit = np.clip(bit, -30, 30)
        loss = (np.log1p(np.exp(-bit)) * self.margin) @ (self.code.T > 0) + (np.log1p(np.exp(bit)) * self.margin) @ (self.code.T < 0)
        two = np.partition(loss, 1, axis=1)[:, :2]
        odds = np.exp(-(loss - two[:, :1]))
        return loss.argmin(axis=1), 1 / odds.sum(axis=1), (two[:, 1] - two[:, 0]) < AMBIGUOUS * (1e-9 + two[:, 1])


def _slope(x1: np.ndarray, target: np.ndarray, share: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The loss's gradient over weighted rows."""
    slope = -target / (1 + np.exp(np.clip(target * (x1 @ w), -30, 30)))
    return x1.T @ (slope * share[:, None])


def _agreement(x1: np.ndarray, target: np.ndarray, share: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per bit, the weight of rows on the right side less that of the others."""
    return (np.sign(x1 @ w) * target * share[:, None]).sum(axis=0)


def _descend(languages: list[str], code: np.ndarray, total: Callable[[Callable, np.ndarray], np.ndarray]) -> Codes:
    """One logistic regression per bit, all fitted together by gradient descent; total(f, w) sums f over the rows."""
    w, speed = np.zeros((DIMS + 1, code.shape[1])), np.zeros((DIMS + 1, code.shape[1]))
    for _ in range(EPOCHS):
        speed = 0.9 * speed - RATE * (total(_slope, w) * 4 + DECAY * w)
        w = w + speed
    margin = np.clip(total(_agreement, w), 0.01, 1)
    return Codes(tuple(languages), code, w, margin / margin.mean())


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Codes:
    """The classifiers from class-balanced rows, which are widened BLOCK at a time, so that memory is that of x and a block."""
    code = codewords(len(languages))
    if len(languages) == 1:
        return Codes(tuple(languages), code, np.zeros((DIMS + 1, 0)), np.ones(0))
    share = 1 / np.bincount(y, minlength=len(languages))[y] / len(languages)

    def total(f: Callable, w: np.ndarray) -> np.ndarray:
        wide, out = np.ones((BLOCK, DIMS + 1)), 0.0
        for at in range(0, len(x), BLOCK):
            n = min(BLOCK, len(x) - at)
            wide[:n, :DIMS] = x[at : at + n]
            out = out + f(wide[:n], code[y[at : at + n]], share[at : at + n], w)
        return out

    return _descend(languages, code, total)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled fields of the classifiers fitted on all rows (lang, x) of a task, whatever their order."""
    lang, keys, parts = [], [], []
    for b in batches:
        lang += b.column("lang").to_pylist()
        parts.append(np.stack([np.frombuffer(v.as_buffer(), dtype=np.float32) for v in b.column("x")]))
        keys += [xxhash.xxh3_128_digest(row) for row in parts[-1]]
        del b
    order = np.array(sorted(range(len(lang)), key=lambda i: (lang[i], keys[i])))
    # each part's rows go to their places, and then the part goes
    place, x, at = np.argsort(order), np.empty((len(lang), DIMS), dtype=np.float32), 0
    while parts:
        part = parts.pop(0)
        x[place[at : at + len(part)]] = part
        at += len(part)
        del part
    languages = sorted(set(lang))
    model = fit(x, np.array([languages.index(lang[i]) for i in order]), languages)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.languages, model.code, model.weights, model.margin))], pa.binary())], names=["model"])


def fit_in_spark(found: DataFrame, counts: dict[str, int]) -> Codes:
    """The same from a saved table of lang and x that one task can't hold: a job for each step."""
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) == 1:
        return Codes(tuple(languages), code, np.zeros((DIMS + 1, 0)), np.ones(0))
    index, sc = {v: i for i, v in enumerate(languages)}, found.sparkSession.sparkContext

    def total(f: Callable, w: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in some.column("x").to_pylist()]).astype(float)
                    lang = some.column("lang").to_pylist()
                    share = np.array([1 / counts[v] / len(index) for v in lang])
                    found_ = f(np.hstack([x, np.ones((len(x), 1))]), code[[index[v] for v in lang]], share, shared.value)
                    out = found_ if out is None else out + found_
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

        parts = found.coalesce(32).mapInArrow(part, "g binary").collect()
        out = sum(np.frombuffer(r["g"]) for r in parts)
        shared.destroy()
        return out.reshape(w.shape) if f is _slope else out

    return _descend(languages, code, total)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, learn: Column | None = None) -> Codes | None:
    """Classifiers from the labelled documents that are not held out; None if there are none."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = saved(rows.groupBy("lang").agg((F.lit(float(PER_LANGUAGE)) / F.count("*")).alias("share")))
    chance = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 20)) / float(1 << 20)
    known = rows.join(small_side(share), "lang").filter(chance < F.col("share"))
    sample = saved(known.select("text", "lang").mapInArrow(_with_features, "lang string, x binary"))
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not counts:
        return None
    if sum(counts.values()) > TASK_ROWS:
        return fit_in_spark(sample, counts)
    # a bounded sample: one task fits it, so that the driver holds the weights only
    (one,) = sample.coalesce(1).mapInArrow(_fit_rows, "model binary").collect()
    return Codes(*pickle.loads(bytes(one["model"])))


def identify(docs: DataFrame, model: Codes | None) -> DataFrame:
    """The documents with lang_pred, score and ambiguous."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*own)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, doubt = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            some = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                best, score[part], doubt[part] = model.decode(np.stack([features(texts[i]) for i in part]))
                for i, b in zip(part, best, strict=True):
                    lang[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(doubt)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(predict, schema)
