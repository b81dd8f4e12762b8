"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Word vectors are statistics of the whole corpus. Each word (a token in lower case, by a hash to one of 2^``INDEX_BITS`` rows) has
a sparse random index vector; its vector is the sum of the index vectors of its neighbours within ``WINDOW`` tokens, over
all documents, scaled to length one. A row that no text has keeps its index vector. Tasks add up whole numbers in a table of
fixed size, and the tables are added in rounds of ``FAN``, so that neither the split nor the order changes the vectors.

The network is fitted on at most ``FIT_ROWS`` labelled documents whose crc32 remainder is not held out, those with
the smallest hash of their doc_id: this bound is a parameter, and all else covers all rows. They are pooled by the
executors; the driver gets their pooled numbers and no texts. A vector for a token's written shape (capitals, digits, marks) is
added to its word's. A document is pooled twice, over its tokens and over its distinct tokens, and its length and
share of distinct tokens are appended. A two-layer numpy network is trained on four fifths of the
documents; the temperature that calibrates its probabilities is found on the rest.

Scoring is one pass without an exchange; the fitted arrays, a few MB of fixed size, travel with
the function.

Defined cases: a null text is an empty text, and an empty text is pooled to zeros and scored; a
null doc_id counts as not held out when its remainder is null, and is scored; of labels that repeat a doc_id the highest
counts, of documents that do, the one whose pooled numbers are the least; without labels of
both kinds every score is 0.5; repeated rows stay repeated; an empty table gives an empty table;
other columns are ignored, and labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, least_hashes, mapped

DIMENSIONS, NONZERO, WINDOW, HIDDEN, INDEX_BITS = 48, 6, 2, 24, 15
INDEX_ROWS = 1 << INDEX_BITS
FIT_ROWS = 3000
#: Blocks that a table of sums is cut into, and tables that are added at once.
BLOCKS, FAN = 64, 64
#: Tokens of which contexts are made at once, and characters that are cut into tokens at once.
TOKENS, CHARACTERS = 100_000, 1_000_000
#: Token vectors that a process remembers; the memory is emptied when full.
REMEMBERED = 65_000
SPACE = re.compile(r"\s")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = ("lower", "title", "upper", "mixed", "digits", "marks")


@lru_cache(maxsize=1)
def index_signs() -> np.ndarray:
    """Sparse vectors of +1 and -1, a row for each token hash, and one of zeros for what is no word."""
    rng = np.random.RandomState(11)
    out = np.zeros((INDEX_ROWS + 1, DIMENSIONS), dtype=np.int8)
    places = np.argsort(rng.rand(INDEX_ROWS, DIMENSIONS), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:-1], places, rng.choice((-1, 1), places.shape).astype(np.int8), axis=1)
    return out


def index_row(token: str) -> int:
    return zlib.crc32(token.encode()) & (INDEX_ROWS - 1)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces cut at white space, so that no token is cut."""
    at = 0
    while len(text) - at > CHARACTERS and (m := SPACE.search(text, at + CHARACTERS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def shape(token: str) -> str:
    if token[0].isalpha():
        return "lower" if token.islower() else "upper" if token.isupper() and len(token) > 1 else "title" if token.istitle() else "mixed"
    return "digits" if token[0].isdigit() else "marks"


class Contexts:
    """Sums of the index vectors of all words' neighbours, in whole numbers."""

    def __init__(self) -> None:
        self.sums = np.zeros((INDEX_ROWS + 1, DIMENSIONS), dtype=np.int32)
        self.rows: dict[str, int] = {}
        self.ids: list[int] = []

    def add(self, text: str) -> None:
        rows = self.rows
        for piece in pieces(text.lower()):
            tokens = TOKEN.findall(piece)
            if len(rows) > REMEMBERED:
                rows.clear()
            new = set(tokens).difference(rows)
            rows.update(zip(new, map(index_row, new), strict=True))
            self.ids += map(rows.__getitem__, tokens)
            if len(piece) < len(text):
                self.flush()
        self.ids += [INDEX_ROWS] * WINDOW  # no context across documents
        if len(self.ids) > TOKENS:
            self.flush()

    def flush(self) -> None:
        """Adds what was gathered; this happens between documents, or at fixed places of long ones."""
        ids = np.array(self.ids, dtype=np.int32)
        self.ids = []
        for at in range(0, len(ids), TOKENS):
            own = ids[max(0, at - WINDOW) : at + TOKENS + WINDOW]
            signs = index_signs()[own]
            context = np.zeros(signs.shape, dtype=np.int8)
            for step in range(1, WINDOW + 1):
                context[step:] += signs[:-step]
                context[:-step] += signs[step:]
            skip = min(at, WINDOW)
            own, context = own[skip : skip + TOKENS], context[skip : skip + TOKENS]
            order = np.argsort(own, kind="stable")
            firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
            self.sums[own[order][firsts]] += np.add.reduceat(context[order], firsts, axis=0, dtype=np.int32)


TABLES = "block int, part bigint, sums binary"


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all word rows, from all documents."""
    scratch = Scratch(docs.sparkSession, "quality")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Contexts()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                got.add(text)
        got.flush()
        cut = [x.tobytes() for x in np.split(got.sums[:-1], BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()), pa.array(cut, pa.binary())], ["block", "part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.int32) for b in table.column("sums").to_pylist()], axis=0, dtype=np.int32)
        return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = scratch.keep(mapped(docs.where(F.length("text") > 0).select("text"), tables, TABLES))
    last = found.agg(F.max("part")).first()[0]
    while last is not None and last > 0:
        found = scratch.keep(found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(added, TABLES))
        last //= FAN
    rows = {r.block: np.frombuffer(r.sums, np.int32) for r in found.collect()}  # one table of fixed size
    signs = index_signs()[:-1].astype(np.float32)
    sums = np.concatenate([rows[i] for i in range(BLOCKS)]).reshape(signs.shape).astype(np.float32) if rows else np.zeros_like(signs)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    scratch.drop_all()
    return np.where(norm > 0, sums / np.maximum(norm, 1e-9), signs / math.sqrt(NONZERO)).astype(np.float32)


class Pooling:
    """Pools texts to rows of ``width`` numbers."""

    width = 2 * DIMENSIONS + 2 * len(SHAPES) + 3

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS + len(SHAPES)), dtype=np.float32)

    def row(self, token: str) -> int:
        i = len(self.rows)
        if i == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[i, :DIMENSIONS] = self.vectors[index_row(token.lower())]
        self.matrix[i, DIMENSIONS + SHAPES.index(shape(token))] = 1
        self.rows[token] = i
        return i

    def pool(self, text: str) -> np.ndarray:
        counts: Counter = Counter()
        for piece in pieces(text):
            counts.update(TOKEN.findall(piece))
        if not counts:
            return np.zeros(self.width, dtype=np.float32)
        if len(self.rows) + len(counts) > REMEMBERED:
            self.forget()
        rows = self.rows
        ids = np.array([rows[t] if t in rows else self.row(t) for t in counts], dtype=np.int64)
        n = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        got, total = self.matrix[ids], float(n.sum())
        return np.concatenate([n @ got / total, got.mean(axis=0), [math.log1p(total) / 10, len(counts) / total, min(1.0, len(text) / total / 20)]]).astype(np.float32)


@dataclass
class Network:
    """Two layers on scaled inputs, and the temperature that divides the last layer's number."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Network | None:
    """A network fitted by Adam from a fixed start; None unless both labels occur."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.RandomState(7)
    held = np.arange(len(y)) % 5 == 4
    fit = ~held if len(set(y[~held].tolist())) == 2 else np.ones(len(y), bool)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z, t = (x[fit] - net.mean) / net.scale, y[fit]
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    weight = 0.5 + 0.5 * weight
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        h = np.tanh(z @ params[0] + params[1])
        off = weight * (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t) / len(t)
        back = np.outer(off, params[2]) * (1 - h * h)
        grads = [z.T @ back + decay * params[0], back.sum(0), h.T @ off + decay * params[2], np.array([off.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    net.temperature = calibrate(net.logits(x[held]), y[held]) if held.any() else 1.0
    return net


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, g = -2.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network | None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fits on at most ``rows`` labelled documents, those of the smallest hash that aren't held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = least_hashes(each, "doc_id", rows, each.count())
    marks = {r.doc_id: float(r.quality >= 1) for r in chosen.collect()}
    if len(set(marks.values())) < 2:
        return Classifier(np.zeros((INDEX_ROWS, DIMENSIONS), np.float32), None)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling = Pooling(shared.value)
        for batch in batches:
            x = [pooling.pool(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    wanted = docs.sparkSession.createDataFrame([(k,) for k in marks], "wanted bigint")
    labelled = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    found = mapped(labelled, pooled, "doc_id bigint, x array<float>").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    x = np.array([r.x for r in found], dtype=np.float64).reshape(-1, Pooling.width)
    return Classifier(vectors, train(x, np.array([marks[r.doc_id] for r in found])))


def scored(docs: DataFrame, classifier: Classifier, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and score of each document, and its columns named by ``keep`` (a column score of its own gives way)."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *(c for c in keep if c not in ("doc_id", "_text", "score")))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = kept.drop("_text")
    names = [*schema.columns, "score"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        pooling = Pooling(got.vectors)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if got.network is None or not texts:
                score = np.full(len(texts), 0.5)
            else:
                score = got.network.score(np.array([pooling.pool(t) for t in texts], dtype=np.float64))
            columns = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names)

    return mapped(kept, run, ddl)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(docs: DataFrame, classifier: Classifier, at: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``at``, with the columns of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        pooling = Pooling(got.vectors)
        for batch in batches:
            if got.network is not None and batch.num_rows:
                x = np.array([pooling.pool(t or "") for t in batch.column(1).to_pylist()], dtype=np.float64)
                batch = batch.filter(pa.array(got.network.score(x) >= at))
            yield batch

    return mapped(docs.select(*COLUMNS), run, "doc_id bigint, text string, lang string, source string, n_chars bigint")
