"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector, drawn from a fixed bank by its hash.  A word's context vector is the
sum of the index vectors met around it in a bounded sample of labelled documents; words outside the vocabulary
share the context of their shape.  A word's vector is the sum of both.  A document is pooled from its words' vectors
and nothing else: their mean over tokens, over distinct words and by squared frequency, and the mean of the
products of neighbours' vectors (componentwise, the usual binding of such vectors), which keeps word order.  A network of two layers, written in numpy, is trained on the sample and its
probabilities are calibrated by a temperature fitted on rows that the training left out.

Behaviour: a null text is an empty one; an empty text has zero vectors and gets the network's score for them;
without labels of both classes every score is 0.5; repeated rows score alike and a repeated id is one labelled
document; rows without an id are scored; a very long text is pooled in steps; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stratalog.llm.common import held_out, map_texts
from stratalog.llm.labelled import labelled_texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Labelled documents to learn from at most.
SAMPLE_ROWS = 5000
VECTOR, NONZERO, WINDOW, VOCABULARY, LEAST_DOCS = 64, 6, 2, 8000, 3
#: Index vectors in the bank; a step pools so many tokens at once.
BANK, STEP = 4096, 1 << 15
HIDDEN, EPOCHS, RATE, DECAY = 32, 250, 0.01, 1e-4
#: Distances at which neighbours are bound, by pool, and what damps the pools of short texts.
APART, DAMP = ((1,),), 5
POOLS = 3 + len(APART)


def shape(token: str) -> str:
    """The class that a token outside the vocabulary belongs to."""
    if not token[0].isalnum() and token[0] != "_":
        return "<mark>" if len(token) == 1 else "<marks>"
    kind = "digit" if token.isdigit() else "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower"
    return f"<{kind}{min(len(token), 12) // 4}>"


def index_bank() -> np.ndarray:
    """The sparse ternary index vectors, of length 1, and a zero vector at the end."""
    draw = np.random.default_rng(BANK)
    out = np.zeros((BANK + 1, VECTOR), dtype=np.float32)
    for row in out[:-1]:
        row[draw.choice(VECTOR, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO) / NONZERO**0.5
    return out


def index_of(token: str) -> int:
    return xxh64_intdigest(token) % BANK


def train_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    """The context vector of each shape and each word of the vocabulary, the latter with its index vector added."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(set(TOKEN.findall(t)))
    words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= LEAST_DOCS]
    shapes = sorted({shape(w) for w in seen})
    number = {w: i for i, w in enumerate([*shapes, *words])}
    rows = {w: number.get(w, number[shape(w)]) for w in seen}
    drawn = {w: index_of(w) for w in seen}
    bank = index_bank()
    context = np.zeros((len(number), VECTOR), dtype=np.float32)
    held: list[np.ndarray] = []
    waiting = 0

    def add() -> None:
        """Pairs of a word and a neighbour's index vector, weighed by the logarithm of their number."""
        codes, times = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(codes), STEP):
            own, of = np.divmod(codes[at : at + STEP], BANK)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            context[own[first]] += np.add.reduceat(bank[of] * np.log1p(times[at : at + STEP, None]).astype(np.float32), first)
        held.clear()

    for t in texts:
        tokens = TOKEN.findall(t)
        own, of = np.array([rows[w] for w in tokens], dtype=np.int64), np.array([drawn[w] for w in tokens], dtype=np.int64)
        for k in range(1, min(WINDOW, len(tokens) - 1) + 1):
            held += [own[:-k] * BANK + of[k:], own[k:] * BANK + of[:-k]]
            waiting += 2 * (len(own) - k)
        if waiting > 2_000_000:
            add()
            waiting = 0
    if held:
        add()
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    for w in words:
        context[number[w]] += bank[drawn[w]]
    return {w: context[i] for w, i in number.items()}


class Pooler:
    """Texts to the network's inputs."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.number = {w: i for i, w in enumerate(vectors)}
        # shapes that the sample lacks have no context
        self.known = np.array([*vectors.values(), np.zeros(VECTOR)], dtype=np.float32)
        self.bank = index_bank()

    def pool(self, text: str) -> np.ndarray:
        out = np.zeros((POOLS, VECTOR))
        tokens = TOKEN.findall(text)
        n = len(tokens)
        if not n:
            return out.ravel()
        place: dict[str, int] = {}
        order = np.array([place.setdefault(t, len(place)) for t in tokens])
        number, none = self.number, len(self.known) - 1
        row, drawn = np.empty(len(place), np.int64), np.full(len(place), BANK)
        for i, t in enumerate(place):
            k = number.get(t)
            if k is None:
                k, drawn[i] = number.get(shape(t), none), index_of(t)
            row[i] = k
        share = np.bincount(order) / n
        square = share * share
        for at in range(0, len(row), STEP):
            v = part = self.known[row[at : at + STEP]] + self.bank[drawn[at : at + STEP]]
            out[0] += share[at : at + STEP] @ v
            out[1] += v.sum(0, dtype=np.float64) / len(row)
            out[2] += square[at : at + STEP] @ v / square.sum() ** 0.5
        widest = max(map(max, APART))
        for at in range(0, n, STEP):
            # each step sees the tokens that its first ones are bound with
            back = min(at, widest)
            o = order[at - back : at + STEP]
            v = part[o] if len(row) <= STEP else self.known[row[o]] + self.bank[drawn[o]]
            for p, gaps in enumerate(APART, 3):
                for k in gaps:
                    left, right = v[max(0, back - k) : len(v) - k], v[max(back, k) :]
                    if len(right):
                        out[p] += np.einsum("ij,ij->j", left, right) / (n + DAMP)
        return out.ravel()


@dataclass
class Network:
    """tanh and a linear layer; ``heat`` divides its output before the sigmoid."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.a + self.b) @ self.c + self.d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam over minibatches of four fifths of the rows; the temperature from the last fifth."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    rest, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    net = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, turn = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        draw.shuffle(own)
        for at in range(0, len(own), 512):
            k = own[at : at + 512]
            h = np.tanh(z[k] @ net[0] + net[1])
            g = (1 / (1 + np.exp(-np.clip(h @ net[2] + net[3], -30, 30))) - y[k]) / len(k)
            back = np.outer(g, net[2]) * (1 - h * h)
            grads = [z[k].T @ back + DECAY * net[0], back.sum(0), h.T @ g + DECAY * net[2], np.array([g.sum()])]
            turn += 1
            for p, q, m, v in zip(net, grads, first, second, strict=True):
                m += 0.1 * (q - m)
                v += 0.001 * (q * q - v)
                p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    out = Network(mean, scale, net[0], net[1], net[2], float(net[3][0]))
    if len(rest) >= 20:
        raw, t = out.logits(x[rest]), y[rest]
        loss = lambda heat: np.logaddexp(0, -np.where(t > 0, raw, -raw) / heat).mean()
        out.heat = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return out


@dataclass
class QualityModel:
    vectors: dict[str, np.ndarray]
    network: Network | None


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    sample, _ = labelled_texts(docs, labels, "quality", rows, stratified=False)
    y = np.array([t for _, t in sample], dtype=float)
    if len(set(y)) < 2:
        return QualityModel({}, None)
    vectors = train_vectors([t for t, _ in sample])
    pooler = Pooler(vectors)
    return QualityModel(vectors, train_network(np.array([pooler.pool(t) for t, _ in sample]), y))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def start():
        model = shared.value
        pooler = Pooler(model.vectors)

        def work(part: dict) -> dict:
            texts = part["text"]
            scores = model.network.scores(np.array([pooler.pool(t or "") for t in texts])) if model.network and texts else [0.5] * len(texts)
            return {"doc_id": part["doc_id"], "score": [float(s) for s in scores], "predicted": [int(s >= threshold) for s in scores]}

        return work

    scored = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, predicted int", start)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
