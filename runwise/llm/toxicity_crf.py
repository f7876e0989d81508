"""Toxic spans by a linear-chain conditional random field.

Training.  Labels are given per document, so tokens are labelled first: a word or word
beginning that is frequent in toxic and absent from clean documents marks its tokens.  A
two-state chain (clean, toxic) with word features is then fitted to those token
sequences by the gradient of the conditional likelihood.  Training reads a bounded sample:
at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents, chosen by a hash of their
id, and ``TRAIN_TOKENS`` of their tokens.

Scoring.  Forward-backward marginals of every token of every whole text; spans of tokens
more likely toxic than not give offsets, and the largest marginal, calibrated on the
training sample, gives the document's score.  The recursions run over all documents of
a block at once, one time step after the other, in the log-odds of the two states.

Defined results: null, empty and wordless texts get the calibrated score of the least
marginal; a row whose doc_id is null is not held out; repeated label rows of a document
count once, toxic if any of them is; without labelled rows of both kinds all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwise.llm.common import make_room

# Bounds of the training sample and of the model.
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 2000
TRAIN_TOKENS = 400_000
MODEL_FEATURES = 200_000
FOLDS = 5

# A feature marks toxic tokens if so many toxic documents have it, at this log ratio of shares.
MARK_DOCS = 10
MARK_RATIO = 3.5

# Calibration: weight of toxic documents, and log-odds below which no token makes a document toxic.
TOXIC_SHARE = 0.25
CLEARLY_CLEAN = -1.0

BLOCK_TOKENS = 1_000_000
LEAST = -20.0  # log-odds given to texts without words

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> tuple[str, ...]:
    """A word, its beginnings and its ending; beginnings only where the word goes on."""
    return tuple(["=" + word] + ["^" + word[:k] for k in (3, 4, 5) if len(word) > k] + ["$" + word[-3:]])


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major layout of sequences laid end to end.

    Returns where each token goes, the first index of each time step, and how many
    sequences are that long; sequences are taken longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    steps = int(lengths.max()) if len(lengths) else 0
    width = len(lengths) - np.cumsum(np.bincount(lengths, minlength=steps + 1))[:steps]
    first = np.concatenate([[0], np.cumsum(width)])
    time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first[time] + np.repeat(rank, lengths), first, width


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the toxic state: posterior per token, forward and backward messages, and the layout.

    ``trans`` holds the scores of start, 0->1, 1->0 and 1->1; 0->0 is 0.
    """
    to, first, width = packed(lengths)
    e = np.empty(len(emit))
    e[to] = emit
    start, t01, t10, t11 = trans
    a, b = np.empty_like(e), np.zeros_like(e)
    steps = len(width)
    for t in range(steps):
        now = slice(first[t], first[t] + width[t])
        if t == 0:
            a[now] = e[now] + start
        else:
            prev = a[first[t - 1]:first[t - 1] + width[t]]
            a[now] = e[now] + np.logaddexp(prev + t11, t01) - np.logaddexp(prev + t10, 0.0)
    for t in range(steps - 2, -1, -1):
        nxt = slice(first[t + 1], first[t + 1] + width[t + 1])
        x = e[nxt] + b[nxt]
        b[first[t]:first[t] + width[t + 1]] = np.logaddexp(t11 + x, t10) - np.logaddexp(t01 + x, 0.0)
    return (a + b)[to], a[to], b[to], to


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Emissions(dict):
    """Word -> its emission score; words are scored once while they stay in the table."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        score = self[word] = sum([self.weights.get(f, 0.0) for f in features(word)])
        return score


# ---------------------------------------------------------------- training (driver, bounded sample)

def without_copies(docs: list[list[str]]) -> list[list[str]]:
    """One of each group of near copies, else every word of an often copied document seems to mark it.

    Documents that share one of four least hashes of their 3-word windows count as copies.
    """
    ids: dict[str, int] = {}
    seen: set[tuple[int, int]] = set()
    kept = []
    for words in docs:
        x = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.uint64, len(words))
        x = np.concatenate([x, np.zeros(max(0, 3 - len(x)), np.uint64)])
        h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
        sketch = set()
        for k in range(4):
            y = (h ^ (h >> np.uint64(29 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            sketch.add((k, int((y ^ (y >> np.uint64(32))).min())))
        if not sketch & seen:
            kept.append(words)
        seen |= sketch
    return kept


def marking_features(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    def shares(docs):
        seen: Counter = Counter()
        for words in docs:
            seen.update({f for w in set(words) for f in features(w) if f[0] != "$"})
        return seen
    t, c = shares(toxic), shares(clean)
    nt, nc = len(toxic), len(clean)
    return {f for f, n in t.items() if n >= MARK_DOCS and np.log((n + 0.5) / nt) - np.log((c[f] + 0.5) / nc) >= MARK_RATIO}


def fit(rows: list[tuple[str | None, int]], epochs: int = 40, rate: float = 0.5) -> dict | None:
    """Chain weights, transitions and calibration from (text, label) rows; None without both labels."""
    same: dict[str, str] = {}  # equal words are one object
    docs = [([same.setdefault(w, w) for w in words_of(t)], int(y)) for t, y in rows]
    toxic = without_copies([w for w, y in docs if y == 1 and w])
    clean = without_copies([w for w, y in docs if y == 0 and w])
    if not toxic or not clean:
        return None
    marks = marking_features(toxic, clean)
    marked: dict[str, bool] = {}

    def is_marked(word):
        if word not in marked:
            marked[word] = any(f in marks for f in features(word))
        return marked[word]

    # Sequences: the surroundings of marked tokens in toxic documents, and stretches of clean ones.
    runs: list[tuple[list[str], list[int]]] = []
    budget = TRAIN_TOKENS // 2
    for words in toxic:
        tags = [int(is_marked(w)) for w in words]
        at = [k for k, x in enumerate(tags) if x]
        k = 0
        while k < len(at) and budget > 0:
            lo = max(0, at[k] - 15)
            while k + 1 < len(at) and at[k + 1] - at[k] < 30:
                k += 1
            hi = at[k] + 16
            k += 1
            runs.append((words[lo:hi], tags[lo:hi]))
            budget -= hi - lo
    budget = TRAIN_TOKENS // 2
    share = max(20, budget // max(1, len(clean)))
    for words in clean:
        lo = (len(words) - share) // 2 if len(words) > share else 0
        runs.append((words[lo:lo + share], [0] * len(words[lo:lo + share])))

    lengths = np.array([len(w) for w, _ in runs], np.int64)
    flat = [w for ws, _ in runs for w in ws]
    gold = np.array([x for _, tags in runs for x in tags], float)
    vocabulary: dict[str, int] = {}
    word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in flat), np.int64, len(flat))
    index: dict[str, int] = {}
    parts = [[index.setdefault(f, len(index)) for f in features(w)] for w in vocabulary]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    feature = np.array([b for p in parts for b in p], np.int64)
    start = np.zeros(len(flat), bool)
    start[np.cumsum(lengths) - lengths] = True
    inner = ~start

    weights, trans = np.zeros(len(index)), np.array([-3.0, -3.0, 0.0, 0.0])
    grad_w, grad_t = np.full(len(index), 1e-8), np.full(4, 1e-8)
    for _ in range(epochs):
        score = np.bincount(owner, weights[feature], len(parts))[word]
        post, a, b, _ = forward_backward(score, lengths, trans)
        p = sigmoid(post)
        # Pair marginals of adjacent tokens, from the forward and backward messages.
        i = np.flatnonzero(inner)
        x = score[i] + b[i]
        q = [np.zeros(len(i)), trans[1] + x, trans[2] + a[i - 1], trans[3] + a[i - 1] + x]
        norm = np.logaddexp(np.logaddexp(q[0], q[1]), np.logaddexp(q[2], q[3]))
        pairs = [np.exp(v - norm).sum() for v in q[1:]]
        g0, g1 = gold[i - 1], gold[i]
        seen = [((1 - g0) * g1).sum(), (g0 * (1 - g1)).sum(), (g0 * g1).sum()]
        gt = np.array([(gold - p)[start].sum()] + [s - m for s, m in zip(seen, pairs)])
        by_word = np.bincount(word, gold - p, len(parts))
        gw = np.bincount(feature, by_word[owner], len(index)) - 0.02 * weights
        grad_w += gw ** 2
        grad_t += gt ** 2
        weights += rate * gw / np.sqrt(grad_w)
        trans += 0.2 * rate * gt / np.sqrt(grad_t)

    names = list(index)
    largest = np.argsort(-np.abs(weights), kind="stable")[:MODEL_FEATURES]
    model = {"weights": {names[k]: float(weights[k]) for k in largest}, "trans": trans, "scale": 1.0, "shift": 0.0}
    every = toxic + clean
    emissions = Emissions(model["weights"])
    tops = top_marginals([np.fromiter(map(emissions.__getitem__, w), float, len(w)) for w in every], trans)
    model["scale"], model["shift"] = calibrate(tops, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the largest log-odds, the labels weighing TOXIC_SHARE to the rest.

    The slope stays positive, and a document whose tokens are all clearly clean stays below 0.5.
    """
    weight = np.where(y == 1, TOXIC_SHARE / max(1, y.sum()), (1 - TOXIC_SHARE) / max(1, (1 - y).sum()))
    scale, shift = 0.5, 0.0
    for _ in range(400):
        r = weight * (y - sigmoid(scale * x + shift))
        scale = max(0.05, scale + 0.3 * float((r * x).sum()))
        shift = min(shift + float(r.sum()), -CLEARLY_CLEAN * scale)
    return scale, shift


def top_marginals(sequences: list[np.ndarray], trans: np.ndarray) -> np.ndarray:
    return marginals(sequences, trans)[0]


def marginals(sequences: list[np.ndarray], trans: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest log-odds of each sequence (LEAST if empty), and all of them."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    if not lengths.sum():
        return np.full(len(sequences), LEAST), [np.zeros(0)] * len(sequences)
    post = forward_backward(np.concatenate(sequences), lengths, trans)[0]
    each = np.split(post, np.cumsum(lengths)[:-1])
    return np.array([max(LEAST, p.max()) if len(p) else LEAST for p in each]), each


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled documents outside the held-out fold.

    Ids are chosen first, as narrow rows; only the chosen texts (at most SAMPLE_TOXIC +
    SAMPLE_CLEAN) come to the driver.
    """
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id"))))
    ids = docs.select("doc_id").distinct().join(known, "doc_id")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (ids.filter("label = 1").orderBy(*by_hash).limit(SAMPLE_TOXIC)
              .unionAll(ids.filter("label = 0").orderBy(*by_hash).limit(SAMPLE_CLEAN)))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
            .agg(F.min("text").alias("text"), F.max("label").alias("label")).collect())
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


# ---------------------------------------------------------------- scoring

def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def spans_of(text: str, odds: np.ndarray) -> list[dict]:
    """Offsets in code points of runs of tokens more likely toxic than not.

    Lower-casing can change a text's length, so offsets are those of the lower-cased words
    found again in the text itself, word by word.
    """
    found = list(_WORD.finditer(text))
    if len(found) != len(odds):  # lower-casing split or joined words: offsets in the lower-cased text
        found = list(_WORD.finditer(text.lower()))
    spans, on = [], False
    for m, x in zip(found, odds):
        if x >= 0:
            if on:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
        on = x >= 0
    return spans


def tag(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """``keep``, score, and the offsets of toxic spans of every text."""
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(
        "score double, n_toxic_tokens bigint, spans array<struct<start:int,end:int>>").fields)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_FEATURES weights
    types = [pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        m = shipped.value
        emissions = Emissions(m["weights"]) if m else None
        waiting: list[tuple[pa.RecordBatch, list, list]] = []

        def flush():
            sequences = [s for _, _, block in waiting for s in block]
            top, each = marginals(sequences, m["trans"]) if m else (np.full(len(sequences), LEAST), sequences)
            score = sigmoid(m["scale"] * top + m["shift"]) if m else np.zeros(len(sequences))
            done = 0
            for batch, texts, block in waiting:
                rows = range(done, done + len(block))
                done += len(block)
                spans = [spans_of(t, each[k]) if top[k] >= 0 else [] for k, t in zip(rows, texts)]
                cols = [score[rows.start:rows.stop], [int((each[k] >= 0).sum()) if top[k] >= 0 else 0 for k in rows], spans]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types)],
                                                 schema.names)

        tokens = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            block = []
            for t in texts:
                ws = words_of(t) if m else []
                block.append(np.fromiter(map(emissions.__getitem__, ws), np.float64, len(ws)) if ws else np.zeros(0))
            waiting.append((batch, texts, block))
            tokens += sum(map(len, block))
            if tokens >= BLOCK_TOKENS:
                yield from flush()
                waiting, tokens = [], 0
        if waiting:
            yield from flush()

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    return fit(training_rows(docs, labels))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and label of every document, with the offending offsets."""
    return tag(docs, train(docs, labels), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_toxic_tokens", "spans")
