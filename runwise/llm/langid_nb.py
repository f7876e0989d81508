"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams by language are taken by Spark over a bounded sample of labelled
documents (``PER_LANG`` documents of a language on average, chosen by a hash of the id).
The log-probability matrix (buckets x languages) is broadcast, and texts are scored in
batches by gathering the rows of their n-grams.

Defined results: ``und`` with score 0 where a text is null or has no letter, or nothing was
learned; ties go to the alphabetically first language; repeated rows each get a row; a
row whose doc_id is null is not held out and is not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.llm.common import map_texts

ORDERS = (1, 2, 3)
BITS = 16
PER_LANG = 3000
SMOOTH = 0.5
FOLDS, FOLD = 4, 2
# Evidence of so many n-grams at most enters the score, else it is 1 for every longer text.
SCORE_GRAMS = 60.0
BLOCK_CELLS = 8_000_000

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # fixed odd values


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts, and the index of the text of each."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    chars = np.concatenate(raw).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    code, found, of = np.zeros(len(chars), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        ends = len(chars) - n + 1
        if ends <= 0:
            break
        code = code[:ends] * np.uint64(0x110000) + chars[n - 1:]
        if n in ORDERS:
            whole = owner[:ends] == owner[n - 1:]
            found.append(((code * np.uint64(_MULTIPLIERS[n - 1])) >> np.uint64(64 - BITS)).astype(np.int64)[whole])
            of.append(owner[:ends][whole])
    return np.concatenate(found), np.concatenate(of)


def blocks(texts: list[str], cells_per_char: int) -> Iterator[tuple[int, int]]:
    """Runs of texts whose n-grams fit in BLOCK_CELLS matrix cells (or a single text)."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t) * cells_per_char
        if size > BLOCK_CELLS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the learning sample, counted by the tasks and summed by Spark."""
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~held_out(F.col("doc_id")))
    share = pool.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(PER_LANG)) / F.count("*")).alias("share"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = pool.join(F.broadcast(share), "lang").filter(unit < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts) if x == lang and t]
                acc = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for lo, hi in blocks(mine, len(ORDERS)):
                    acc += np.bincount(grams(mine[lo:hi])[0], minlength=1 << BITS)
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                              pa.array(acc[at], pa.int64())], ["lang", "bucket", "n"])

    return (sample.mapInArrow(run, "lang string, bucket bigint, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(docs: DataFrame) -> dict | None:
    """Log-probabilities, buckets x languages: at most 2^BITS rows of each language reach the driver."""
    rows = counts(docs).toPandas()
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    table = np.full((1 << BITS, len(langs)), SMOOTH)
    np.add.at(table, (rows["bucket"].to_numpy(), rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()), rows["n"].to_numpy())
    return {"langs": langs, "logp": np.log(table / table.sum(axis=0)).astype(np.float32)}


def predict(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x languages floats

    def make():
        m = shipped.value

        def apply(texts):
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [k for k, t in enumerate(texts) if m and t and _LETTER.search(t)]
            mine = [texts[k] for k in at]
            for lo, hi in blocks(mine, len(ORDERS) * len(m["langs"]) if m else 1):
                bucket, of = grams(mine[lo:hi])
                sums = np.empty((hi - lo, len(m["langs"])))
                for j in range(len(m["langs"])):
                    sums[:, j] = np.bincount(of, m["logp"][bucket, j], hi - lo)
                n = np.bincount(of, minlength=hi - lo)
                best = sums.argmax(axis=1)
                tempered = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1.0, SCORE_GRAMS / n)[:, None]
                share = 1.0 / np.exp(tempered).sum(axis=1)
                for k in range(hi - lo):
                    lang[at[lo + k]], score[at[lo + k]] = m["langs"][best[k]], float(share[k])
            return lang, score
        return apply
    return map_texts(docs, make, "lang_pred string, score double", keep)


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
