"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from ``SIDE`` tokens on either side of it; the sum of the log
probabilities scores a document.  The vocabulary is the 2 ** BUCKET_BITS hash buckets of words,
counted over the whole corpus, and the softmax is factored by classes: p(class | context) is the
network's, p(word | class) the word's share of the class in the corpus: its bucket's share of the class times the word's
exact share of its bucket.  Words are counted one by one, by 64 bits of hash; the KNOWN_WORDS most frequent ones have their share in every
task, all others get theirs by a join.  The most frequent words are
classes of their own, the others share classes of words about as frequent.  The network's softmax has two exact levels, groups of
classes and the classes of the target's group, so a token costs GROUPS + MEMBERS exponentials instead of their product.

Training is data-parallel.  In each round every shard of documents (by a hash of doc_id and text) is a task that runs gradient
descent in numpy over its windows (every token of every document, in every round), and Spark averages the
parameters of the shards, weighted by their windows.  Scores don't depend on how the rows are partitioned; rows equal in
doc_id and text share a shard.
What reaches the driver is the bucket counts, the known words and the parameters, all of fixed size, and how many words there are of
each count.

Defined results: null, empty and wordless texts have 0 tokens, log-probability 0 and a null
mean; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwise.llm.common import discard, map_batches, map_texts, written

SIDE = 2
GROUPS, MEMBERS = 16, 16
VOCABULARY = GROUPS * MEMBERS
SHARED_IDS = 64
BUCKET_BITS = 20
KNOWN_WORDS = 1 << 20  # the others' shares come by a join, so any number gives the same scores
WIDTH = 16
ROUNDS = 2
RATE = 2.0
BATCH = 8192
BLOCK = 8 * BATCH  # tokens that are turned into windows at once
SHARD_TOKENS = 2_000_000  # about as many tokens descend from one start; the number of shards grows with the corpus

EDGE = VOCABULARY  # the id beyond a document's ends, only ever read
N_PARAMS = 2 * SIDE * (VOCABULARY + 1) * WIDTH + WIDTH + GROUPS * WIDTH + GROUPS + VOCABULARY * WIDTH + VOCABULARY


class Buckets(dict):
    """Word -> hash bucket."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - BUCKET_BITS)
        return found


def buckets_of(text: str | None, table: dict) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


class Words(dict):
    """Word -> its place in ``hashes``: 64 bits of hash as a signed long, whose first BUCKET_BITS are the bucket.

    What a task looks up of a word it keeps by place, so it is looked up once and not for every token.
    """

    def __init__(self):
        self.hashes = []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        x = xxhash.xxh3_64_intdigest(word)
        self.hashes.append(x - (1 << 64) if x >> 63 else x)
        found = self[word] = len(self.hashes) - 1
        return found

    def new(self, known: int) -> np.ndarray:
        """Hashes from place ``known`` on."""
        return np.array(self.hashes[known:], np.int64)

    def clear(self) -> None:
        super().clear()
        self.hashes = []


WORDS_HELD = 300_000  # places are given anew after a block of texts that leaves more
BLOCK_TOKENS = 500_000


def blocks(texts: list[str | None], table: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of a block of texts, and where each text ends among them."""
    found, size = [], 0
    for k, t in enumerate(texts, 1):
        found.append(buckets_of(t, table))
        size += len(found[-1])
        if size >= BLOCK_TOKENS or k == len(texts):
            yield np.concatenate(found), np.cumsum([len(x) for x in found])
            found, size = [], 0


def bucket_in(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of all parts, each word once."""
    words, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(words)
    words = words[order]
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return words[starts], np.add.reduceat(n[order], starts) if len(words) else n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus, by its hash, and how often it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words, n):
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])
        table, parts, held = Words(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        counts = np.zeros(0, np.int64)  # by place
        for batch in batches:
            for places, _ in blocks(batch.column("text").to_pylist(), table):
                now = np.bincount(places, minlength=len(table))
                now[:len(counts)] += counts
                counts = now
                if len(table) <= WORDS_HELD:
                    continue
                parts.append((table.new(0), counts))
                held += len(counts)
                table.clear()
                counts = np.zeros(0, np.int64)
                if held > 2_000_000:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield rows(*parts[0])
                        parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield rows(*merged([*parts, (table.new(0), counts)]))
    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def by_bucket(words: DataFrame) -> DataFrame:
    return words.groupBy(F.shiftrightunsigned("word", 64 - BUCKET_BITS).alias("bucket")).agg(F.sum("n").alias("total"))


def counts_of(words: DataFrame) -> np.ndarray:
    """Words of the whole corpus by bucket."""
    rows = by_bucket(words).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["total"].to_numpy()
    return out


def bucket_counts(docs: DataFrame) -> np.ndarray:
    return counts_of(word_counts(docs))


def in_buckets(words: DataFrame, counts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """log p(word | bucket): of the most frequent words as sorted hashes and values, of all others as a table (word, own)."""
    much = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])  # a row per count
    fits = np.cumsum(much["words"].to_numpy()) <= KNOWN_WORDS
    cut = int(much["n"].to_numpy()[fits].min()) if fits.any() else 1 << 62
    top = words.where(F.col("n") >= cut).toArrow().sort_by("word")
    known = top["word"].to_numpy()
    values = np.log(top["n"].to_numpy() / counts[bucket_in(known)]) if len(known) else np.zeros(0)
    rest = words.where(F.col("n") < cut).withColumn("bucket", F.shiftrightunsigned("word", 64 - BUCKET_BITS)).join(by_bucket(words), "bucket")
    return (known, values), written(rest.select("word", F.log(F.col("n") / F.col("total")).alias("own")), "words")


def vocabulary(counts: np.ndarray) -> np.ndarray:
    """Bucket -> class: own classes for the most frequent buckets, then bands of frequency that hold as many words each."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    own = VOCABULARY - SHARED_IDS
    rest = counts[order[own:]]
    before = np.cumsum(rest) - rest
    ids = np.empty(len(counts), np.int32)
    ids[order[:own]] = np.arange(own)
    ids[order[own:]] = own + np.minimum(SHARED_IDS - 1, before * SHARED_IDS // max(1, rest.sum()))
    return ids


def shares(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bucket -> log p(word | class)."""
    n = np.maximum(counts, 1)  # every bucket that is ever scored was counted
    return (np.log(n) - np.log(np.bincount(ids, counts, VOCABULARY).clip(1))[ids]).astype(np.float32)


def parameters(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Start: small fixed weights; the biases are the log shares of groups in the corpus and of classes in their group."""
    flat = np.random.default_rng(7).normal(0, 0.1, N_PARAMS).astype(np.float32)
    share = (np.bincount(ids, counts + 0.01, VOCABULARY) + 1.0).reshape(GROUPS, MEMBERS)
    _, _, _, of_group, _, of_class = views(flat)
    of_group[:] = np.log(share.sum(axis=1) / share.sum())
    of_class[:] = np.log(share / share.sum(axis=1, keepdims=True)).ravel()
    return flat


def views(flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Embeddings by place, hidden bias, weights and bias of the groups and of the classes, as views of one array."""
    shapes = [(2 * SIDE, VOCABULARY + 1, WIDTH), (WIDTH,), (GROUPS, WIDTH), (GROUPS,), (VOCABULARY, WIDTH), (VOCABULARY,)]
    out, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(flat[at:at + n].reshape(shape))
        at += n
    return tuple(out)


def windows(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a block of documents: context ids, target id, index of the document."""
    padded = np.full(sum(len(d) + SIDE for d in documents) + SIDE, EDGE, np.int32)
    at, owner, place = SIDE, [], []
    for k, d in enumerate(documents):
        padded[at:at + len(d)] = d
        place.append(np.arange(at, at + len(d)))
        owner.append(np.full(len(d), k))
        at += len(d) + SIDE
    place = np.concatenate(place) if place else np.zeros(0, np.int64)
    steps = [k for k in range(-SIDE, SIDE + 1) if k]
    return np.stack([padded[place + k] for k in steps]), padded[place], np.concatenate(owner) if owner else np.zeros(0, np.int64)


def hidden(context: np.ndarray, embed: np.ndarray, bias: np.ndarray) -> np.ndarray:
    total = np.take(embed[0], context[0], axis=0)
    for k in range(1, len(context)):
        total += np.take(embed[k], context[k], axis=0)
    total += bias
    return np.tanh(total, out=total)


def by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their target's group, and where each group begins."""
    group = target // MEMBERS
    return np.argsort(group.astype(np.uint8), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


def log_probabilities(context: np.ndarray, target: np.ndarray, flat: np.ndarray) -> np.ndarray:
    embed, bias, groups, of_group, out, of_class = views(flat)
    found = np.empty(len(target), np.float32)

    def log_softmax(logits, chosen):  # a column per token: numpy reduces the first axis faster
        logits -= logits.max(axis=0)
        at = logits[chosen, np.arange(len(chosen))]
        np.exp(logits, out=logits)
        return at - np.log(logits.sum(axis=0))

    for lo in range(0, len(target), 4 * BATCH):
        part = slice(lo, lo + 4 * BATCH)
        order, starts = by_group(target[part])
        t = target[part][order]
        h = hidden(context[:, part], embed, bias)[order]
        value = log_softmax(groups @ h.T + of_group[:, None], t // MEMBERS)
        for g in range(GROUPS):
            rows, own = slice(starts[g], starts[g + 1]), slice(g * MEMBERS, (g + 1) * MEMBERS)
            if starts[g + 1] > starts[g]:
                value[rows] += log_softmax(out[own] @ h[rows].T + of_class[own, None], t[rows] % MEMBERS)
        found[part][order] = value
    return found


def descend(context: np.ndarray, target: np.ndarray, flat: np.ndarray, memory: np.ndarray) -> None:
    """One pass of gradient descent with a step per parameter, in place."""
    def errors(logits, chosen, n):
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        logits[chosen, np.arange(len(chosen))] -= 1.0
        logits /= n
        return logits

    width = np.arange(WIDTH)
    for lo in range(0, len(target), BATCH):
        part = slice(lo, lo + BATCH)
        embed, bias, groups, of_group, out, of_class = views(flat)
        order, starts = by_group(target[part])
        c, t = context[:, part][:, order], target[part][order]
        h = hidden(c, embed, bias)
        grad = np.zeros_like(flat)
        g_embed, g_bias, g_groups, g_of_group, g_out, g_of_class = views(grad)
        p = errors(groups @ h.T + of_group[:, None], t // MEMBERS, len(t))
        g_groups += p @ h
        g_of_group += p.sum(axis=1)
        back = p.T @ groups
        for g in range(GROUPS):
            rows, own = slice(starts[g], starts[g + 1]), slice(g * MEMBERS, (g + 1) * MEMBERS)
            if starts[g + 1] > starts[g]:
                p = errors(out[own] @ h[rows].T + of_class[own, None], t[rows] % MEMBERS, len(t))
                g_out[own] += p @ h[rows]
                g_of_class[own] += p.sum(axis=1)
                back[rows] += p.T @ out[own]
        back *= 1 - h * h
        g_bias += back.sum(axis=0)
        for k in range(len(c)):  # sums of the rows of each context id
            g_embed[k] += np.bincount((c[k][:, None] * WIDTH + width).ravel(), back.ravel(), g_embed[k].size).reshape(g_embed[k].shape)
        memory += grad * grad
        flat -= 0.1 * RATE * grad / (np.sqrt(memory) + 1e-6)


def encoded(docs: DataFrame, ids: np.ndarray, share: np.ndarray, keep: list[str], known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``keep`` and, of every document, a hash of doc_id and text, its class ids (a byte each), the sum of log p(word | class) as far as
    ``known`` has the words' shares of their buckets, and the words that it doesn't have."""
    nothing = (np.zeros(0, np.int64), np.zeros(0))
    shipped = docs.sparkSession.sparkContext.broadcast((ids.astype(np.uint8), share, *(known or nothing)))  # fixed size
    h = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])

    def make():
        (small, within, listed, own), table = shipped.value, Words()
        nothing_kept = (np.zeros(0, np.int64), small[:0], within[:0], np.zeros(0, bool), own[:0])
        kept = nothing_kept  # by place: hash, class, share of the bucket in the class, whether the word is known, its share of the bucket

        def looked_up(words):
            buckets, at = bucket_in(words), np.searchsorted(listed, words)
            hit = np.zeros(len(words), bool)
            share = np.zeros(len(words))
            if len(listed):
                hit = listed[np.minimum(at, len(listed) - 1)] == words
                share[hit] = own[at[hit]]
            return words, small[buckets], within[buckets], hit, share

        def apply(texts):
            nonlocal kept
            code, total, rest = [], [], []
            for places, ends in blocks(texts, table):
                if len(table) > len(kept[0]):
                    kept = tuple(np.concatenate(x) for x in zip(kept, looked_up(table.new(len(kept[0])))))
                words, classes, shares_, hits, owns = (x[places] for x in kept)
                lo = 0
                for hi in ends.tolist():
                    hit = hits[lo:hi]
                    whole = hit.all()
                    code.append(classes[lo:hi].tobytes())
                    total.append(float(shares_[lo:hi].sum(dtype=np.float64)) + float((owns[lo:hi] if whole else owns[lo:hi][hit]).sum()))
                    rest.append(None if not known else words[:0] if whole else words[lo:hi][~hit])
                    lo = hi
                if len(table) > WORDS_HELD:
                    table.clear()
                    kept = nothing_kept
            return code, total, rest
        return apply
    return map_texts(docs.withColumn("_h", h), make, "_code binary, _within double, _rest array<bigint>", [*keep, "_h"])


def train_round(docs: DataFrame, ids: np.ndarray, flat: np.ndarray, n_shards: int = 1) -> np.ndarray:
    """Parameters after every shard's pass from the same start, averaged by number of windows; ``docs`` are documents or ``encoded`` ones.

    A task has one shard, its documents in the order of their hashes, and descends in steps that batches of rows don't cut: so neither
    the partitions of ``docs`` nor the size of batches has an effect.
    """
    start = docs.sparkSession.sparkContext.broadcast(flat)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, memory, seen = start.value.copy(), np.full(N_PARAMS, 1e-6, np.float32), 0
        block, size = [], 0

        def learn():
            context, target, _ = windows(block)
            descend(context, target, mine, memory)
            block.clear()
            return len(target)
        for batch in batches:
            for code in batch.column("_code").to_pylist():
                block.append(np.frombuffer(code, np.uint8))
                size += len(code)
                if size >= BLOCK:
                    seen, size = seen + learn(), 0
        seen += learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_PARAMS), pa.int32()), pa.array(mine.astype(np.float64) * seen, pa.float64()),
                                              pa.array(np.full(N_PARAMS, seen), pa.int64())], ["k", "value", "n"])
    codes = docs if "_code" in docs.columns else encoded(docs, ids, np.zeros(len(ids), np.float32), [])
    dealt = codes.select("_h", "_code").repartitionById(n_shards, F.pmod("_h", F.lit(n_shards)).cast("int")).sortWithinPartitions("_h", "_code")
    rows = (dealt.select("_code").mapInArrow(run, "k int, value double, n bigint").groupBy("k")
            .agg((F.sum("value") / F.sum("n")).alias("value")).collect())
    out = flat.copy()
    for r in rows:
        out[r["k"]] = r["value"]
    return out


def learn(docs: DataFrame, keep: list[str]) -> tuple[dict, DataFrame]:
    """The model, and the table of encoded documents (a byte a token, written once) that every round read."""
    words = written(word_counts(docs), "counts")
    counts = counts_of(words)
    ids = vocabulary(counts)
    flat, share = parameters(counts, ids), shares(counts, ids)
    known, rest = in_buckets(words, counts)
    discard(words)
    codes = written(encoded(numbered(docs), ids, share, [*keep, "_row"], known), "codes")
    for _ in range(ROUNDS):
        flat = train_round(codes, ids, flat, max(1, round(int(counts.sum()) / SHARD_TOKENS)))
    return {"ids": ids, "flat": flat, "share": share, "known": known, "rest": rest}, codes


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with an id that stays once they are written."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def train(docs: DataFrame) -> dict:
    model, codes = learn(docs, [])
    discard(codes)
    return model


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, log_prob (sum over all tokens) and mean_log_prob of every text; a word that was never counted stands for its bucket."""
    return whole_score(written(encoded(numbered(docs), model["ids"], model["share"], [*keep, "_row"], model["known"]), "codes"), model, keep)


def whole_score(codes: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``score`` of written ``encoded`` documents: the shares of words that tasks don't hold come by a join."""
    part = score_codes(codes, model["flat"], [*keep, "_row"])
    more = codes.select("_row", F.explode("_rest").alias("word")).join(model["rest"], "word").groupBy("_row").agg(F.sum("own").alias("_more"))
    total = F.col("log_prob") + F.coalesce("_more", F.lit(0.0))
    return part.join(more, "_row", "left").select(*keep, "n_tokens", total.alias("log_prob"),
                                                  F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def score_codes(codes: DataFrame, flat: np.ndarray, keep: list[str]) -> DataFrame:
    """n_tokens, log_prob and mean_log_prob of ``encoded`` documents, by the shares that they were encoded with."""
    shipped = codes.sparkSession.sparkContext.broadcast(flat)  # fixed size

    def make():
        flat = shipped.value

        def apply(batch):
            docs = [np.frombuffer(c, np.uint8) for c in batch.column("_code").to_pylist()]
            total = np.array(batch.column("_within").to_pylist())
            lo = 0
            while lo < len(docs):  # blocks of documents with about 500,000 tokens
                block, size = [], 0
                while lo + len(block) < len(docs) and size < 500_000:
                    block.append(docs[lo + len(block)])
                    size += len(block[-1])
                context, target, owner = windows(block)
                total[lo:lo + len(block)] += np.bincount(owner, log_probabilities(context, target, flat), len(block))
                lo += len(block)
            n = [len(d) for d in docs]
            return n, total.tolist(), [x / k if k else None for x, k in zip(total.tolist(), n)]
        return apply
    return map_batches(codes, make, "n_tokens bigint, log_prob double, mean_log_prob double", keep, ["_code", "_within"])


def report(docs: DataFrame) -> DataFrame:
    model, codes = learn(docs, ["doc_id"])
    return whole_score(codes, model, ["doc_id"])
