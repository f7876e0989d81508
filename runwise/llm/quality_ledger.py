"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one
failure bit per rule; policies are versioned bit masks applied to the stored bits, so a
new policy or an ablation never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows
each keep their own ledger row; null ids pass through; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.llm.common import map_texts, written

# Fixed values of the contract: white space that separates words, and symbol characters.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "n_lines bigint, n_upper bigint, n_lower bigint, n_marks bigint")

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))


def repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more in the text."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] >= 2
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly the six white-space characters of SPACES
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines),
            len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER)),
            text.count("!"))


# Rules in bit order: name -> condition under which a document fails.  Integer arithmetic
# only, so that every engine agrees on each bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_upper > n_upper + n_lower",
    "exclamations": "100 * n_marks > 20 * n_words",
    "some_repeats": "100 * n_repeat_words > 30 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


# Versioned policies: a document is kept when none of the policy's bits is set.
BASE = mask("few_words", "repeated_windows")
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | mask("symbols", "duplicate_lines", "short_words", "long_words", "capitals", "exclamations"),
    "strict": mask(*RULES),
}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: one bit per rule, each evaluated once."""
    measured = map_texts(docs, lambda: lambda texts: list(zip(*map(measure, texts))) or [[]] * 9, MEASURES, ["doc_id"])
    bits = None
    for name, fails in RULES.items():
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("failed", bits)


def fails(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` under a policy version."""
    return entries.withColumn("kept", ~fails(policy))


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, and kept in addition without it.

    The ledger is first counted by failure bits (at most 2^rules groups, combined on the
    map side); the rules then read only those counts.
    """
    m = POLICIES[policy]
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit"))
                                for n, b in BIT.items() if b & m]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return (counts.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_saved_without")))


def report(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The contract's columns, the ledger bits, and for documents that fail one rule of the policy only: that rule, and how
    many documents the policy without it keeps in addition.

    The ledger is written once; the policy and the ablation read its bits, never a text.
    """
    entries = written(ledger(docs), "ledger")
    m = POLICIES[policy]
    bits = F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    sole = None
    for name, bit in BIT.items():
        if bit & m:
            sole = F.when(bits == bit, name) if sole is None else sole.when(bits == bit, name)
    saved = ablation(entries, policy).select(F.col("rule").alias("sole_rule"), F.col("n_saved_without").alias("saved_without"))
    return apply_policy(entries, policy).withColumn("sole_rule", sole).join(F.broadcast(saved), "sole_rule", "left").select(  # a row per rule
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"), "kept", "failed", "sole_rule", "saved_without")
