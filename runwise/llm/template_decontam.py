"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become token lists in which numbers, names and units are typed placeholders, written once as 64-bit codes.
Candidate places of an item in a document, alignments, come from three hash joins with these codes:

* windows of ``WINDOW`` template tokens, taken at every token; a window of mostly slots with the values in them;
* seeds: an item of n tokens that is found at ``FOUND`` percent has at most m = (100 - FOUND) % of n tokens wrong, so of
  m + 2 of its tokens at least two are right.  Its rarest m + 2 literals in the corpus are the seeds, and an
  alignment is a place where all but m of them agree.  An item with no more than m literals has all its tokens, with the
  values in its slots, as choice instead;
* for such items also their whole template, whatever is in the slots.

At each alignment the tokens are compared one by one, and the values in the slots must map one to one: a question whose
numbers or names were changed throughout is caught, while slots with inconsistent values only count where they are
equal.  What alignments count and when an item is found:

* an alignment from windows or whole templates counts, one from seeds if FOUND percent of the item's tokens agree there
  (for items of at most m literals: with their values);
* an item is found if the tokens that agree at its alignments together are FOUND percent of it; of items under
  ``LEAST_TOKENS`` tokens every token must agree.

So every item at FOUND percent of its tokens in one place is found, whatever its length and wherever the others are.  The name mark
of an item's first token depends on what precedes it in a document, so it agrees with and without; it is no seed.

Defined results: null and empty texts match nothing; very long texts are read whole; repeated rows of a document or an item give
one row for a pair of ids; rows with a null id are left out, as a pair needs both; ties (equal shares under one id)
go to the greater kind in the alphabet; empty tables give an empty table; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwise.llm.common import discard, written

WINDOW = 6
# Items under this many tokens must be found whole.
LEAST_TOKENS = 5
# Share of an item's tokens that must be found, in percent.
FOUND = 70

# Fixed list: units that make a slot after a number, longer ones before their beginnings.
UNITS = ("kilometers kilometres meters metres minutes minute seconds second dollars dollar percent months month weeks week "
         "years year hours hour miles euros euro cents days day feet inches litres liters grams kmh mph kwh khz mhz ghz usd eur gbp "
         "min sec lbs lb oz km cm mm mi ft kg mg ml cl hr hrs ms kb mb gb tb m g l s h").split()

# The steps of canonicalisation, as (pattern, replacement): the first before lower-casing.
NAMES = (r"([\p{Ll}\p{N},;:] )(\p{Lu})", r"\1@\2")
STEPS = [
    (r"(\p{N})[.,](\p{N})", r"\1_\2"),  # decimals stay one token
    (r"[^\p{L}\p{N}@_]+", " "),
    (r"(^| )(\p{N}[\p{N}_]*) ?(" + "|".join(UNITS) + r")( |$)", r"\1\2 ~\3\4"),
    (r"(^| )(\p{N})", r"\1#\2"),
]
# Typed placeholders: number, name, unit.
SLOTS = ("#", "@", "~")


def _replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to.replace("\\", "$"))


def raw_text(text: Column) -> Column:
    """Tokens separated by single spaces; slots begin with their type's sign."""
    t = F.lower(_replace(F.coalesce(text, F.lit("")), *NAMES))
    for step in STEPS:
        t = _replace(t, *step)
    return F.trim(t)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """key, row (tells rows that share a key apart), and the text."""
    return rows.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.xxhash64("text").alias("row"), "text")


def codes(raw: Column) -> Column:
    """Tokens as numbers: a hash of the token, with the type of its slot (0: a literal) in the last two bits."""
    def code(x: Column) -> Column:
        sign, kind = F.substring(x, 1, 1), F.lit(0)
        for k, s in enumerate(SLOTS):
            kind = F.when(sign == s, k + 1).otherwise(kind)
        return F.shiftleft(F.xxhash64(x), 2).bitwiseOR(kind.cast("long"))
    return F.transform(raw, code)


def windows(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep``, at and hash of the windows at every token of ``codes``: hashed as template if at least half of it are
    literals, else (a template that says little) with the values in its slots."""
    # Shifted copies side by side, so that all but the zip is done in generated code.
    parts = [F.slice("codes", k + 1, F.greatest(F.size("codes") - (size - 1), F.lit(0))).alias(f"c{k}") for k in range(size)]
    each = rows.select(*keep, F.posexplode(F.arrays_zip(*parts)).alias("at", "w"))
    kinds = [F.col(f"w.c{k}").bitwiseAND(F.lit(3)) for k in range(size)]
    form = [F.when(t == 0, F.col(f"w.c{k}")).otherwise(t) for k, t in enumerate(kinds)]
    literal = sum((F.when(t == 0, 1).otherwise(0) for t in kinds), F.lit(0))
    raw = F.xxhash64(F.lit("raw"), *[F.col(f"w.c{k}") for k in range(size)])
    return each.select(*keep, "at", F.when(2 * literal >= size, F.xxhash64(*form)).otherwise(raw).alias("hash"))


def whole(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """``keep``, at, hash of the templates of each size at every token of ``codes``, however many slots they have."""
    def of(size: int) -> Column:
        starts = F.when(F.size("form") >= size, F.sequence(F.lit(0), F.size("form") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(k.alias("at"), F.xxhash64(F.slice("form", k + 1, size)).alias("hash")))

    form = rows.select(*keep, F.transform("codes", _form).alias("form"))
    return form.select(*keep, F.explode(F.concat(*[of(n) for n in sizes])).alias("w")).select(*keep, "w.at", "w.hash")


def _form(code: Column) -> Column:
    """The code of the template token: a literal's own, a slot's type."""
    kind = code.bitwiseAND(F.lit(3))
    return F.when(kind == 0, code).otherwise(kind)


def may_differ(n: Column) -> Column:
    """Tokens of an item of n tokens that may be wrong."""
    return F.when(n < LEAST_TOKENS, 0).otherwise(F.floor((100 - FOUND) * n / 100)).cast("int")


def enough(count: Column, n: Column) -> Column:
    return F.when(n < LEAST_TOKENS, count == n).otherwise(100 * count >= FOUND * n)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_row, n, codes, named (the first token's code with a name mark), m, and sparse: has at most m literals
    after the first token."""
    items = keyed(benchmark, "item_id").withColumnRenamed("row", "item_row").distinct()
    items = items.withColumn("raw", tokens(raw_text(F.col("text")))).where("size(raw) > 0")
    items = items.select("item_id", "item_row", F.size("raw").alias("n"), codes(F.col("raw")).alias("codes"),
                         F.get(codes(F.array(F.concat(F.lit("@"), F.get("raw", 0)))), 0).alias("named"))
    literals = F.size(F.filter("codes", lambda c, k: (k > 0) & (c.bitwiseAND(F.lit(3)) == 0)))
    items = items.withColumn("m", may_differ(F.col("n")))
    return items.withColumn("sparse", literals <= F.col("m"))


def seeds(items: DataFrame, doc_codes: DataFrame) -> DataFrame:
    """code, item_id, item_row, item_at, need: the tokens that choose an item's alignments, and how many must agree.

    Of the tokens that may be chosen those that are rarest in the documents, counted for the benchmark's tokens only.
    """
    each = items.select("item_id", "item_row", "n", "m", "sparse", "named", F.posexplode("codes").alias("item_at", "code"))
    each = each.where((F.col("item_at") > 0) | (F.col("n") == 1)).where(F.col("sparse") | (F.col("code").bitwiseAND(F.lit(3)) == 0))
    each = written(each, "item-tokens")
    words = written(each.select("code").distinct(), "item-words")
    counts = written(doc_codes.select(F.explode("codes").alias("code")).join(words, "code", "left_semi").groupBy("code")
                     .agg(F.count("*").alias("n_docs")), "word-counts")
    per_item = Window.partitionBy("item_id", "item_row")
    ranked = each.join(counts, "code", "left").withColumn(
        "rank", F.row_number().over(per_item.orderBy(F.coalesce("n_docs", F.lit(0)), "item_at"))).where(F.col("rank") <= F.col("m") + 2)
    ranked = ranked.withColumn("need", F.greatest(F.lit(1), F.count("*").over(per_item) - F.col("m")))
    alone = ranked.where("n = 1").select("named", "item_id", "item_row", "item_at", "need").withColumnRenamed("named", "code")
    out = written(ranked.select("code", "item_id", "item_row", "item_at", "need").unionByName(alone), "seeds")
    discard(each, words, counts)
    return out


def alignments(items: DataFrame, doc_codes: DataFrame) -> DataFrame:
    """doc_id, row, item_id, item_row, shift, by_seeds: the candidate places of items in documents."""
    pair, doc = ["item_id", "item_row"], ["doc_id", "row"]
    keys = windows(items.where(F.col("n") >= WINDOW), pair, WINDOW).select(*pair, F.col("at").alias("item_at"), "hash")
    at_windows = windows(doc_codes, doc, WINDOW).join(written(keys, "windows"), "hash") \
        .select(*doc, *pair, (F.col("at") - F.col("item_at")).alias("shift"), F.lit(False).alias("by_seeds"))
    tokens_ = doc_codes.select(*doc, F.posexplode("codes").alias("at", "code"))
    at_seeds = tokens_.join(seeds(items, doc_codes), "code").groupBy(*doc, *pair, (F.col("at") - F.col("item_at")).alias("shift")) \
        .agg(F.count("*").alias("agree"), F.first("need").alias("need")).where("agree >= need") \
        .select(*doc, *pair, "shift", F.lit(True).alias("by_seeds"))
    found = at_windows.unionByName(at_seeds)
    templated = items.where(F.col("sparse") & (F.col("n") >= LEAST_TOKENS))
    sizes = sorted(r[0] for r in templated.select("n").distinct().collect())  # lengths, not items
    if sizes:
        form = F.transform("codes", _form)
        keys = written(templated.select(*pair, F.xxhash64(form).alias("hash")), "templates")
        at_whole = whole(doc_codes, doc, sizes).join(keys, "hash").select(*doc, *pair, F.col("at").alias("shift"), F.lit(False).alias("by_seeds"))
        found = found.unionByName(at_whole)
    return written(found.groupBy(*doc, *pair, "shift").agg(F.min("by_seeds").alias("by_seeds")), "alignments")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens, n_found and kind of each item found in a document."""
    items = written(benchmark_items(benchmark), "items")
    doc_codes = keyed(docs, "doc_id").select("doc_id", "row", codes(tokens(raw_text(F.col("text")))).alias("codes"))
    doc_codes = written(doc_codes, "document-codes")
    found = alignments(items, doc_codes)

    chosen = doc_codes.withColumnRenamed("codes", "doc").join(found, ["doc_id", "row"])
    pairs = chosen.join(items, ["item_id", "item_row"])
    value = lambda c, k: F.get(F.col(c), k)
    place = lambda k: k + F.col("shift")
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.col("n"), F.size("doc") - F.col("shift"))
    first = lambda k: (k == 0) & (value("doc", place(k)) == F.col("named"))
    equal = lambda k: (value("codes", k) == value("doc", place(k))) | first(k)
    pairs = pairs.withColumn("same", F.filter(F.sequence(low, high - 1), lambda k: (_form(value("codes", k)) == _form(value("doc", place(k)))) | first(k)))
    pairs = pairs.withColumn("with_values", F.filter("same", equal))
    pairs = pairs.where(~F.col("by_seeds") | enough(F.size(F.when(F.col("sparse"), F.col("with_values")).otherwise(F.col("same"))), F.col("n")))
    slots = F.filter("same", lambda k: value("codes", k).bitwiseAND(F.lit(3)) != 0)
    mapped = F.transform(slots, lambda k: F.struct(value("codes", k).alias("of"), value("doc", place(k)).alias("to")))
    pairs = pairs.withColumn("mapped", F.array_distinct(mapped))
    consistent = ((F.size("mapped") == F.size(F.array_distinct(F.transform("mapped", lambda x: x["of"]))))
                  & (F.size("mapped") == F.size(F.array_distinct(F.transform("mapped", lambda x: x["to"])))))
    changed = F.exists("mapped", lambda x: x["of"] != x["to"])
    pairs = pairs.select("doc_id", "row", "item_id", "item_row", F.col("n").alias("n_tokens"),
                         F.when(consistent, F.col("same")).otherwise(F.col("with_values")).alias("kept"), (consistent & changed).alias("changed"))
    # An item can be found in pieces, at several shifts: its tokens count once.
    by_item = pairs.groupBy("doc_id", "row", "item_id", "item_row", "n_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("kept")))).alias("n_found"), F.max("changed").alias("changed"))
    by_item = by_item.filter(enough(F.col("n_found"), F.col("n_tokens")))
    kind = F.when(F.col("changed"), "reparameterised").when(F.col("n_found") == F.col("n_tokens"), "whole").otherwise("partial")
    best = by_item.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.col("n_found").cast("long").alias("n_found"), F.col("n_tokens").cast("long").alias("n_tokens"), kind.alias("kind"))).alias("best"))
    out = written(best.select("doc_id", "item_id", "best.n_tokens", "best.n_found", "best.kind"), "leaks")
    discard(doc_codes, items, found)
    return out
