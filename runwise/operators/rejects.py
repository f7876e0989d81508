"""Reject ledger: why each record doesn't get a cost, as a bit mask that one aggregation counts.

A record has the bits of all reasons of its step.  Steps are asked in the order of the flows, and a later one only of records
that passed those before, so the records without a stopping bit are exactly the costed ones.  Some bits are notes: a
malformed number, an unknown link or a category without a row in its table doesn't stop a record by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.constants import DECEL_CUT, MIN_ITEMS
from runwise.operators import costs as C
from runwise.operators import landings as L
from runwise.operators import paths as P
from runwise.operators.network import NetworkIndex, exit_edges, undirected
from runwise.session import materialise

TEXT_COLUMNS = ["callsign", "runway", "depAirport", "arrAirport", "aircraftType", "arrGate"]
# Order of the bits: the first reason is bit 0.
REASONS = ["other_airport", "null_text", "few_items", "no_den_link", "deceleration", "no_exit", "no_vertex", "start_is_goal",
           "adjacent", "no_path", "no_time", "malformed_number", "unknown_link", "unseen_category"]
NOTES = {"malformed_number", "unknown_link", "unseen_category"}
# Steps of the flows with the reasons that stop a record there.
STEPS = [("records", []), ("filters", ["other_airport", "null_text", "few_items", "no_den_link"]), ("deceleration", ["deceleration"]),
         ("exit_label", ["no_exit"]), ("adjacent_or_no_vertex", ["no_vertex", "start_is_goal", "adjacent"]), ("no_path", ["no_path"]),
         ("no_time", ["no_time"])]


def bits(names) -> int:
    return sum(1 << REASONS.index(name) for name in names)


def mask_of(reasons: dict[str, Column]) -> Column:
    """The bits of the reasons whose condition is true (NULL counts as false)."""
    one = [F.when(cond, F.lit(bits([name]))).otherwise(F.lit(0)) for name, cond in reasons.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), one)


def passes(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(bits(set(REASONS) - NOTES))) == 0


def record_reasons(code: str) -> dict[str, Column]:
    """P1, P3-P5 and malformed numbers, from the parsed record alone."""
    none = [F.col(c).isNull() for c in ("positions", "link_ids")] + [F.col(c).eqNullSafe("null") | F.col(c).isNull() for c in TEXT_COLUMNS]
    enough = (F.size("link_ids") > MIN_ITEMS) & (F.size("positions") > MIN_ITEMS)
    out = {"other_airport": F.coalesce(F.col("arrAirport") != code, F.lit(True)), "null_text": reduce(lambda a, b: a | b, none),
           "few_items": ~F.coalesce(enough, F.lit(False)),
           "malformed_number": F.exists("positions", lambda p: p["lat"].isNull() | p["long"].isNull() | p["epoch_ms"].isNull())}
    if "DEN" in code:
        out["no_den_link"] = ~F.coalesce(F.exists("link_ids", lambda x: F.coalesce(x.rlike(r"^10\d\d\d$"), F.lit(False))), F.lit(False))
    return out


def add(df: DataFrame, reasons: dict[str, Column], when: Column | None = None) -> DataFrame:
    more = mask_of(reasons)
    more = more if when is None else F.when(when, more).otherwise(F.lit(0))
    return df.withColumn("reject_mask", F.col("reject_mask").bitwiseOR(more))


def reject_ledger(typed: DataFrame, nodes: DataFrame, edges: DataFrame, code: str, exit_col: str = "predictedExit",
                  key: str = "flight_id", known: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, reject_mask): a row for each row of ``typed`` (parsed records with the predicted exit), repeated ones included.

    ``known`` names, for a text column, a table whose first column has its known values (the categories a model was fitted on,
    the types of a configuration); other and null values get the note ``unseen_category``.  The literal "null" as packed positions or
    links parses to one malformed item, so it shows as ``few_items`` and ``malformed_number``.  An empty table gives an empty ledger.
    """
    net = NetworkIndex(nodes, edges)
    d = add(typed.withColumn("reject_mask", F.lit(0)), record_reasons(code))
    for name, table in (known or {}).items():
        values = table.select(F.col(table.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("_known", F.lit(True))
        d = add(d.join(values, name, "left"), {"unseen_category": F.col("_known").isNull()}).drop("_known")
    d = L.label_exit(L.with_decel(d), exit_edges(edges))
    stops = {"deceleration": ~F.coalesce(F.col("decel") <= DECEL_CUT, F.lit(False)), "no_exit": F.col("exit").isNull()}
    d = add(d, stops, passes(F.col("reject_mask")))
    d = P.with_link_info(P.with_slow_position(d), net)
    d = add(d, {"unknown_link": F.exists("_links", lambda x: x.isNull())})
    d = d.withColumn("slowV", P.slow_vertex_expr()).withColumn("goalV", P.goal_vertex_expr())
    d = d.withColumn("avoidV", P.avoid_vertex_expr(F.col("slowV")))
    near = undirected(edges).select(F.col("a").alias("slowV"), F.col("b").alias("goalV")).distinct().withColumn("_near", F.lit(True))
    d = d.select(key, exit_col, "reject_mask", "slowV", "goalV", "avoidV").join(near, ["slowV", "goalV"], "left")
    none = F.col("slowV").isNull() | F.col("goalV").isNull()
    same = F.col("slowV") == F.col("goalV")
    d = add(d, {"no_vertex": none, "start_is_goal": same, "adjacent": F.col("_near") & ~same}, passes(F.col("reject_mask"))).drop("_near")
    d = materialise(d)  # narrow rows: read for the search of those that got here, and for the ledger of the others
    tried = P.with_paths(d.where(passes(F.col("reject_mask"))), nodes, edges, net, exit_col=exit_col, drop=False)
    tried = add(tried, {"no_path": ~F.col("has_paths")})
    times = [f(F.col(p)) for f in (C.rot_seconds, C.taxi_seconds) for p in ("optPath", "predPath")]
    tried = add(tried, {"no_time": F.col("has_paths") & reduce(lambda a, b: a | b, [t == -1 for t in times])})
    rest = d.where(~passes(F.col("reject_mask")))
    return rest.select(key, "reject_mask").unionByName(tried.select(key, "reject_mask"))


def by_mask(ledger: DataFrame) -> DataFrame:
    """(reject_mask, reasons, n_records): the one aggregation; no more rows than combinations of reasons that occur."""
    named = F.concat_ws(",", *[F.when(F.col("reject_mask").bitwiseAND(F.lit(bits([name]))) != 0, F.lit(name)) for name in REASONS])
    return ledger.groupBy("reject_mask").agg(F.count(F.lit(1)).alias("n_records")).select("reject_mask", named.alias("reasons"), "n_records")


def left_after(masks: DataFrame) -> DataFrame:
    """(step, name, n_left): the records left after each step, from ``by_mask``; steps of an empty ledger are not listed."""
    upto, rows = [], []
    for k, (name, reasons) in enumerate(STEPS):
        upto = upto + reasons
        rows.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.lit(bits(upto)).alias("stop")))
    each = masks.select("reject_mask", "n_records", F.explode(F.array(*rows)).alias("s")).select("reject_mask", "n_records", "s.*")
    left = F.when(F.col("reject_mask").bitwiseAND(F.col("stop")) == 0, F.col("n_records")).otherwise(F.lit(0))
    return each.groupBy("step", "name").agg(F.sum(left).alias("n_left"))
