"""Bench: headline flows at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from runwise.operators import model as M  # noqa: E402
from runwise.operators import paths as P  # noqa: E402
from runwise.operators import summary as S  # noqa: E402
from runwise.operators.network import NetworkIndex  # noqa: E402
from runwise.plans import catalog  # noqa: E402
from runwise.plans.optimise import optimise  # noqa: E402
from runwise.operators.landings import typed_filters  # noqa: E402
from runwise.plans.prepare import featurize, prepare_landings  # noqa: E402
from runwise.session import local_session, materialise  # noqa: E402
from runwise.sources import fixtures as fx  # noqa: E402


def sink(df):
    """Run the whole plan without collecting it."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="runwise-bench")
    sink(fx.table(spark, sf_dir, "nation"))  # JVM warm-up, not timed
    times: dict[str, float] = {}

    def timed(name, fn):
        spark.catalog.clearCache()  # every stage pays for its own work
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    nodes, edges = catalog.network(spark, sf_dir)
    landings = timed("landings_fixture", lambda: fx.flights(spark, sf_dir))
    timed("prepare_landings", lambda: sink(prepare_landings(landings, edges, catalog.CODE)))
    timed("traffic", lambda: sink(featurize(typed_filters(landings, catalog.CODE)).select("flight_id", "traffic")))
    prepared = prepare_landings(landings, edges, catalog.CODE, keep=["surrogate_exit"]) \
        .withColumnRenamed("surrogate_exit", "predictedExit")
    prepared = timed("prepare_checkpoint", lambda: materialise(prepared))
    net = timed("network_index", lambda: NetworkIndex(nodes, edges))
    timed("vertices", lambda: sink(P.drop_adjacent(materialise(P.with_vertices(prepared, net)), edges)))
    costed = timed("optimise", lambda: optimise(prepared, nodes, edges, fx.size_classes(spark, sf_dir), catalog.CODE,
                                                net=net).transform(materialise))
    timed("describe", lambda: sink(S.describe(costed)))
    timed("means", lambda: sink(S.summarise(costed)))

    def train():
        data = prepared.drop("predictedExit")
        train_df, test_df = M.split(data)
        model = M.fit_pipeline(data, train_df, ["runway", "depAirport", "aircraftType", "arrGate", "touchdownLat",
                                                    "touchdownLong", "hour", "day", "decel", "carrier", "traffic"], 40, 5)
        sink(M.predict(model, test_df))
        return model
    timed("train_predict", train)
    n = costed.count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_flow_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "landings_costed": n}))
    spark.stop()


if __name__ == "__main__":
    main()
