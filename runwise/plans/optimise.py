"""F2 optimise: vertices -> paths -> times -> costs (-> summaries)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runwise.operators import costs as C
from runwise.operators import paths as P
from runwise.operators.network import NetworkIndex
from runwise.session import materialise


def optimise(predictions: DataFrame, nodes: DataFrame, edges: DataFrame, sizes: DataFrame, code: str = "KPHX",
             exit_col: str = "predictedExit", stop: str = "first_touch", net: NetworkIndex | None = None,
             store: str | None = None) -> DataFrame:
    """Scored landings (positions, link_ids, aircraftType, ``exit_col``) -> costed landings.

    G1 -> G2 -> P12/J8 -> G5/G6 -> E9/E10 (+P13) -> J11/E12-E14.  With ``store``, paths solved by earlier runs over the
    same network are read from that folder and only new ones are solved and added.
    """
    net = net or NetworkIndex(nodes, edges)
    # Vertex columns are written once (restart point; later filters and joins read them
    # instead of re-running the per-landing array expressions and the geodesic UDF).
    # The position / link arrays (the bulk of a landing row) are not needed past this point.
    v = P.with_vertices(predictions, net).drop("positions", "link_ids", "slow_lat", "slow_long")
    d = P.drop_adjacent(materialise(v), edges)
    # Paths are written before their times are taken: else the filter on valid times puts each path together again.
    d = materialise(P.with_paths(d, nodes, edges, net, exit_col=exit_col, stop=stop, store=store))
    d = C.with_times(d)
    d = C.with_size_class(d, sizes)
    return C.with_costs(d, code)
