"""F1 prepare_landings: filters -> features -> traffic -> exit label -> feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runwise.constants import ALL_FEATURES
from runwise.operators import landings as L
from runwise.operators.network import exit_edges
from runwise.session import materialise


def featurize(typed: DataFrame) -> DataFrame:
    """E5, E6, E8 (+P9), E3, E7, A1 in the analysed application's order; traffic counts the
    landings left after the deceleration filter, before labelling."""
    df = L.with_touchdown(typed)
    df = L.with_hour_day(df)
    df = L.decel_filter(L.with_decel(df))
    df = L.with_carrier(df)
    df = L.with_landing_epoch(df)
    return L.with_traffic(df)


def prepare_landings(typed: DataFrame, edges: DataFrame, code: str = "KPHX",
                     features: list[str] | None = None, keep: list[str] | None = None,
                     typed_filters: bool = True) -> DataFrame:
    """Typed landings -> labelled feature rows.

    ``typed`` holds parsed landings (see ``landings.parse_flights``); when it
    comes from ``filter_flights`` already, pass ``typed_filters=False``.
    """
    df = L.typed_filters(typed, code) if typed_filters else typed
    df = featurize(df)
    df = L.labelled_only(L.label_exit(df, exit_edges(edges)))
    feats = list(features) if features is not None else list(ALL_FEATURES)
    return L.select_features(df, feats, keep=["flight_id", *(keep or [])])


def prepare_from_text(raw: DataFrame, edges: DataFrame, code: str = "KPHX",
                      features: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Packed-text landings -> P1-P5 -> parse -> ``prepare_landings``.

    The parsed landings are written once: else the optimiser puts the whole parse in place of each use of a position
    or link, and the plan takes minutes while every landing is parsed many times over.
    """
    typed = materialise(L.parse_flights(L.filter_flights(raw, code)))
    return prepare_landings(typed, edges, code, features, keep, typed_filters=False)
