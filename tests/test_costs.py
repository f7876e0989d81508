import pytest
from pyspark.sql import functions as F

from runwise.constants import CREW_RATE, ENV_RATE, FUEL_RATE, MAINT_RATE, OTHER_RATE, OWNERSHIP_RATE
from runwise.operators import costs as C

# FIXED VALUES: published mean times (s), costs and savings of three airports' summaries.
GOLDEN = {
    "KPHX": dict(optROT=2.6004, actualROT=3.6434, savings=0.289439),
    "KATL": dict(optROT=2.7259, actualROT=3.8121, savings=0.351679),
    "KBWI": dict(optROT=1.3540, actualROT=2.5343, savings=0.163762),
}


@pytest.mark.parametrize("code", sorted(GOLDEN))
def test_savings_identity(spark, code):
    g = GOLDEN[code]
    df = spark.createDataFrame([(g["optROT"], 1.0, g["actualROT"], 1.0, "Medium")],
                               "optROT double, optTT double, actualROT double, actualTT double, size_class string")
    r = C.with_costs(df, code).first()
    assert abs(r.savings - g["savings"]) < 2e-4


def test_cost_identities(spark):
    df = spark.createDataFrame([(2.0, 100.0, 3.0, 120.0, "Large"), (1.0, 10.0, 1.0, 10.0, "Unknown")],
                               "optROT double, optTT double, actualROT double, actualTT double, size_class string")
    rows = C.with_costs(df, "KXXX").collect()
    r = rows[0]
    for name, rate in [("Fuel", FUEL_RATE), ("Crew", CREW_RATE), ("Maint", MAINT_RATE), ("AO", OWNERSHIP_RATE),
                       ("Env", ENV_RATE), ("Other", OTHER_RATE)]:
        assert r[f"opt{name}Cost"] == pytest.approx(102.0 * rate)
        assert r[f"actual{name}Cost"] == pytest.approx(123.0 * rate)
    assert r.optPcost == pytest.approx(102.0 * 3.75)
    parts = [r[f"opt{n}"] for n in ("Pcost", "FuelCost", "CrewCost", "MaintCost", "AOCost", "EnvCost", "OtherCost")]
    assert r.totalOptCost == pytest.approx(sum(parts))
    assert r.savings == 0.0                       # unknown airport saves nothing
    assert rows[1].optPcost == 0.0                # unknown class: passenger rate 0


def test_rot_taxi(spark):
    df = spark.createDataFrame([([("a", 0, 100.0), ("b", 1, 50.0), ("c", 0, 200.0)],), ([("a", 0, 100.0)],),
                                ([("a", 1, 100.0)],)], "p array<struct<link_id:string,is_exit:int,length:double>>")
    rows = df.select(C.rot_seconds(F.col("p")).alias("rot"), C.taxi_seconds(F.col("p")).alias("tt")).collect()
    assert rows[0].rot == pytest.approx(150 * 0.3048 / 50) and rows[0].tt == pytest.approx(200 * 0.3048 / 11.83)
    assert rows[1].rot == -1.0 and rows[1].tt == pytest.approx(100 * 0.3048 / 11.83)
    assert rows[2].tt == -1.0
