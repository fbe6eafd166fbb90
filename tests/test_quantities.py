import pytest
from pyspark.sql import functions as F

from relispan.functions import quantities as Q


@pytest.mark.parametrize(
    "text, want",
    [
        ("a load of 5 kN/m2 on it", [("5 kN/m2", "pressure", 5000.0)]),
        ("flow 3.2 m^3/s, then 1,200 rpm.", [("3.2 m^3/s", "flow", 3.2), ("1,200 rpm", "frequency", 20.0)]),
        ("12 V*A and 2 kW (9.81 m/s²)", [("12 V*A", "power", 12.0), ("2 kW", "power", 2000.0), ("9.81 m/s²", "acceleration", 9.81)]),
        ("1e3 kg m and 7 g/cm3", [("1e3 kg", "mass", 1000.0), ("7 g/cm3", "density", 7000.0)]),
        ("-40 degC, 30 psi, 50%", [("-40 degC", "temperature", -40.0), ("30 psi", "pressure", 206842.71879504), ("50%", "ratio", 0.5)]),
        ("3 N·m^-1*K", [("3 N·m^-1*K", None, 3.0)]),
        ("5 kNm x3m 5kgs model A4 v1.2s", []),
        ("", []),
    ],
)
def test_quantities(spark, text, want):
    docs = spark.createDataFrame([(text,), (None,)], "text string").select(F.explode(Q.mentions(F.col("text"))).alias("m"))
    got = docs.select("m", Q.quantity(F.col("m")).alias("q")).select("m", "q.dimension", "q.si").collect()
    assert [(r["m"], r["dimension"]) for r in got] == [w[:2] for w in want]
    assert [r["si"] for r in got] == pytest.approx([w[2] for w in want])
