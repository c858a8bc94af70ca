from pyspark.sql import functions as F

from coursemetrics.functions import risk_label, risk_tier_cut, skill_band, stable_round, suggested_intervention


def test_stable_round_ties(spark):
    r = spark.range(1).select(stable_round(F.lit(0.285), 2).alias("a"), stable_round(F.lit(2.25), 1).alias("b"),
                              stable_round(F.lit(None).cast("double"), 1).alias("c")).first()
    assert r["a"] == 0.29 and r["b"] == 2.3 and r["c"] is None


def test_datediff_counts_calendar_boundaries(spark):
    # T1: 23:00 -> 01:00 next day is one boundary
    r = spark.sql("SELECT datediff(TIMESTAMP'2024-01-02 01:00:00', TIMESTAMP'2024-01-01 23:00:00') AS d").first()
    assert r["d"] == 1


def test_dayofweek_sunday_is_one(spark):
    assert spark.sql("SELECT dayofweek(DATE'2024-01-07') AS d").first()["d"] == 1


def test_risk_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.41,), (0.65,), (0.66,), (1.0,), (None,)], "r double")
    rows = df.select("r", risk_tier_cut("r").alias("cut"), risk_label("r", "—").alias("label")).collect()
    got = {r["r"]: (r["cut"], r["label"]) for r in rows}
    assert got[0.0] == (None, "Low")            # cut: exactly 0 is outside (0, .40]
    assert got[0.4] == ("Low", "Medium")        # T8: the two rules disagree at the edges
    assert got[0.41] == ("Medium", "Medium")
    assert got[0.65] == ("Medium", "High")
    assert got[0.66] == ("High", "High")
    assert got[1.0] == ("High", "High")
    assert got[None] == (None, "—")


def test_interventions(spark):
    df = spark.createDataFrame([(0.7, 15), (0.7, 14), (0.5, 8), (0.5, 7), (0.1, 30), (None, 30)], "r double, d int")
    out = [r["i"] for r in df.select(suggested_intervention("r", "d").alias("i")).collect()]
    assert out[0].startswith("Send re-engagement") and out[1].startswith("Proactive check-in")
    assert out[2].startswith("Automated reminder") and out[3].startswith("Peer study")
    assert out[4].startswith("On track") and out[5].startswith("On track")


def test_skill_band(spark):
    df = spark.createDataFrame([(2.4,), (2.5,), (3.49,), (3.5,)], "p double")
    assert [r["b"] for r in df.select(skill_band("p").alias("b")).collect()] == ["red", "yellow", "yellow", "green"]
