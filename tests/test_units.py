from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weirflow.functions.pay import Pay, currency_of, period_of, read_pay
from weirflow.operators.units import ConversionGraph, convert


@pytest.mark.parametrize(
    ("text", "pay"),
    [
        ("$87,500 – $104,500 per annum", Pay(87500, 104500, "USD", "year")),
        ("£23K/yr", Pay(23000, 23000, "GBP", "year")),
        ("20,50 €/h", Pay(20.5, 20.5, "EUR", "hour")),
        ("max. 58 000 € par an", Pay(None, 58000, "EUR", "year")),
        ("from 1'020 CHF weekly", Pay(1020, None, "CHF", "week")),
        ("₹22–30 LPA", Pay(2200000, 3000000, "INR", "year")),
        ("84 - 93 lakhs per annum", Pay(8400000, 9300000, "INR", "year")),
        ("Vergütung: C$120.00 – C$128.00 par jour, plus bonus", Pay(120, 128, "CAD", "day")),
        ("3 360 € - 4 170 € / month", Pay(3360, 4170, "EUR", "month")),
        ("PLN 136.500 / year", Pay(136500, 136500, "PLN", "year")),
        ("$3,080–$4,200 per fortnight", Pay(3080, 4200, "USD", "fortnight")),
        ("$4,460 twice a month", Pay(4460, 4460, "USD", "half_month")),
    ],
)
def test_pay_texts(text, pay):
    assert read_pay(text) == pay


@pytest.mark.parametrize("text", [None, "", "Competitive", "£2,000 signing bonus", "Bonus up to 10%", "Band 6", "x" * 50_000])
def test_no_pay(text):
    p = read_pay(text)
    assert p.low is None and p.high is None or p.period is None


def test_names():
    assert currency_of("GBP pence") == ("GBP", 0.01) and currency_of("k€") == ("EUR", 1000.0) and currency_of("points")[0] is None and currency_of(None)[0] is None
    assert period_of("per-hour-wage") == "hour" and period_of("every two weeks") == "fortnight" and period_of("one-time") is None


def test_graph(spark):
    g = ConversionGraph()
    g.add("K", "C", 1, "-273.15")
    g.add("F", "C", Fraction(5, 9), Fraction(-160, 9))
    factors = g.factors(spark, "C")
    df = spark.createDataFrame([(300.15, "K", 1), (212.0, "F", 1), (1.0, "C", 1), (5.0, "X", 1), (None, "K", 1), (7.0, None, 1)], "v double, u string, target int")
    got = convert(df, F.col("v"), F.col("u"), "C", factors, "out")
    assert [(r.u, r.out and round(r.out, 6)) for r in got.orderBy("u", "v").collect()] == [(None, None), ("C", 1.0), ("F", 100.0), ("K", None), ("K", 27.0), ("X", None)]
    g.add("F", "K", Fraction(5, 9), Fraction(1))
    with pytest.raises(ValueError, match="cycle"):
        g.to_target("C")
    with pytest.raises(ValueError, match="loses"):
        g.add("a", "b", 0)
    with pytest.raises(ValueError, match="two different"):
        g.add("K", "C", 2)
