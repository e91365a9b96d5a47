"""Response states, language cues, places and pay on single rows."""

from pyspark.sql import functions as F

from sievemill.functions import signals


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_fetch_state(spark):
    c = F.col
    state = signals.fetch_state(c("s"), c("b"), c("e"), c("n"), c("p"), c("i"))
    row = {"s": 200, "b": "fine", "e": 0, "n": 5, "p": 5, "i": 0}
    cases = [({}, "ok"), ({"s": 429}, "rate_limited"), ({"s": 429, "e": 2}, "partial"), ({"s": 401}, "blocked"), ({"s": 500}, "failed"), ({"b": "A CAPTCHA"}, "blocked"), ({"b": None}, "ok"), ({"n": 0, "p": 0}, "empty"), ({"i": 1}, "partial"), ({"p": 0}, "partial")]
    for change, want in cases:
        assert one(spark, state, **(row | change)) == want, change


def test_challenge_reads_the_head_only(spark):
    flag = signals.challenge_flag(F.col("b"), F.col("s"))
    assert one(spark, flag, b="Just a Moment", s=200) is True
    assert one(spark, flag, b="x" * 100_000 + "captcha", s=200) is False
    assert one(spark, flag, b=None, s=403) is True


def test_places_and_language(spark):
    t = F.col("t")
    assert one(spark, signals.location_from_path(t, "none"), t="https://a.b/san-jose/x?q=1") == "San Jose"
    assert one(spark, signals.location_from_path(t, "none"), t="https://a.b/") == "none"
    assert one(spark, signals.location_from_parts("none", t, F.lit(" "), F.lit("ES")), t=None) == "ES"
    assert one(spark, signals.location_from_title(t, ["Madrid"], "none"), t="Dev (full remote)") == "100% Remoto"
    assert one(spark, signals.language_cues(t), t="Requirements and skills of the team") == "en"
    assert one(spark, signals.language_cues(t), t=None) == "es"


def test_pay_and_lists(spark):
    pay = lambda text, level: tuple(one(spark, signals.estimate_salary(F.col("t"), F.lit(level), F.lit("Remoto"), F.lit(True), F.lit(4)), t=text))
    assert pay("Django", "Mid") == (30, 38)
    assert pay("Django", "Beca") == (12, 18)
    assert pay(None, None) == (29, 37)
    assert [one(spark, signals.json_list(F.col("t")), t=v) for v in ('["a", "b"]', "", "{", None)] == [["a", "b"], [], [], []]
