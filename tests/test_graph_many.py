import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text as T
from kairograph.operators import graph


def test_dates_meet_the_intervals_that_hold(spark):
    draw = random.Random(6)
    start = dt.datetime(2020, 1, 1)
    moment = lambda: start + dt.timedelta(seconds=draw.randrange(400 * 86400), microseconds=draw.choice([0, 1]))
    facts = []
    for i in range(300):
        a = moment() if i % 7 else None
        b = (a or start) + dt.timedelta(seconds=draw.choice([0, 1, 3600, 86400, 30 * 86400, 4000 * 86400])) if i % 5 else None
        facts.append((i, a, b))
    dates = [moment() for _ in range(60)] + [f[1] for f in facts if f[1]][:20] + [f[2] for f in facts if f[2]][:20] + [start.replace(year=1969), start.replace(hour=0)]
    dates = sorted(set(dates))
    df = spark.createDataFrame(facts, "id int, valid_at timestamp, expired_at timestamp")
    asked = spark.createDataFrame([(d,) for d in dates] + [(None,)], "as_of timestamp")
    joined = graph.as_of_many(df, asked)
    got = sorted((r["as_of"], r["id"]) for r in joined.collect())
    want = sorted((d, i) for d in dates for i, a, b in facts if (a is None or a <= d) and (b is None or b > d))
    assert got == want and len(got) > 1000
    assert joined.columns == ["as_of", "id", "valid_at", "expired_at"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert graph.as_of_many(df.where("false"), asked).count() == 0 and graph.as_of_many(df, asked.where("false")).count() == 0
    alone = spark.createDataFrame([(dates[40],)], "as_of timestamp")
    assert graph.as_of_many(df, alone).count() == graph.as_of(df.fillna({}), dates[40]).count() + df.where(F.col("valid_at").isNull() & (F.col("expired_at").isNull() | (F.col("expired_at") > F.lit(dates[40])))).count()


def test_options(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.comma_list(F.lit(" a,, b c ,"))) == ["a", "b c"] and one(T.comma_list(F.lit(None).cast("string"))) == []
    assert str(one(T.as_of_date(F.lit("2023-12-01")))) == "2023-12-01 00:00:00" and one(T.as_of_date(F.lit(" "))) is None and one(T.as_of_date(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="not an ISO date: demain"):
        one(T.as_of_date(F.lit("demain")))
    assert one(T.sheet_name(F.lit("x" * 40))) == "x" * 31 and one(T.sheet_name(F.lit(None).cast("string"))) == "Feuille1"
    assert one(T.table_row(F.array(F.lit("a|b"), F.lit(None).cast("string")))) == "| a\\|b |  |"
