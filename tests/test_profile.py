"""Profiles of parts, merged, against the reports over the whole table."""

import datetime
import random

from tidemark.operators import quality

START = datetime.date(2020, 1, 1)


def test_merged_profiles_equal_the_reports(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *[START + datetime.timedelta(days=rng.randrange(90))] * 9]), rng.choice([None, 1.0])) for _ in range(600)]
    df = spark.createDataFrame(rows, "stock_id string, date date, v double")
    parts = [df.filter("date is null or date < '2020-02-01'"), df.filter("date between '2020-02-01' and '2020-02-20'"), df.filter("date > '2020-02-20'").limit(0), df.filter("date > '2020-02-20'")]
    # rows without a day come in two parts
    late = df.filter("date is null").limit(7)
    parts[0] = parts[0].exceptAll(late)
    parts[3] = parts[3].union(late)
    whole = quality.profile(parts[0]).written()
    for p in parts[1:]:
        whole = whole.merge(quality.profile(p)).written()
    every = parts[0].union(parts[1]).union(parts[3])
    assert whole.overview().first().asDict() == quality.table_overview(every).first().asDict()
    assert sorted(map(str, whole.coverage(show=None).collect())) == sorted(map(str, quality.coverage_report(every, show=None).collect()))
    assert whole.gaps(9).collect() == quality.calendar_gaps(every, 9).collect()


def test_profile_of_nothing(spark):
    none = spark.createDataFrame([], "stock_id string, date date, v double")
    p = quality.profile(none)
    assert p.overview().first().asDict() == quality.table_overview(none).first().asDict()
    assert p.coverage().count() == p.gaps().count() == 0
