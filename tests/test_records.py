"""Records that arrive as JSON, with members that are missing, null, of another kind, or cut."""

from pyspark.sql import functions as F

from marginalia.operators import records as R


def test_entities(spark):
    replies = [
        (1, '{"entities": {"Q1": {"labels": {"en": {"value": "One"}}, "aliases": {"en": [{"value": "I"}, {}, null, 3]}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {}]}, "sitelinks": {"a": {}, "b": 1}}, "Q2": {"missing": ""}, "Q3": 7, "Q4": {}}}'),
        (2, '{"entities": []}'), (3, "{}"), (4, '{"entities": {"Q9": {}}} tail'), (5, None), (6, '{"entities": {"Q6": {"aliases": [], "claims": {"P31": {}}, "sitelinks": [1, 2]}}}'),
    ]
    got = sorted(map(tuple, R.entities(spark.createDataFrame(replies, "id long, reply string")).collect()))
    assert got == [(1, "Q1", "One", "", ["I"], ["Q5"], 2), (1, "Q4", "", "", [], [], 0), (6, "Q6", "", "", [], [], 0)]


def test_places(spark):
    rows = [(1, '{"location": "A", "latitude": 0, "longitude": 4}', 0.0, None), (2, '{"location": null}', 1.0, 2.0), (3, '{"location": "A"', None, 5.0), (4, "B {}", None, None), (5, None, None, None), (6, '{"latitude": "x"} {}', 1.0, None)]
    df = spark.createDataFrame(rows, "id long, location string, latitude double, longitude double")
    assert sorted(map(tuple, R.placed(df).select("id", "location", "latitude", "longitude", "fixed").collect())) == [
        (1, "A", 0.0, 4.0, True), (2, None, 1.0, 2.0, True), (3, '{"location": "A"', None, 5.0, False), (4, "B {}", None, None, None), (5, None, None, None, None),
        (6, '{"latitude": "x"} {}', 1.0, None, False),
    ]


def test_linked_nodes(spark):
    script = '<script type="application/ld+json">{}</script>'
    pages = [(1, script.format('{"@graph": [{"@type": "Place", "geo": {"latitude": 1, "longitude": "2"}}, {"name": "x"}, [], null, {"address": ""}]}')), (2, script.format("[]") + script.format("{") + script.format('{"location": false}')), (3, None), (4, "no script")]
    got = sorted(map(tuple, R.linked_nodes(spark.createDataFrame(pages, "page_id long, html string")).collect()))
    assert got == [(1, "0.0.0", "Place", None, None, 1.0, 2.0), (1, "0.0.4", None, None, "", None, None), (2, "1.0.0", None, None, None, None, None)]


def test_backfill_leaves_what_is_there(spark):
    df = spark.createDataFrame([(1, "mine", '{"a": "theirs", "n": 5}'), (2, None, '{"a": "theirs", "n": "x"}'), (3, None, "broken"), (4, None, None)], "id long, a string, metadata string")
    got = R.backfilled(df, "metadata", {"a": ("$.a", "string"), "n": ("$.n", "long")}).select("id", "a", "n")
    assert sorted(map(tuple, got.collect())) == [(1, "mine", 5), (2, "theirs", None), (3, None, None), (4, None, None)]
    assert R.backfilled(df.limit(0).withColumn("x", F.lit(1)), "metadata", {"a": ("$.a", "string")}).count() == 0
