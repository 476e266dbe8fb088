from corpusloom import report


def test_render(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("bbb", 2.0, 3)], "name string, x double, n int")
    assert report.render(df) == "name  x      n\na     1.500  -\nbbb   2.000  3"
    assert report.render(df.limit(0)) == "name  x  n"
    from corpusloom.plans import catalog

    assert all(n in catalog.queries() for names in report.STAGES.values() for n in names)
