"""Lists of scopes in every format."""

from litmill.sources import export


def test_orders_and_formats(spark):
    works = spark.createDataFrame([(1, "b", 2000), (2, "a", 2000), (3, "c", 1990), (4, None, None), (5, "e", None)], "id long, title string, year int")
    works = works.selectExpr("*", "'v' as venue", "cast(null as string) as doi", "concat('k', id) as cite_key", "array('Ann B') as authors", "'text' as abstract")
    links = spark.createDataFrame([(1, 9, None), (2, 9, 3), (3, 9, 5), (5, 9, 3), (1, 8, 1)], "work_id long, shelf_id long, position int")
    shelves = spark.createDataFrame([(9, 1), (8, 1)], "shelf_id long, rack_id long")

    def order(*args):
        rows = export.exported(works, "text", *args, links, shelves).orderBy("place").collect()
        assert [r.place for r in rows] == list(range(len(rows)))
        return [r.id for r in rows]

    assert order("library", None) == [3, 2, 1, 5, 4]
    assert order("selection", [5, 1, 5, 77, 3]) == [5, 1, 3]
    assert order("shelf", 9) == [2, 5, 3, 1]
    assert order("rack", 1) == [3, 2, 1, 5]
    assert order("shelf", 70) == []
    for form in export.FORMATS:
        assert all(r.entry for r in export.exported(works.where("title is not null and year is not null"), form).collect()), form
    assert len(export.FORMATS) == 10
