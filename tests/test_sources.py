"""Paged sources and published pages."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.operators import delivery
from postloom.sources import landed, paged, published


def page(folder, cursor, ids, next_cursor):
    rows = [{"user_id": i, "screen_name": f"u{i}", "name": None, "other": 1} for i in ids]
    (folder / f"{cursor}.json").write_text(json.dumps({"members": [*rows, "odd"], "next_cursor": next_cursor}))


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(paged.CursorPages)
    pages = tmp_path / "pages"
    pages.mkdir()
    page(pages, "first", [1, 2], "b")
    page(pages, "b", [3], " c ")
    page(pages, "c", [], "d")
    return pages


def test_batch_follows_cursors(spark, folder):
    def ids(**options):
        return sorted((r["user_id"], r["page"]) for r in spark.read.format("cursor_pages").options(path=str(folder), **options).load().collect())

    assert ids() == [("1", "first"), ("2", "first"), ("3", "b")]
    assert ids(cursor="b") == [("3", "b")]
    page(folder, "d", [4], None)
    assert ids()[-1] == ("4", "d")
    page(folder, "d", [4], "b")  # round in a circle
    assert len(ids()) == 4
    assert spark.read.format("cursor_pages").options(path=str(folder)).schema("screen_name string").load().first()[0] == "u1"
    (folder / "first.json").write_text("[]")
    assert ids() == []


def test_stream_goes_on_from_its_cursor(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("cursor_pages").options(path=str(folder), pages="1").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["user_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2", "3"]
    (folder / "first.json").unlink()  # what is done isn't read again
    page(folder, "d", [4, 5], "e")
    assert run() == ["1", "2", "3", "4", "5"]
    assert run() == ["1", "2", "3", "4", "5"]
    page(folder, "e", [6], "")
    assert run() == ["1", "2", "3", "4", "5", "6"]


SCHEMA = "report_id string, day string, headline string, content string"


def test_pages_and_index_are_replaced(spark, tmp_path):
    spark.dataSource.register(published.ReportPages)
    out = tmp_path / "reports"

    def publish(rows):
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.format("report_pages").mode("append").option("path", str(out)).save()

    publish([("abcdefghij", "2024-01-01", "One\nline ", "# A\n\n"), ("klmnopqrst", "2024-01-02", "Two", "# B")])
    first = (out / "README.md").read_text()
    assert first == "# Daily Reports\n\n- 2024-01-02 | Two ([view](./2024-01-02-klmnopqr.md))\n- 2024-01-01 | One line ([view](./2024-01-01-abcdefgh.md))\n"
    assert (out / "2024-01-01-abcdefgh.md").read_text() == "# A\n"
    publish([("abcdefghij", "2024-01-01", "One\nline ", "# A\n\n"), ("klmnopqrst", "2024-01-02", "Two", "# B")])
    assert (out / "README.md").read_text() == first
    publish([("abcdefghij", "2024-01-01", "Changed", "# C")])
    assert (out / "README.md").read_text() == first.replace("One line", "Changed") and (out / "2024-01-01-abcdefgh.md").read_text() == "# C\n"
    before = {p.name: p.read_text() for p in out.iterdir()}
    with pytest.raises(Exception, match="needs an id"):
        publish([("uvwxyz0123", "2024-01-03", "Three", "# D"), (None, "2024-01-04", "bad", "x")])
    assert {p.name: p.read_text() for p in out.iterdir()} == before


def test_index_of_any_shape():
    line = published.entry("2024-01-01", "x", "f.md")
    assert published.indexed("text\n", {"f.md": line}) == f"{published.HEADER}\n\ntext\n\n{line}\n"
    assert published.indexed("# Own\nintro\r\n- old\n", {"f.md": line}) == f"# Own\n\nintro\n{line}\n- old\n"
    assert published.indexed(None, {}) == f"{published.HEADER}\n"


def test_caches_of_mixed_types(spark):
    texts = ['{"a": [[1.0, "x"], [3.0, 4.0], 7, [1], null], "b": [[0.0, 2]], "c": 5, "d": [[1e400, 5.5]], "e": [[true, {"x": 1}]]}', "nonsense", "[[1.0, 2.0]]", None, "{}", '"a"']
    cache = spark.createDataFrame([(t,) for t in texts], "samples string")
    got = sorted((r["tag"], [round(x, 6) for x in r["v"]]) for r in landed.tag_samples(cache, 2).collect())
    assert got == [("a", [0.6, 0.8]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("d", [0.0, 1.0]), ("e", [0.0, 0.0])]
    assert ("a", 1) in [(r["tag"], len(r["v"])) for r in landed.tag_samples(cache, 0).collect()]
    counts = spark.createDataFrame([('{"a": 3.7, "b": "x", "c": -2, "d": null, "e": true, "f": 12}',), ("no",), (None,)], "x string")
    assert [r[0] for r in counts.select(landed.sample_counts(F.col("x"))).collect()] == [{"a": 3, "c": 0, "f": 12}, None, None]


def test_bullets_of_mixed_types(spark):
    texts = ['{"bullets": ["a", 1, null, {"x": 2}, " b "]}', 'x ```json\n{"bullets": ["c"]}\n```', "{bad\n line", '{"bullets": 5}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(delivery.digest_items(F.col("t"))).collect()]
    assert got[0] == ["a", "b"] and got[2] == ["{bad", "line"] and got[4] is None
