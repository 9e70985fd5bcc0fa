import pytest

from marketsig.plans import catalog
from marketsig.streaming import monitor as M

ROWS = [(1, "shares rise on strong profit", "src1"), (2, "shares rise on strong profit", "src2"),
        (3, "weak sales and a loss", "src1"), (4, "nothing new", "src3"), (5, None, "src3")]


@pytest.fixture(params=["one file", "a folder of files"])
def landed(request, spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = tmp_path / "written"
    docs.repartition(1 if request.param == "one file" else 3).write.parquet(str(out))
    sf = tmp_path / "sf"
    sf.mkdir()
    other = sf / "documents.parquet.old"  # a neighbour whose name goes on is no part of the table
    docs.write.parquet(str(other))
    if request.param == "one file":
        next(out.glob("part-*")).rename(sf / "documents.parquet")
    else:
        out.rename(sf / "documents.parquet")
    return str(sf)


def test_a_landed_table_streams_whole(spark, landed):
    rows = M.run_to_table(catalog._table_stream(spark, landed, "documents"), spark, "t-landed")
    assert sorted(map(tuple, rows.collect())) == sorted(ROWS)


def test_stream_dedup_of_a_landed_table(spark, landed):
    rows = catalog.stream_dedup(spark, landed).select("doc_id").collect()
    assert {1, 3, 4} <= {r.doc_id for r in rows} and 2 not in {r.doc_id for r in rows}
