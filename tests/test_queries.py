import os

import duckdb
import pytest

from folioscope.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    c.sql(f"create table want as {SQL[name]}")
    c.sql(f"create view got as select * from '{tmp_path}/out/*.parquet'")
    cols = ",".join(f'"{r[0]}"' for r in sorted(c.sql("describe want").fetchall()))
    assert c.sql(f"select count(*) from (select {cols} from want except all select {cols} from got)").fetchall() == [(0,)]
    assert c.sql(f"select count(*) from (select {cols} from got except all select {cols} from want)").fetchall() == [(0,)]


def test_streamed_arrivals(spark, tmp_path):
    from folioscope.streaming.arrivals import watch

    schema = "bill string, version_no int, ord int, match_path array<string>, display_path array<string>, tag string, element_id string, header_text string, body_text string, section_number string, division_label string"
    src, seen = tmp_path / "in", []
    for v, text in ((1, "one two three"), (2, "one two four")):
        spark.createDataFrame([("b", v, 0, ["a"], ["a"], "t", f"e{v}", "", text, "", "")], schema).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = watch(stream, str(tmp_path / "state"), lambda df, n: seen.extend(df.select("pair_id", "change_type").collect()), str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert [tuple(r) for r in seen] == [("b:1:2", "modified")]
