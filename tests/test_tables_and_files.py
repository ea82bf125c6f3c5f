"""Orders that are the feature, exports, folders and lists of any length."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from incidentlab import io, tables
from incidentlab.multivalue import explode_members, narrow_members, widen_members
from incidentlab.rollup import with_previous
from suite import catalog


def test_share_table_has_the_largest_first_and_the_total_last(spark):
    df = spark.createDataFrame([(x,) for x in "aabbbcdd"] + [(None,)], "k string")
    rows = [(r.k, r.Number, r.Percent) for r in tables.share_table(df, "k").collect()]
    assert rows == [("b", 3, "33.3%"), ("a", 2, "22.2%"), ("d", 2, "22.2%"), ("c", 1, "11.1%"),
                    (None, 1, "11.1%"), ("Total", 9, "100.0%")]


def test_sorted_queries_come_in_order(spark, sf_dir):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    got = [(r.o_orderpriority, r.o_orderdate, r.o_orderkey)
           for r in catalog.queries()["sort_ordinal"](spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda r: (-levels.index(r[0]), r[1], r[2]))
    got = [(r.Total, r.county, r.victim or "") for r in
           catalog.queries()["breakdown_county"](spark, sf_dir).collect()]
    assert got == sorted(got)
    rows = catalog.queries()["export_table"](spark, sf_dir).collect()
    keys = [("%s%s" % ("19" if r.date[-2:] > "50" else "20", r.date[-2:]) + r.date[:2] + r.date[3:5], r["order no"])
            for r in rows]
    assert keys == sorted(sorted(keys, key=lambda k: k[1]), key=lambda k: k[0], reverse=True)


def test_export_writes_what_it_returns(spark, tmp_path):
    df = spark.createDataFrame([(2, "b, c"), (1, 'a "q"'), (3, None)], "i int, s string")
    out = str(tmp_path / "x.csv")
    view = io.export_view(df, {"No": F.col("i"), "Text": F.col("s")}, [F.desc("i")], out=out)
    want = [(3, None), (2, "b, c"), (1, 'a "q"')]
    assert [tuple(r) for r in view.collect()] == want
    back = spark.read.csv(out, header=True, schema="No int, Text string")
    assert sorted(map(tuple, back.collect())) == sorted(want)


def test_stages_need_a_shared_folder(spark):
    assert io.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    def session(folder, given):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(
            getCheckpointDir=lambda: option)))
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)

    assert io.shared_folder(session(None, "/given")).startswith("/given/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_folder(session(None, None))


def test_lists_of_any_length(spark):
    df = spark.createDataFrame([(1, "a, b, c, d, e, f, g, h"), (2, "x"), (3, None)], "id int, agency string")
    wide = widen_members(df)
    assert [c for c in wide.columns if c[-1].isdigit()] == [f"agency{i}" for i in range(1, 9)]
    cells = [c for c in wide.columns if c not in df.columns]
    back = narrow_members(wide.drop("agency"), ["id"], cells)
    members = {(r.id, r.agency) for r in explode_members(df).collect()}
    assert {(r.id, r.agency) for r in back.collect()} == members and len(members) == 9
    with pytest.raises(Exception, match="more than 6 members"):
        widen_members(df, n=6).collect()


def test_previous_record_of_the_group(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), (None, 1, 8), (None, 2, 9)],
                               "k string, n int, v int")
    got = {(r.k, r.n): r.before for r in with_previous(df, ["k"], "n", {"before": "v"}).collect()}
    assert got == {("a", 1): None, ("a", 2): 5, ("a", 3): None, (None, 1): None, (None, 2): 8}
