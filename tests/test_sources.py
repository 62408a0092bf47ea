"""CSV files: types from the values, and lines put aside."""

import pytest
from pyspark.sql import types as T

from gridsift.sources import tables


def lines(path, *rows):
    path.mkdir(exist_ok=True)
    for i, own in enumerate(rows):
        (path / f"part{i}.csv").write_text("\n".join(own) + "\n" if own else "")
    return str(path)


def test_types_are_the_narrowest_that_fit_all_files(spark, tmp_path):
    head = "a,b,c,d,e,f,g"
    path = lines(tmp_path / "x", [head, "1,1,true,2024-01-01,2024-01-01 10:00:00,x,", "2,2.5,false,2024-1-2,2024-01-02 00:00:00,1,"], [head, ",3,TRUE,,,,"])
    kinds = [f.dataType.simpleString() for f in tables.infer_types(spark, path)]
    assert kinds == ["bigint", "double", "boolean", "date", "timestamp_ntz", "string", "string"]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    head = "id,value,name"
    path = lines(tmp_path / "y", [head, "1,1.5,a", "2,word,b", "3,2.5", "4,3.5,d,e", '5,4.5,"x, y"', "6,,"], [head, "7,5.5,z"])
    good, bad = tables.read_csv_checked(spark, path, tolerance=0.2)
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 1.5, "a"), (5, 4.5, "x, y"), (6, None, None), (7, 5.5, "z")]
    assert sorted(r["line"] for r in bad.collect()) == ["2,word,b", "3,2.5", "4,3.5,d,e"]
    strict, none = tables.read_csv_checked(spark, path)
    assert strict.schema["value"].dataType == T.StringType() and none.count() == 2
    declared = T.StructType().add("id", "long").add("value", "double").add("name", "string")
    assert tables.read_csv_checked(spark, path, declared)[1].count() == 3


def test_files_without_rows_or_header(spark, tmp_path):
    good, bad = tables.read_csv_checked(spark, lines(tmp_path / "z", ["id,value"]))
    assert good.columns == ["id", "value"] and good.count() == bad.count() == 0
    good, bad = tables.read_csv_checked(spark, lines(tmp_path / "w", ["1,2.5", "2,3"]), names=["id", "odd.name"])
    assert good.columns == ["id", "odd.name"] and good.count() == 2 and bad.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_csv_checked(spark, str(tmp_path / "missing"))


def test_features_of_a_stored_panel_shuffle_nothing(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridsift.operators import cleaning, features
    from gridsift.schema import KEY, TIME, VALUE
    from gridsift.sources.generator import synthetic_panel

    cleaned = cleaning.clean(synthetic_panel(spark, 15, 3))
    stored = tables.store_panel(cleaned, 6)
    found = features.raw_features(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" not in cleaning.fill(stored, [VALUE])._jdf.queryExecution().executedPlan().toString()
    want = {r[KEY]: tuple(r) for r in features.raw_features(cleaned).collect()}
    got = {r[KEY]: tuple(r) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b) for k in want for a, b in zip(got[k], want[k], strict=True) if b is not None)
    assert stored.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(KEY, TIME))).where("n > 1").count() == 0
