"""Sources and sinks: CSV round trip, discovery and role classification,
dictionary and line files, JSON sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.functions.lexicons import DEFAULT_SYMPTOMS
from pvlens.session import scratch_path
from pvlens.sources import files as IO

SCHEMA = T.StructType([T.StructField("VAERS_ID", T.LongType()), T.StructField("year", T.StringType()),
                       T.StructField("AGE_YRS", T.DoubleType()), T.StructField("SYMPTOM_TEXT", T.StringType())])


def test_csv_round_trip_keeps_quotes_newlines_spaces(spark):
    data = [(1, "2021", 3.5, '  He said "ouch",\nthen fainted; café  '), (2, "2021", None, None),
            (3, "2022", 1.0, "NA")]
    df = spark.createDataFrame(data, SCHEMA)
    base = scratch_path(spark, "csv")
    IO.write_report_parts({"DATA": df}, base)
    back = IO.read_report_part(spark, base, "DATA", SCHEMA, "UTF-8").orderBy("VAERS_ID").collect()
    assert back[0]["SYMPTOM_TEXT"] == data[0][3]
    assert back[0]["AGE_YRS"] == 3.5 and back[0]["year"] == "2021"
    assert back[1]["SYMPTOM_TEXT"] is None and back[1]["AGE_YRS"] is None
    assert back[2]["SYMPTOM_TEXT"] is None  # 'NA' is a null token
    # years that are not asked for are not opened
    only = IO.read_report_part(spark, base, "DATA", SCHEMA, "UTF-8", years=["2022"])
    assert [r["VAERS_ID"] for r in only.collect()] == [3] and len(only.inputFiles()) == 1


def test_columns_are_bound_by_header(spark):
    base = scratch_path(spark, "header")
    row = spark.createDataFrame([("CA", 7, "it’s 日本 – ok")], "STATE string, VAERS_ID long, SYMPTOM_TEXT string")
    IO.write_csv(row, base + "/a.csv")
    IO.write_csv(row.select("SYMPTOM_TEXT", "VAERS_ID", F.lit(1).alias("more"), "STATE"), base + "/b.csv")
    got = IO.read_csv_raw(spark, base, ["VAERS_ID", "STATE", "SYMPTOM_TEXT"]).collect()
    assert [tuple(r) for r in got] == [("7", "CA", "it’s 日本 – ok")] * 2
    with pytest.raises(ValueError, match="no columns"):
        IO.read_csv_raw(spark, base, ["VAERS_ID", "more"])


def test_compressed_parts_are_found_and_read(spark):
    rows = [(i, "2021" if i % 2 else "2022", 3.5, f'a "long"\ntext ' + f"of many rows {i // 50} " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    plain, packed = scratch_path(spark, "plain"), scratch_path(spark, "packed")
    IO.write_report_parts({"DATA": df}, plain)
    IO.write_report_parts({"DATA": df}, packed, compression="gzip")

    def read(base):
        return sorted(map(tuple, IO.read_report_part(spark, base, "DATA", SCHEMA, "UTF-8").select(df.columns).collect()))

    def size(base):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base.removeprefix("file:")) for f in names)
    assert read(packed) == read(plain) == sorted(rows)
    assert size(packed) < size(plain) / 3


def test_folders_are_written_without_a_sort(spark, monkeypatch):
    """A task has several folders' files open; where there are more, it sorts the rest. The
    session's settings are put back."""
    from pyspark.sql import DataFrameWriter
    names = ["spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    seen, csv = [], DataFrameWriter.csv

    def watched(self, path):
        seen.append([spark.conf.get(n) for n in names])
        return csv(self, path)
    monkeypatch.setattr(DataFrameWriter, "csv", watched)
    before = [spark.conf.get(n, None) for n in names]
    rows = [(i, str(2000 + i * 7 % 9), i / 2, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for files in (2, 50):
        monkeypatch.setattr(IO, "OPEN_FILES", files)
        base = scratch_path(spark, "folders")
        IO.write_report_parts({"DATA": df}, base, compression="gzip")
        back = IO.read_report_part(spark, base, "DATA", SCHEMA, "UTF-8").select(df.columns)
        assert sorted(map(tuple, back.collect())) == rows
    assert seen == [["2", "true"], ["50", "true"]]
    assert [spark.conf.get(n, None) for n in names] == before


def test_yearly_files_are_compressed_and_read(spark, sf):
    from pvlens.plans.jobs import read_complete_parts
    from pvlens.plans.q_more import _write_yearly
    from pvlens.sources import tables
    base = _write_yearly(spark, sf)
    files = IO.classify_files(IO.list_files(spark, base)).collect()
    assert {f["role"] for f in files if f["path"].endswith(".csv")} == {"OTHER"}
    parts = read_complete_parts(spark, base)
    wanted = tables.yearly_parts(spark, sf)["DATA"].where(F.col("year") != tables.INCOMPLETE_YEAR)
    got = parts["DATA"].select("year", "VAERS_ID", "NUMDAYS", "SYMPTOM_TEXT")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.select(got.columns).collect()))


def test_a_years_rows_do_not_search_their_path(spark):
    base = scratch_path(spark, "years")
    df = spark.createDataFrame([(1, "2021", 1.0, "a"), (2, "2022", None, "b" * 9), (3, "2022", 2.0, "<NA>")], SCHEMA)
    IO.write_report_parts({"DATA": df}, base)
    back = IO.read_report_part(spark, base, "DATA", SCHEMA, "UTF-8")
    assert sorted(map(tuple, back.select("VAERS_ID", "year", "SYMPTOM_TEXT").collect())) == [
        (1, "2021", "a"), (2, "2022", "b" * 9), (3, "2022", None)]
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" not in plan and "regexp_extract" not in plan
    none = IO.read_report_part(spark, base, "VAX", SCHEMA, "UTF-8")
    assert none.count() == 0 and set(none.columns) == set(back.columns)


def test_two_files_for_one_part_are_an_error(spark):
    from pvlens.plans.jobs import read_complete_parts
    base = scratch_path(spark, "doubled")
    row = spark.createDataFrame([(1,)], "VAERS_ID long")
    for name in ("2021VAERSVAX.csv", "2021oldVAX.csv"):
        IO.write_csv(row, f"{base}/2021VAERSData/{name}")
    with pytest.raises(ValueError, match="more than one file"):
        read_complete_parts(spark, base)


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from pvlens.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)


def test_classify_yearly_folders(spark):
    paths = ["file:/d/2021VAERSData/2021VAERSDATA.csv", "file:/d/2021VAERSData/2021VAERSSYMPTOMS.csv",
             "file:/d/2021VAERSData/2021VAERSVAX.csv", "file:/d/2021VAERSData/notes.csv",
             "file:/d/out/SYMPTOMS/year=2022/part-0.csv"]
    got = IO.classify_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [(r["year"], r["role"]) for r in got] == [
        ("2021", "DATA"), ("2021", "SYMPTOMS"), ("2021", "VAX"), ("2021", "OTHER"), ("2022", "SYMPTOMS")]


def test_lines_and_dictionary(spark):
    path = scratch_path(spark, "dict")
    spark.createDataFrame([("  rash ",), ("",), ("   ",), ("fever",)], "value string") \
         .coalesce(1).write.text(path)
    lines = IO.read_lines(spark, path).orderBy("line_no")
    assert [r["text"] for r in lines.collect()] == ["rash", "fever"]
    d = IO.load_symptom_dictionary(spark, path).orderBy("priority")
    assert [r["term"] for r in d.collect()] == ["rash", "fever"]
    builtin = IO.load_symptom_dictionary(spark, os.path.join(path, "missing.txt"))
    assert builtin.count() == len(DEFAULT_SYMPTOMS) == 83


def test_json_sink_stringifies_map_keys(spark):
    df = spark.createDataFrame([(1, {0: ["headache"], 1: ["nausea"]})], "id long, c map<int,array<string>>")
    path = scratch_path(spark, "json")
    IO.write_json(df, path)
    back = spark.read.json(path).first()
    assert back["c"]["0"] == ["headache"]


def test_inline_texts(spark):
    df = IO.texts_frame(spark, ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [(0, "a"), (1, "b")]


def test_annotation_arrays(spark):
    rows = [(i, (f'say "é{i}",\n[x]',), [((["SYMPTOM"], i, i + 3),)] * (i % 3)) for i in range(40)]
    rows += [(7, (None,), None), (None, ("no key",), [])]
    schema = T.StructType([T.StructField("VAERS_ID", T.LongType())] + IO.ANNOTATION_SCHEMA.fields)
    df = spark.createDataFrame(rows, schema)
    path = IO.write_annotation_arrays(df, scratch_path(spark, "arrays"), ["VAERS_ID"], rows_per_file=8)
    back = IO.read_annotations(spark, path, schema=schema)
    assert back.columns == schema.fieldNames()
    key = lambda r: str(r)
    # a null struct field and a missing one are the same in JSON
    plain = lambda d: sorted(((r["VAERS_ID"], r["data"]["text"] if r["data"] else None, r["result"]) for r in d.collect()), key=key)
    assert plain(back) == plain(df)
    files = back.inputFiles()
    assert len(files) > 2
    for f in files:
        with open(f.removeprefix("file://")) as got:
            array = json.load(got)  # each file is one array, in order
        ids = [r.get("VAERS_ID", -1) for r in array]
        assert ids == sorted(ids) and len(ids) < 30
    empty = IO.write_annotation_arrays(df.limit(0), scratch_path(spark, "arrays"), ["VAERS_ID"])
    assert IO.read_annotations(spark, empty, schema=schema).count() == 0
