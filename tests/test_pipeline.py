"""Sources, types, profiles and whole pipelines, with rows asserted."""

import datetime as dt
import http.server
import json
import threading
import zipfile

import numpy as np
import pytest

from weftline import export, profile, security, xmlio
from weftline.operators import tidy
from weftline.session import Pipeline
from weftline.sources import dialect, readers, sheets, signals
from weftline.spec import OutputPort, Spec, sanitize
from weftline.streaming import temporal

XML = """<doc><inputs><input id="1" label="People" location="people.csv" format="CSV" fieldSeparator=";" header="true"/></inputs>
<pipeline><node id="2" label="Young" type="filter_less_than"><inputPort name="df" sourceRef="1"/><inputPort name="column" value="Age"/><inputPort name="value">30</inputPort>
<outputPort id="10" name="result" visibility="true"/><outputPort id="11" name="mask"/></node>
<node id="3" label="Sum" type="aggregate_sum"><inputPort name="df" sourceRef="10"/><outputPort id="12" name="result" visibility="true"/></node></pipeline></doc>"""


@pytest.fixture
def workspace(tmp_path):
    (tmp_path / "inputs").mkdir()
    (tmp_path / "inputs" / "people.csv").write_text("Age;Score;Name\n10;1.5;a\n20;2.0;b\n40;;c\n50;9.0;d\n")
    return tmp_path


def test_run(spark, workspace):
    events = []
    with Pipeline(spark, workspace, XML) as p:
        p.subscribe(lambda e, w: events.append((e, w.get("id"))))
        assert p.run() == (True, "") and ("node_completed", "3") in events
        assert [tuple(r) for r in spark.read.parquet(p.output_path("young_out") + ".parquet").collect()] == [(10, 1.5, "a"), (20, 2.0, "b")]
        assert [tuple(r) for r in p.get_dataset("sum_out").collect()] == [(30, 3.5)]
        assert [r.Age for r in p.get_dataset("young_mask").collect()] == [True, True, False, False]
        assert p.get_dataset("2").count() == 2 and p.get_leaves() == ["11", "12"] and p.get_id_for_name("people") == "1"
        n = len(events)
        assert p.run() == (True, "") and len(events) == n  # nothing changed
        meta = p.get_datasets_metadata()
        assert meta["people"]["rows"] == 4 and {f["name"]: f["type"] for f in meta["people"]["fields"]} == {"Age": "INTEGER", "Score": "FLOAT", "Name": "STRING"}
        back = xmlio.parse(p.export_to_xml())
        assert back == p.spec
        text = p.export_visual(workspace / "v.xml")
        assert "young_out" in text and export.read(workspace / "v.xml")["young_out"]["rows"] == 2
        new = p.promote_leaves()
        assert {p.spec.get_name(i) for i in new} >= {"sum_out"} and [tuple(r) for r in p.get_dataset("sum_out").collect()] == [(30, 3.5)]


def test_edit(spark, tmp_path):
    p = Pipeline(spark, tmp_path)
    a = p.add_input(data=spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), label="left")
    b = p.add_input(data=spark.createDataFrame([(2, "z")], "k int, r string"), label="right")
    j = p.add_node("join", inputs={"dfs": [a, b]}, params={"on": "k"}, label="both")
    c = p.add_node("count_rows", inputs={"df": j})
    assert p.run() == (True, "") and p.get_dataset(c) == 1 and [tuple(r) for r in p.get_dataset("both_out").collect()] == [(2, "y", "z")]
    with pytest.raises(ValueError, match="unknown transform"):
        p.add_node("nothing")
    with pytest.raises(ValueError, match="taken"):
        p.add_input(j)
    bad = p.add_node("select_columns", inputs={"df": a}, params={"columns": "q"})
    ok, error = p.run()
    assert not ok and "not found" in error
    p.remove_node(bad)
    assert p.run()[0]
    t = p.add_node("get_top_n", inputs={"df": a}, params={"column": "k", "n": 1}, outputs=[OutputPort("90", visibility=True), OutputPort("91", "mask")])
    assert p.get_dataset("91").count() == 2 and p.get_dataset(t).first().k == 2
    with pytest.raises(ValueError, match="itself"):
        p.add_node("count_rows", id_="200", inputs={"df": "201"}, outputs=[OutputPort("201")])
        p.spec.order()
    assert not p.run()[0]
    p.reset_spec()
    assert p.spec == Spec() and sanitize("Élan  vital!") == "elan_vital"


def test_collections(spark, workspace):
    for n in (2, 1):
        (workspace / "inputs" / f"t{n}.csv").write_text(f"v\n{n}\n{n}\n{n}\n")
    p = Pipeline(spark, workspace)
    i = p.add_input(None, "series", "t1.csv", "CSV", temporalFiles="t1.csv|t2.csv", header="true", fieldSeparator=",")
    n = p.add_node("concat_partitions", inputs={"partitioned": i})
    assert p.get_dataset(i).first().v == 1 and p.get_dataset(i, 9).first().v == 2
    assert sorted((r.v, r["__partition__"]) for r in p.get_dataset(n).distinct().collect()) == [(1, 0.0), (2, 1.0)]
    assert readers.interval_seconds("P1DT2H") == 93600
    spark.range(3).write.parquet(str(workspace / "s" / "a.parquet"))
    q = temporal.stream(spark, str(workspace / "s" / "*"), "id bigint").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from seen").first()[0] == 3


def test_dialects(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("Report\nby me\nname|age\n\"x|y\"|3\nz|4\nw|5\n")
    d = dialect.characterize(str(f))
    assert (d.separator, d.skip_lines, d.header) == ("|", 2, True)
    assert [tuple(r) for r in readers.read(spark, str(f)).collect()] == [("x|y", "3"), ("z", "4"), ("w", "5")]
    g = tmp_path / "b.csv"
    g.write_text("1;2\n3;4\n5;6\n")
    assert dialect.characterize(str(g)).header is False and readers.read(spark, str(g)).count() == 3
    assert f.read_text().startswith("Report")
    dialect.set_dialect_delegate(lambda lines: {"fieldSeparator": "#"})
    h = tmp_path / "c.csv"
    h.write_text("free text\nmore\n")
    assert dialect.characterize(str(h)).separator == "#"
    dialect.set_dialect_delegate(None)
    assert dialect.sniff(str(g))["fieldSeparator"] == ";"


def test_types(spark):
    cols = {
        "iso": ["2023-01-15", "2023-02-01", "2023-03-09"], "us": ["01/15/2023", "02/01/2023", "03/09/2023"], "eu": ["15/01/2023", "01/02/2023", "09/03/2023"], "compact": ["20230115", "20230201", "20230309"],
        "year": ["2020", "2021", "2022"], "whole": ["1", "n/a", "42"], "real": ["1.5", "2", "nan"], "truth": ["yes", "No", "true"], "text": ["a", "NULL", "b"], "mixed": ["1", "x", "y"],
    }
    extra = {"whole": "7", "real": "3"}
    data = [tuple(v[n] for v in cols.values()) for n in range(3)] + [tuple(extra.get(c) for c in cols)]
    df = profile.infer_types(spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols)))
    assert dict(df.dtypes) == {"iso": "timestamp_ntz", "us": "timestamp_ntz", "eu": "timestamp_ntz", "compact": "timestamp_ntz", "year": "bigint", "whole": "bigint", "real": "double", "truth": "boolean", "text": "string", "mixed": "string"}
    assert df.first().eu == dt.datetime(2023, 1, 15) and [r.text for r in df.collect()] == ["a", None, "b", None]
    e = profile.infer_types(spark.createDataFrame([(1_770_000_000, 5)], "timestamp bigint, id bigint"))
    assert dict(e.dtypes) == {"timestamp": "timestamp_ntz", "id": "bigint"}


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a", dt.datetime(2020, 1, 1)), (2, float("nan"), "b", None)], "i bigint, f double, s string, t timestamp_ntz")
    d = profile.describe(df)
    by = {f["name"]: f for f in d["fields"]}
    assert d["rows"] == 2 and by["t"]["min"] == 1577836800000000000 and by["f"]["nulls"] == 1 and by["s"]["uniques"] == ["a", "b"] and by["i"]["is_unique"]
    c = profile.Catalogue(tmp_path / "c.json")
    c.store("x", d, "1")
    c.store("y", d, "1")
    assert list(c.read()) == ["y"] and c.remove("y") and not c.remove("y")
    c.store("z", d, "2")
    c.add_partition_field("z", 3)
    assert c.read()["z"]["fields"][-1]["max"] == 2.0 and "| s | STRING |" in profile.render(c.read()) and json.loads(profile.render(c.read(), "json"))
    assert profile.describe(df.limit(0))["rows"] == 0


def workbook(path, sheet, shared, merged=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData>{merged}</worksheet>")


def test_sheets(spark, tmp_path):
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row r="3"><c r="B3"><v>3</v></c><c r="C3"><v>4</v></c></row>'
    path = tmp_path / "b.xlsx"
    workbook(path, cells, ["city", "2020", "2021"], '<mergeCells><mergeCell ref="A2:A3"/></mergeCells>')
    book = sheets.workbook(str(path))
    assert book[0].rows == [["city", "2020", "2021"], ["x", 1, 2.5], ["x", 3, 4]] and sheets.expand_columns("Y:AB") == ["Y", "Z", "AA", "AB"]
    assert readers.read(spark, str(path)).count() == 3
    flat = tidy.tidy_excel_data(str(path))
    assert list(flat) == ["s_one"] and [tuple(r) for r in flat["s_one"].collect()] == [("x", "1", "2.5"), ("x", "3", "4")]
    region = tidy.Region("cross_tab", anchors=(tidy.Cell("A", "city", "town"),), pivots=(tidy.Cell("B", "2020"), tidy.Cell("C", "2021")), pivot_name="year", value_name="n", value_type="float")
    tall = tidy.tidy_excel_data(str(path), map_table=lambda t, view, trouble: region)["s_one"]
    assert sorted(tuple(r) for r in tall.collect()) == [("x", "2020", 1.0), ("x", "2020", 3.0), ("x", "2021", 2.5), ("x", "2021", 4.0)] and tall.columns == ["town", "year", "n"]
    form = tidy.Region("form", fields=(("first", "B2", "int"), ("none", "Z9", "string")))
    got = tidy.execute_steps(sheets.grid(spark, book[0]), tidy.compile_region(form))[0]
    assert tuple(got.first()) == (1, None)
    p = Pipeline(spark, tmp_path / "w")
    ids = p.register_files([str(path)])
    assert p.run() == (True, "") and not p.spec.inputs[0].visibility and p.register_files([str(path)]) == [] and len(ids) == 1
    assert p.remove_files(["b.xlsx"]) == 1


def test_signals(tmp_path, spark):
    head = lambda *xs: "".join(str(x).ljust(n)[:n] for x, n in xs).encode()
    top = head(("0", 8), ("p", 80), ("r", 80), ("01.01.24", 8), ("00.00.00", 8), (512, 8), ("", 44), (2, 8), (1, 8), (1, 4))
    ch = head(("EEG", 16), ("", 80), ("uV", 8), (-100, 8), (100, 8), (-1000, 8), (1000, 8), ("", 80), (3, 8), ("", 32))
    f = tmp_path / "a.edf"
    f.write_bytes(top + ch + np.array([0, 10, -10, 1000, -1000, 5], "<i2").tobytes())
    got = [(r.channel, r.sample_idx, round(r.t, 3), round(r.value, 3)) for r in readers.read(spark, str(f)).orderBy("sample_idx").collect()]
    assert got == [("EEG", 0, 0.0, 0.0), ("EEG", 1, 0.333, 1.0), ("EEG", 2, 0.667, -1.0), ("EEG", 3, 1.0, 100.0), ("EEG", 4, 1.333, -100.0), ("EEG", 5, 1.667, 0.5)]
    assert signals.mhd_header("NDims = 3\nDimSize = 2 2 2")["DimSize"] == "2 2 2"
    with pytest.raises(ValueError):
        signals.edf_header(b"x")


def test_download(tmp_path):
    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/csv")
            if "named" in self.path:
                self.send_header("Content-Disposition", 'attachment; filename="../served.csv"')
            self.end_headers()
            self.wfile.write(b"a,b\n1,2\n")

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    assert readers.download(url + "/named", str(tmp_path)).endswith("/served.csv") and readers.download(url + "/", str(tmp_path)).endswith("url_data.csv")
    with pytest.raises(ValueError, match="larger"):
        readers.download(url + "/x.csv", str(tmp_path), most=3)
    s.shutdown()
    with pytest.raises(ValueError):
        readers.download("file:///etc/passwd", str(tmp_path))


def test_paths(tmp_path):
    with pytest.raises(ValueError):
        security.safe_path("../x", str(tmp_path))
    assert security.safe_name("../../a b?.csv") == "a b_.csv"


def test_file_stats(spark, tmp_path):
    from weftline.describe_files import file_stats

    for n, text in ((1, "name,value\na,1\nb,2\nc,3\n"), (2, "name,value\nd,4\n")):
        (tmp_path / f"{n}.csv").write_text(text)
    d = file_stats(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    assert d["rows"] == 4 and [(f["name"], f["type"], f["max"]) for f in d["fields"]] == [("name", "STRING", None), ("value", "INTEGER", 4)]
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert file_stats(spark, [str(tmp_path / "t.json")])["info"]["tabular"] and file_stats(spark, [str(tmp_path / "t.json")])["rows"] == 2
    (tmp_path / "n.json").write_text('{"nodes": [{"data": {"id": 1}}], "edges": []}')
    assert file_stats(spark, [str(tmp_path / "n.json")])["fields"][0]["name"] == "nodes[].data.id"
    (tmp_path / "v.mhd").write_text("NDims = 3\nDimSize = 4 3 2\nElementSpacing = 1 1 2.5\n")
    v = file_stats(spark, [str(tmp_path / "v.mhd")])
    assert v["rows"] == 24 and v["fields"][2]["max"] == 2.5
    us = lambda a, b, x: bytes([a, 0, b, 0]) + b"US\x02\x00" + x.to_bytes(2, "little")
    (tmp_path / "d.dcm").write_bytes(b"\0" * 128 + b"DICM" + us(0x28, 0x10, 5) + us(0x28, 0x11, 6))
    assert file_stats(spark, [str(tmp_path / "d.dcm")])["rows"] == 30
    assert file_stats(spark, ["x.zip"]) is None
