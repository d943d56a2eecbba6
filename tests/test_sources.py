"""Storage: round trips, ranges, pruning, broken files, the command line, sinks."""

import os

import pytest

from millrace.cli import main
from millrace.errors import EngineError
from millrace.operators import scan
from millrace.plans import run
from millrace.sources import TableWriter, can_contain, prune_estimate, read_table, row_groups, table_report, write_table
from millrace.sources import inspect
from millrace.sources.datagen import MODES, generate
from millrace.sources.inspect import ColumnRange
from millrace.streaming import CountingSink, drain, drain_files

GENERAL = "id long, bucket int, price double, mode string"


def general(spark, n):
    return spark.createDataFrame([(i, i % 7, i * 1.5, ("A", "B", "C", "D")[i % 4]) for i in range(n)], GENERAL)


def test_round_trip_across_groups(spark, tmp_path):
    write_table(general(spark, 10_000), str(tmp_path / "t"), 1024, ["id"], files=1)
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, general(spark, 10_000).collect()))
    groups = list(row_groups(spark, str(tmp_path / "t")))
    assert len(groups) >= 9 and sum(g.rows for g in groups) == 10_000


def test_nulls_survive_and_stay_out_of_ranges(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 11 * i, None if i % 5 == 0 else f"row{i % 13}") for i in range(3000)]
    df = spark.createDataFrame(rows, "value long, label string")
    write_table(df, str(tmp_path / "n"), 512, files=1)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "n")).collect()), key=str) == sorted(rows, key=str), key
    z = spark.createDataFrame([(None,)] * 50 + [(1050 + i,) for i in range(50)], "v int").coalesce(1)
    write_table(z, str(tmp_path / "z"), 1024)
    (group,) = row_groups(spark, str(tmp_path / "z"))
    c = group.columns["v"]
    assert (c.nulls, c.rows, c.low, c.high) == (50, 100, 1050, 1099)


def test_pruning_counts(spark, tmp_path):
    path = str(tmp_path / "d")
    write_table(spark.range(1000).selectExpr("cast(id as int) day"), path, 100, ["day"], files=1)
    assert prune_estimate(spark, path).groups_total == 10 and prune_estimate(spark, path).skip_rate == 0
    assert prune_estimate(spark, path, [("day", ">=", 750)]).groups_read == 3
    assert prune_estimate(spark, path, [("day", "=", 512)]).groups_read == 1
    assert run(scan(spark, path, where=[("day", "=", 512)])).rows_scanned == 100
    with pytest.raises(EngineError):
        prune_estimate(spark, path, [("nothing", "=", 1)])


def calls(spark, monkeypatch, action):
    """Calls to the JVM that an action makes."""
    client, n = spark._jvm._gateway_client, [0]
    send = client.send_command

    def counted(command, *args, **kwargs):
        n[0] += command.startswith("c\n")  # not what lets go of objects
        return send(command, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(client, "send_command", counted)
        action()
    return n[0]


def test_footers_cost_no_calls_for_row_groups(spark, tmp_path, monkeypatch):
    found = []
    for groups in (4, 400):
        path = str(tmp_path / f"g{groups}")
        write_table(general(spark, groups * 2), path, 2, ["id"], files=1)
        found.append([calls(spark, monkeypatch, lambda path=path: prune_estimate(spark, path, [("id", "<", 2)])), prune_estimate(spark, path, [("id", "<", 2)])])
    assert [x.groups_total for _, x in found] == [4, 400] and [x.groups_read for _, x in found] == [1, 1]
    assert found[1][0] < found[0][0] + 100


def test_report_costs_no_calls_for_row_groups(spark, tmp_path, monkeypatch):
    found = []
    for groups in (4, 400):
        path = str(tmp_path / f"g{groups}")
        write_table(general(spark, groups * 2), path, 2, ["id"], files=1)
        found.append(calls(spark, monkeypatch, lambda path=path: table_report(spark, path)))
        report = {r["column"]: r for r in table_report(spark, path).collect()}
        assert {(r["row_groups"], r["rows"], r["nulls"]) for r in report.values()} == {(groups, groups * 2, 0)}
        assert report["id"]["range"] == f"0 .. {groups * 2 - 1}" and report["mode"]["range"] == "A .. D"
    assert found[1] < found[0] + 100


def test_report_of_encodings_that_differ(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.range(0, 4000, 1, 2).selectExpr("IF(id < 2000, id, id % 2) v", "id % 2 w")
    df.write.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", "1024").parquet(path)
    report = {r["column"]: r["encoding"] for r in table_report(spark, path).collect()}
    assert report["v"].endswith("*") and not report["w"].endswith("*")


def test_long_footers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "long")
    write_table(general(spark, 1000), path, 10, ["id"], files=3)
    whole = list(row_groups(spark, path))
    assert sum(g.rows for g in whole) == 1000 and len(whole) >= 100 and set(whole[0].columns) == {"id", "bucket", "price", "mode"}
    monkeypatch.setattr(inspect, "TAIL", 20)
    monkeypatch.setattr(inspect, "PIECE", 777)
    assert list(row_groups(spark, path)) == whole
    assert [list(g.columns) for g in row_groups(spark, path, ["mode", "nothing"])] == [["mode"]] * len(whole)


def test_ranges_of_types(spark, tmp_path):
    path = str(tmp_path / "types")
    rows = "SELECT 0.1f f, 0D d, 'NaN'::double x, true b, 1.25::decimal(9,2) n, date'1970-01-11' day, 'é' s, now() t, named_struct('a', 1L) p UNION ALL SELECT 2.5f, -0D, 1D, false, -7, date'1970-01-02', 'z', now(), named_struct('a', 2L)"
    write_table(spark.sql(rows).coalesce(1), path)
    (group,) = row_groups(spark, path)
    ranges = {c.column: (c.low, c.high) for c in group.columns.values()}
    assert ranges == {"f": (0.1, 2.5), "d": (0, 0), "x": (None, None), "b": (False, True), "n": (-700, 125), "day": (1, 10), "s": ("z", "é"), "t": (None, None), "p.a": (1, 2)}
    assert [str(v) for v in ranges["d"]] == ["-0.0", "0.0"]


@pytest.mark.parametrize(
    ("op", "literal", "want"),
    [("=", 5, True), ("=", 11, False), ("<>", 5, True), ("<", 1, False), ("<=", 1, True), (">", 10, False), (">=", 10, True), ("=", "x", True)],
)
def test_can_contain(op, literal, want):
    assert can_contain(ColumnRange("c", 10, 0, 1, 10, 0, ""), op, literal) is want


def test_can_contain_edges():
    assert not can_contain(ColumnRange("c", 10, 10, None, None, 0, ""), "=", 1)
    assert not can_contain(ColumnRange("c", 10, 0, 3, 3, 0, ""), "<>", 3)
    assert not can_contain(ColumnRange("c", 10, 0, "b", "d", 0, ""), "<", "b")
    assert can_contain(ColumnRange("c", 10, None, None, None, 0, ""), "=", 3)


def test_broken_files(spark, tmp_path):
    (tmp_path / "garbage").mkdir()
    (tmp_path / "garbage" / "part-0.parquet").write_text("this is not a table at all")
    (tmp_path / "garbage" / "_SUCCESS").touch()
    path = str(tmp_path / "cut")
    write_table(general(spark, 1000), path, 256, files=1)
    (part,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
    whole = (tmp_path / "cut" / part).read_bytes()
    (tmp_path / "cut" / part).write_bytes(whole[:-12])
    for f in os.listdir(path):
        if f.endswith(".crc"):
            os.remove(f"{path}/{f}")
    for bad in (tmp_path / "garbage", tmp_path / "cut", tmp_path / "nowhere"):
        with pytest.raises(EngineError, match="cannot open"):
            read_table(spark, str(bad))
    write_table(general(spark, 10), path, files=1)
    os.remove(f"{path}/_SUCCESS")
    with pytest.raises(EngineError, match="not completed"):
        read_table(spark, path)


def test_writer(spark, tmp_path):
    schema = general(spark, 1).schema
    w = TableWriter(spark, str(tmp_path / "w"), schema, 100)
    w.append(general(spark, 300))
    w.append(general(spark, 1))
    for bad in (general(spark, 1).select("id"), general(spark, 1).selectExpr("bucket", "bucket", "price", "mode")):
        with pytest.raises(EngineError):
            w.append(bad)
    with pytest.raises(EngineError):
        read_table(spark, str(tmp_path / "w"))
    assert w.finish(["id"]) == 301 and read_table(spark, str(tmp_path / "w")).count() == 301
    with pytest.raises(EngineError):
        w.append(general(spark, 1))


def test_report(spark, tmp_path):
    path = str(tmp_path / "r")
    write_table(general(spark, 2000).selectExpr("*", "cast(null as int) nothing"), path, 500, ["id"], files=1)
    report = {r["column"]: r for r in table_report(spark, path).collect()}
    assert report["id"]["range"] == "0 .. 1999" and report["nothing"]["range"] == "(all null)" and report["nothing"]["nulls"] == 2000
    assert report["mode"]["rows"] == 2000 and report["mode"]["row_groups"] == 4 and "DICTIONARY" in report["mode"]["encoding"]
    one = read_table(spark, path, ["price"])
    assert one.columns == ["price"] and one.count() == 2000


def test_generated_rows_do_not_depend_on_partitions(spark):
    rows = sorted(map(tuple, generate(spark, 1000).collect()))
    assert rows == sorted(map(tuple, generate(spark, 1000).repartition(7).collect()))
    assert rows[0][0] == 8000 and rows[-1][0] == 8015 and {r[3] for r in rows} <= set(MODES) and all(0 <= r[2] < 1000 for r in rows)
    assert generate(spark, 0).count() == 0


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")
    assert main(["gen", path, "20000", "1000"]) == 0
    assert main(["info", path]) == 0
    out = capsys.readouterr().out
    assert "20,000 rows" in out and "8000 .. 8312" in out
    assert main(["scan", path, "--where", "day", ">=", "8300", "--group-by", "mode", "--sum", "price"]) == 0
    out = capsys.readouterr().out
    assert "7 groups" in out and "skipped" in out
    assert main(["scan", path, "--where", "day", "==", "8000", "--limit", "3", "--no-pushdown"]) == 0
    out = capsys.readouterr().out
    assert out.count("8000 ") == 3 and "rows decoded 20,000" in out
    assert main(["scan", path, "--where", "day", "~", "1"]) == 1
    assert main(["info", path + "-nowhere"]) == 1
    assert main(["nonsense"]) == 2 and main([]) == 2 and main(["help"]) == 0


def test_sinks(spark, tmp_path):
    sink = CountingSink()
    drain(general(spark, 50), sink)
    assert (sink.rows, sink.finished) == (50, True)
    write_table(general(spark, 500), str(tmp_path / "s"), files=3)
    sink = CountingSink()
    args = (spark, str(tmp_path / "s"), general(spark, 1).schema, sink, str(tmp_path / "offsets"))
    drain_files(*args, files_per_batch=1, step=lambda df: df.filter("id >= 100"))
    assert sink.rows == 400
    drain_files(*args)
    assert sink.rows == 400
