"""Encodings and segment tables: round trips, sizes, choices, pruning."""

import numpy as np
import pytest

from millrace.errors import EngineError
from millrace.plans import run
from millrace.sources import encodings as E
from millrace.sources.segments import read_segments, segment_report, write_segments

RNG = np.random.default_rng(7)


def strings(values):
    out = np.empty(len(values), dtype=object)
    out[:] = [v.encode() for v in values]
    return out


COLUMNS = {
    "random int": RNG.integers(-(2**31), 2**31, 5000).astype(np.int32),
    "narrow": 1_700_000_000_000 + RNG.integers(0, 1000, 4096),
    "edge doubles": np.array([0.0, -0.0, 1.0, -1.0, np.pi, 1e308, -1e308, 5e-324, np.nan, np.inf]),
    "bit patterns": RNG.integers(0, 2**63, 1000).view(np.float64),
    "modes": strings([("AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB", "REG AIR", "")[i % 8] for i in range(3001)]),
    "empty int": np.zeros(0, np.int32),
    "empty string": strings([]),
    "one": np.array([42], np.int32),
    "extremes 32": np.array([-(2**31), 2**31 - 1, 0], np.int32),
    "extremes 64": np.array([-(2**63), 2**63 - 1, 0], np.int64),
    "unicode": strings(["é", "", "中文", "é"]),
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("encoding", E.ENCODINGS)
def test_round_trip_and_exact_estimate(name, encoding):
    values = COLUMNS[name]
    if not E.fits(encoding, values):
        with pytest.raises(EngineError):
            E.encode(encoding, values)
        with pytest.raises(EngineError):
            E.estimate(encoding, values)
        return
    data = E.encode(encoding, values)
    back = E.decode(encoding, data, len(values), values.dtype)
    assert len(data) == E.estimate(encoding, values)
    if values.dtype == np.float64:
        assert (back.view(np.int64) == values.view(np.int64)).all()
    else:
        assert back.tolist() == values.tolist() and back.dtype == values.dtype


@pytest.mark.parametrize(
    ("values", "encoding", "most"),
    [
        (np.repeat(np.arange(8, dtype=np.int32), 1000), E.RLE, 200),
        (strings([("first phrase here", "second phrase here", "third phrase", "another one")[i % 4] for i in range(4000)]), E.DICT, 4000 * 15 // 8),
        (1_700_000_000_000 + RNG.integers(0, 512, 4096), E.FOR, 2 * 4096),
        (strings([f"{x:016x}" for x in RNG.integers(0, 2**62, 2000)]), E.PLAIN, 10**6),
    ],
)
def test_the_smallest_encoding_is_chosen(values, encoding, most):
    got, data = E.encode_best(values)
    assert got == encoding and len(data) < most
    assert len(data) == min(E.estimate(e, values) for e in E.ENCODINGS if E.fits(e, values))


def test_bit_packing():
    for width in range(65):
        values = RNG.integers(0, 2**63, 97).astype(np.uint64) * np.uint64(2) & np.uint64(2**width - 1)
        data = E.pack(values, width)
        assert len(data) == E.packed_size(97, width) and (E.unpack(data, 97, width) == values).all()
    for n in (0, 1, 7, 8, 63, 64, 65, 1024):
        for width in (1, 3, 8, 13, 16, 31, 32, 47, 64):
            values = RNG.integers(0, 2**63, n).astype(np.uint64) & np.uint64(2**width - 1)
            assert (E.unpack(E.pack(values, width), n, width) == values).all()
    assert E.pack(np.array([5, 1], np.uint64), 3) == bytes([0b001101])
    assert [E.width_for(x) for x in (0, 1, 2, 255, 256, 2**64 - 1)] == [0, 1, 2, 8, 9, 64]
    with pytest.raises(EngineError):
        E.unpack(b"\x01", 3, 8)


def test_broken_chunks_are_engine_errors():
    data = E.encode(E.DICT, COLUMNS["narrow"])
    for bad in (b"", data[:3], data[:-1]):
        with pytest.raises(EngineError):
            E.decode(E.DICT, bad, 4096, np.int64)
    with pytest.raises(EngineError):
        E.decode(E.PLAIN, b"1234", 2, np.int32)
    with pytest.raises(EngineError):
        E.decode(E.RLE, E.encode(E.RLE, COLUMNS["one"]), 2, np.int32)
    with pytest.raises(EngineError):
        E.decode("OTHER", b"", 0, np.int32)


def test_segment_table(spark, tmp_path):
    rows = [(i // 4, None if i % 3 == 0 else 11 * i, i * 1.5, None if i % 5 == 0 else f"row{i % 13}") for i in range(4000)]
    df = spark.createDataFrame(rows, "day int, value long, price double, label string").repartition(3)
    path = str(tmp_path / "s")
    write_segments(df, path, 256, cluster_by=["day"])
    assert sorted(map(tuple, read_segments(spark, path).collect()), key=str) == sorted(rows, key=str)
    for op, keep in (("=", lambda d: d == 500), (">=", lambda d: d >= 900), ("<>", lambda d: d != 1), ("<", lambda d: d < 10)):
        literal = {"=": 500, ">=": 900, "<>": 1, "<": 10}[op]
        for pushed in (True, False):
            got = read_segments(spark, path, ["price", "day"], [("day", op, literal)], pushdown=pushed)
            assert got.columns == ["price", "day"] and sorted(map(tuple, got.collect())) == sorted((r[2], r[0]) for r in rows if keep(r[0]))
    few, all_groups = (run(read_segments(spark, path, ["day"], [("day", ">=", 950)], pushdown=p)) for p in (True, False))
    groups = [n.rows for n in few.nodes if "Filter" in n.name][-1]
    assert few.rows == all_groups.rows == 200 and groups <= 3 and all_groups.rows_scanned >= 16
    report = {r["column"]: r for r in segment_report(spark, path).collect()}
    assert report["day"]["range"] == "0 .. 999" and report["value"]["nulls"] == 1334 and report["day"]["row_groups"] >= 16
    assert report["label"]["encoding"] == "DICT" and 0 < report["day"]["bits_per_row"] < 32


def test_segment_mistakes(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(EngineError):
        write_segments(spark.createDataFrame([(True,)], "b boolean"), path)
    with pytest.raises(EngineError):
        write_segments(spark.range(3), path, 0)
    write_segments(spark.range(0), path)
    assert read_segments(spark, path).count() == 0
    with pytest.raises(EngineError):
        read_segments(spark, path, ["nothing"])
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "d double").coalesce(1)
    write_segments(nan, path)
    assert read_segments(spark, path, where=[("d", ">", 5.0)]).count() == 1


def test_dictionary_of_doubles_is_in_value_order():
    values = np.array([2.0, -1.0, 0.5, -5.0, 0.0, -0.0, np.nan, np.inf, -np.inf, -1.0])
    kept, places = E._distinct(values)
    assert repr(kept.tolist()) == "[-inf, -5.0, -1.0, -0.0, 0.0, 0.5, 2.0, inf, nan]"
    assert kept[places].view(np.int64).tolist() == values.view(np.int64).tolist()
    assert E.decode(E.DICT, E.encode(E.DICT, values), len(values), np.float64).view(np.int64).tolist() == values.view(np.int64).tolist()
