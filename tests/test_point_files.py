import pytest

from pairforge.sources import point_files as S


def frame(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_mixed_lines(spark):
    read = frame(
        spark, "FileProperties\tNumberPointsinFile:4\tComment:two words", "0\t1.5 2.5  3.5\t7", "1 4", "2 0.5 0.25 8", "", " ",
        "3 9\tPointProperties\tx:1.25\t\ty:2\tgroup:5\tpointlabel:a b\tOriginalPointNumber:13", "PointProperties\tLocalPointNumber:4\tx:bad\tx:2\tsource:a:b",
    )
    got = {r.number: r for r in S.points(read, names={"source": "string"}, first=10).collect()}
    assert {n: (r.x, r.y, r.z, r.group) for n, r in got.items()} == {0: (1.5, 2.5, 3.5, 7), 1: (None, None, None, 4), 2: (0.5, 0.25, None, 8), 3: (1.25, 2.0, None, 9), 4: (None, None, None, None)}
    assert (got[3].label, got[3].original, got[3].colons, got[3].bare, got[4].source, got[4].bare) == ("a b", 3, True, True, "a:b", False)
    assert S.headers(read, {"NumberPointsinFile": "long", "Comment": "string", "None": "long"}).collect() == [(4, "two words", None)]
    assert S.file_kind(S.points(read), False, True).first() == (6, 5)


@pytest.mark.parametrize("line", ["1 2 3", "x 4", "1 z", "1 2 y 3", "1 2 3 4 5 6"])
def test_bad_lines_are_errors(spark, line):
    with pytest.raises(Exception, match="not a point"):
        S.points(frame(spark, line)).collect()


def test_kinds_of_files(spark):
    kind = lambda lines, labels=False: S.file_kind(S.points(frame(spark, *lines), labels), labels, False).first()
    assert kind(["0 1 2 3 4"]) == (0, 1) and kind(["0 1", "1 1"]) == (1, 2) and kind(["0 abc"], True) == (2, 1)
    assert kind(["PointProperties\tx:1\ty:2"]) == (3, 1) and kind(["PointProperties\tgroup:2"]) == (4, 1)
    assert S.file_kind(S.points(frame(spark)), False, False).first() == (1, 0)
    assert S.points(frame(spark, "0 abc"), True).first().label == "abc"


def test_comparison_labels(spark):
    got = S.comparison_labels(frame(spark, "1 100.5 2.5 2 PEP 17 3 4", "2 100 2 3 PEP 1 1 1", "3 1 2 2 Q 1.5 2.9995 -1", "h a b c d e f g", ""), 2)
    assert got.collect() == [(1, 100.5, 2.5, 17, "PEP", 3, 4), (3, 1.0, 2.0, -1, "Q", 3, -1)]
    for line, match in (("1 2 3 2", "short line"), ("1 2 3 2 a 1 x 1", "CAST")):
        with pytest.raises(Exception, match=match):
            S.comparison_labels(frame(spark, line), 2).collect()


def test_solution_round_trip(spark):
    found = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [0.1, 0.2, 0.3]), (1, [4.0, 5.0, 6.0], [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0], None)], "id long, x array<double>, err array<double>")
    roles = spark.createDataFrame([(0, 10, "varied"), (1, 11, "deleted"), (2, 12, "fixed"), (3, 13, None)], "id long, original long, role string")
    made = S.solution_points(found, roles, "run\t1")
    lines = S.solution_header(made, "run").unionByName(S.solution_lines(made))
    got = {r.number: r for r in S.points(lines, names={"xerr": "double", "source": "string", "FixedorVaried": "long"}).collect()}
    assert {n: (r.x, r.z, r.xerr, r.group, r.source, r.FixedorVaried) for n, r in got.items()} == {0: (1.0, 3.0, 0.1, 1, "run 1", 1), 1: (None, None, None, 3, None, 0), 2: (1.0, 1.0, None, 2, None, 2), 3: (None, None, None, -1, None, 0)}
    assert S.headers(lines, {"FileGenerationType": "long", "NumberPointsinFile": "long"}).first() == (4, 4)
    plain = S.plain_solution_lines(made.orderBy("LocalPointNumber"))
    assert [r.value for r in plain.collect()] == ["0\t1.0000E+00\t2.0000E+00\t3.0000E+00\t1", "2\t1.0000E+00\t1.0000E+00\t1.0000E+00\t1"]
    assert {r.number for r in S.points(plain).collect()} == {0, 2}
