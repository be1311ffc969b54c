import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import alignment as A
from pairforge.functions import special
from pairforge.functions.scoring import identity, named, nucleotide, parse
from pairforge.plans import sequences
from pairforge.sources import fasta, matrix, points


def plain(a, b, open_, extend, local, table):
    n, m, no = len(a), len(b), -1e9
    v = [[0.0] * (m + 1) for _ in range(n + 1)]
    g, h = ([[no] * (m + 1) for _ in range(n + 1)] for _ in "gh")
    if not local:
        for i in range(1, n + 1):
            v[i][0] = -(open_ + (i - 1) * extend)
        for j in range(1, m + 1):
            v[0][j] = -(open_ + (j - 1) * extend)
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            g[i][j] = max(g[i - 1][j] - extend, v[i - 1][j] - open_)
            h[i][j] = max(h[i][j - 1] - extend, v[i][j - 1] - open_)
            v[i][j] = max(v[i - 1][j - 1] + table[ord(a[i - 1]), ord(b[j - 1])], g[i][j], h[i][j], *([0] if local else []))
            best = max(best, v[i][j])
    return best if local else v[n][m]


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("gaps", [(14, 4), (5, 1), (3, 3)])
def test_alignment_score_and_rows(local, gaps):
    rnd, aligner = random.Random(1), A.Aligner(open_=gaps[0], extend=gaps[1], local=local)
    for k in range(150):
        a = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 25)))
        b = a[rnd.randint(0, 3) :][:20] if k % 3 == 0 else "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 25)))
        r = aligner.align(a, b)
        assert r.score == pytest.approx(plain(a, b, *gaps, local, aligner.table))
        score, gap = 0, None
        for p, q in zip(r.aligned1, r.aligned2):
            now = 1 if p == "-" else 2 if q == "-" else None
            score += aligner.table[ord(p), ord(q)] if now is None else -(gaps[1] if now == gap else gaps[0])
            gap = now
        assert score == pytest.approx(r.score)
        if not local:
            assert (r.aligned1.replace("-", ""), r.aligned2.replace("-", "")) == (a, b)


@pytest.mark.parametrize("local", [True, False])
def test_many_alignments_equal_single_ones(local, monkeypatch):
    rnd, aligner = random.Random(4), A.Aligner(local=local, open_=6, extend=2)
    pairs = [tuple("".join(rnd.choice("ACGTNRY") for _ in range(rnd.choice([0, 1, 7, 30, 31]))) for _ in "ab") for _ in range(60)]
    alone = [aligner.align(a, b) for a, b in pairs]
    for cells in (1, 5000, 1 << 25):
        monkeypatch.setattr(A, "CELLS", cells)
        assert aligner.align_many(pairs) == alone
    assert aligner.align_many([]) == []


def test_gaps_open_on_ties():
    """With equal penalties a new gap in either direction is as good as a longer one; both directions report the short one."""
    aligner = A.Aligner(identity("AB", 2, -9), open_=1, extend=1, local=False)
    for a, b in (("AAB", "A"), ("A", "AAB")):
        r = aligner.align(a, b)
        assert (r.score, r.gaps) == (0, 2)


def test_all_pairs_are_aligned(spark):
    got = sequences.smith_waterman(spark, "/root/testdata/sf0.001").collect()
    assert {(r.i, r.j) for r in got} == {(i, j) for i in range(40) for j in range(i)} and len(got) == 780


def test_known_alignments():
    own = A.Aligner().align("ACGTACGT", "ACGTACGT")
    assert (own.score, own.identity, own.gaps) == (40, 8, 0)
    gap = A.Aligner().align("ACGTACGTACGTAAACCCGGGTTT", "ACGTACGTACGTCCCGGGTTT")
    assert gap.score == 21 * 5 - 22 and gap.gaps == 3


def test_score_tables():
    t = nucleotide()
    assert (t["A", "A"], t["A", "C"], t["A", "R"], t["A", "N"]) == (5, -4, 1, -2)
    # Rows of the published table. Fixed values.
    published = {
        "A": "5 -4 -4 -4 -4 1 1 -4 -4 1 -4 -1 -1 -1 -2 -4", "S": "-4 -4 1 1 -1 -4 -2 -2 -2 -2 -1 -1 -3 -3 -1 -4", "Y": "-4 1 -4 1 -2 -2 -4 -1 -2 -2 -1 -3 -1 -3 -1 1",
        "B": "-4 -1 -1 -1 -1 -3 -3 -1 -1 -3 -1 -2 -2 -2 -1 -1", "N": "-2 -2 -2 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2", "U": "-4 5 -4 -4 -4 1 -4 1 1 -4 -1 -4 -1 -1 -2 5",
    }
    for a, row in published.items():
        assert [t[a, b] for b in "ATGCSWRYKMBVHDNU"] == list(map(float, row.split()))
    assert named("EDNAFULL") == t and named("identity", "protein") == identity()
    for wrong in (("EDNAFULL", "protein"), ("BLOSUM62", "protein"), ("EDNAFULL", "lipid")):
        with pytest.raises(ValueError):
            named(*wrong)
    assert identity("AB")["A", "B"] == 0
    assert parse("# note\n A C\nA 1 -1\nC -1 2\n") == {("A", "A"): 1, ("A", "C"): -1, ("C", "A"): -1, ("C", "C"): 2}
    with pytest.raises(ValueError):
        parse("A C\nA 1\n")


def test_distances_at_their_bounds(spark):
    df = spark.createDataFrame([("AAAA", "ACGT"), ("AAAA", "AAAA"), ("ACGT-", "----A")], "a string, b string")
    got = df.select(A.jukes_cantor_distance(F.col("a"), F.col("b")), A.kimura_distance(F.col("a"), F.col("b")), A.percent_identity_overlap(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 10 and got[1][:3] == (0, 0, 1) and got[2][2] == 0


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text("> one two >x\r\nacg\r\nTT \r\n>b\nAA\n\n>empty\n>last\nGG")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(path)).orderBy("idx").collect()]
    assert got == [(0, "one two >x", "ACGTT"), (1, "b", "AA"), (2, "empty", ""), (3, "last", "GG")]
    fasta.write_fasta(fasta.read_fasta(spark, str(path)).orderBy("idx").coalesce(1), str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert {r.label: r.residues for r in again.collect()} == {x[1]: x[2] for x in got}


def test_matrix_text_files(spark, tmp_path):
    rows = [(i, [((i * 7 + j * 3) % 11) / 11 for j in range(9)]) for i in range(9)]
    df = spark.createDataFrame(rows, "i long, row array<double>").repartition(3)
    matrix.write_text(df, str(tmp_path / "t"))
    text = matrix.read_text(spark, str(tmp_path / "t")).orderBy("i").collect()
    assert [r.row for r in text] == [r for _, r in rows]


def test_point_files(spark):
    text = spark.createDataFrame([("id x y c",), ("1, 2.5 3 7",), ("short",), ("2 1 1 0",)], "value string")
    assert [tuple(r) for r in points.vectors(text, 2, 1, 3).collect()] == [(1, [2.5, 3.0], 7), (2, [1.0, 1.0], 0)]
    xyz = points.points_3d(spark.createDataFrame([("3 1 2 3 4",)], "value string"))
    assert tuple(xyz.first()) == (3, 1, 2, 3, 4)
    assert 'x="1.0"' in points.plot_xml(xyz, [(4, "four")])
    with pytest.raises(ValueError):
        points.plot_xml(xyz, [], most=0)


def test_special_functions():
    assert special.igam(3, 2) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2))
    assert special.igamc(0.5, 9) == pytest.approx(math.erfc(3))
    for a, x in ((0.3, 0.1), (2, 5), (30, 20), (30, 45)):
        assert special.igam(a, x) + special.igamc(a, x) == pytest.approx(1)
    assert special.ibeta(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
    series = lambda n, x: sum((-1) ** m * (x / 2) ** (2 * m + n) / math.factorial(m) / math.factorial(m + n) for m in range(40))
    for n, x in ((0, 0.5), (1, 3.0), (4, 8.0)):
        assert special.bessel_j(n, x) == pytest.approx(series(n, x), abs=1e-10)
    assert special.bessel_y(0, 1.0) == pytest.approx(0.08825696421567698, abs=1e-8)
    for n, x in ((0, 2.0), (1, 5.0)):  # the Wronskian
        assert special.bessel_j(n + 1, x) * special.bessel_y(n, x) - special.bessel_j(n, x) * special.bessel_y(n + 1, x) == pytest.approx(2 / (math.pi * x), abs=1e-7)
    y = special.transform_4d(0.7, 6)
    assert special.igamc(2, y) == pytest.approx(special.igamc(3, 0.7), abs=1e-4)
