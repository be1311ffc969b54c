"""Score tables for alignments, as (a, b) -> score over symbols.

The nucleotide table with ambiguity letters (NUC.4.4, also known as EDNAFULL) is built in. Any other
table, as those for proteins, is read from a file in the usual text form.
"""

from __future__ import annotations

from pathlib import Path

Scores = dict[tuple[str, str], float]


def identity(symbols: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*", match: float = 1.0, mismatch: float = 0.0) -> Scores:
    return {(a, b): match if a == b else mismatch for a in symbols for b in symbols}


#: The published nucleotide scores, which are symmetric; U scores as T. Fixed values.
NUCLEOTIDE = """
   A  T  G  C  S  W  R  Y  K  M  B  V  H  D  N
A  5
T -4  5
G -4 -4  5
C -4 -4 -4  5
S -4 -4  1  1 -1
W  1  1 -4 -4 -4 -1
R  1 -4  1 -4 -2 -2 -1
Y -4  1 -4  1 -2 -2 -4 -1
K -4  1  1 -4 -2 -2 -2 -2 -1
M  1 -4 -4  1 -2 -2 -2 -2 -4 -1
B -4 -1 -1 -1 -1 -3 -3 -1 -1 -3 -1
V -1 -4 -1 -1 -1 -3 -1 -3 -3 -1 -2 -1
H -1 -1 -4 -1 -3 -1 -3 -1 -3 -1 -2 -2 -1
D -1 -1 -1 -4 -3 -1 -1 -3 -1 -3 -2 -2 -2 -1
N -2 -2 -2 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1
"""


def nucleotide() -> Scores:
    """Scores of the 16 nucleotide letters."""
    head, *rows = (line.split() for line in NUCLEOTIDE.strip().splitlines())
    half = {(a, b): float(v) for a, *values in rows for b, v in zip(head, values)}
    as_t = {"U": "T"}
    letters = [*head, *as_t]
    return {(a, b): half.get((x := as_t.get(a, a), y := as_t.get(b, b)), half.get((y, x))) for a in letters for b in letters}


def named(name: str, molecule: str = "dna", folder: str | None = None) -> Scores:
    """A score table by name: EDNAFULL, IDENTITY, or a file ``folder/name`` in text form, as those of proteins.

    ``molecule`` is dna, rna or protein; nucleotide tables are not for proteins.
    """
    if molecule not in ("dna", "rna", "protein"):
        raise ValueError(f"no molecule type {molecule!r}")
    if name.upper() == "IDENTITY":
        return identity()
    if name.upper() in ("EDNAFULL", "NUC.4.4"):
        if molecule == "protein":
            raise ValueError(f"{name} is a table of nucleotides")
        return nucleotide()
    if folder is None or not (path := Path(folder) / name).is_file():
        raise ValueError(f"no table {name!r}; give the folder that has its file")
    return parse(path.read_text())


def parse(text: str) -> Scores:
    """A table in text: # comments, a header of symbols, then rows of a symbol and its scores."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    head, out = rows[0], {}
    for symbol, *values in rows[1:]:
        if len(values) != len(head):
            raise ValueError(f"row {symbol!r} has {len(values)} scores for {len(head)} symbols")
        out |= {(symbol, b): float(v) for b, v in zip(head, values)}
    return out
