"""Residue codes, length buckets and substitution matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The residues in order of their codes, the code of every other byte, the inclusive upper bounds of the
# length buckets, and the BLOSUM matrices as NCBI publishes them (lower triangles, residues in the same order).
ALPHABET = "ARNDCQEGHILKMFPSTWYV"
OTHER = 20
BOUNDS = (48, 64, 80, 96, 112, 128, 144, 160, 176, 192, 208, 224, 240, 256, 288, 320, 352, 384, 416, 448, 480, 512, 576, 640, 704, 768, 832, 896, 960, 1024, 1088, 1152, 1216, 1280, 8000, 2147483646)
LOWER_TRIANGLES = {
    "blosum45": """
 5
-2  7
-1  0  6
-2 -1  2  7
-1 -3 -2 -3 12
-1  1  0  0 -3  6
-1  0  0  2 -3  2  6
 0 -2  0 -1 -3 -2 -2  7
-2  0  1  0 -3  1  0 -2 10
-1 -3 -2 -4 -3 -2 -3 -4 -3  5
-1 -2 -3 -3 -2 -2 -2 -3 -2  2  5
-1  3  0  0 -3  1  1 -2 -1 -3 -3  5
-1 -1 -2 -3 -2  0 -2 -2  0  2  2 -1  6
-2 -2 -2 -4 -2 -4 -3 -3 -2  0  1 -3  0  8
-1 -2 -2 -1 -4 -1  0 -2 -2 -2 -3 -1 -2 -3  9
 1 -1  1  0 -1  0  0  0 -1 -2 -3 -1 -2 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -1 -1  2  5
-2 -2 -4 -4 -5 -2 -3 -2 -3 -2 -2 -2 -2  1 -3 -4 -3 15
-2 -1 -2 -2 -3 -1 -2 -3  2  0  0 -1  0  3 -3 -2 -1  3  8
 0 -2 -3 -3 -1 -3 -3 -3 -3  3  1 -2  1  0 -3 -1  0 -3 -1  5""",
    "blosum50": """
 5
-2  7
-1 -1  7
-2 -2  2  8
-1 -4 -2 -4 13
-1  1  0  0 -3  7
-1  0  0  2 -3  2  6
 0 -3  0 -1 -3 -2 -3  8
-2  0  1 -1 -3  1  0 -2 10
-1 -4 -3 -4 -2 -3 -4 -4 -4  5
-2 -3 -4 -4 -2 -2 -3 -4 -3  2  5
-1  3  0 -1 -3  2  1 -2  0 -3 -3  6
-1 -2 -2 -4 -2  0 -2 -3 -1  2  3 -2  7
-3 -3 -4 -5 -2 -4 -3 -4 -1  0  1 -4  0  8
-1 -3 -2 -1 -4 -1 -1 -2 -2 -3 -4 -1 -3 -4 10
 1 -1  1  0 -1  0 -1  0 -1 -3 -3  0 -2 -3 -1  5
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  2  5
-3 -3 -4 -5 -5 -1 -3 -3 -3 -3 -2 -3 -1  1 -4 -4 -3 15
-2 -1 -2 -3 -3 -1 -2 -3  2 -1 -1 -2  0  4 -3 -2 -2  2  8
 0 -3 -3 -4 -1 -3 -3 -4 -4  4  1 -3  1 -1 -3 -2  0 -3 -1  5""",
    "blosum62": """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4""",
    "blosum80": """
 5
-2  6
-2 -1  6
-2 -2  1  6
-1 -4 -3 -4  9
-1  1  0 -1 -4  6
-1 -1 -1  1 -5  2  6
 0 -3 -1 -2 -4 -2 -3  6
-2  0  0 -2 -4  1  0 -3  8
-2 -3 -4 -4 -2 -3 -4 -5 -4  5
-2 -3 -4 -5 -2 -3 -4 -4 -3  1  4
-1  2  0 -1 -4  1  1 -2 -1 -3 -3  5
-1 -2 -3 -4 -2  0 -2 -4 -2  1  2 -2  6
-3 -4 -4 -4 -3 -4 -4 -4 -2 -1  0 -4  0  6
-1 -2 -3 -2 -4 -2 -2 -3 -3 -4 -3 -1 -3 -4  8
 1 -1  0 -1 -2  0  0 -1 -1 -3 -3 -1 -2 -3 -1  5
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -2 -1 -1 -2 -2  1  5
-3 -4 -4 -6 -3 -3 -4 -4 -3 -3 -2 -4 -2  0 -5 -4 -4 11
-2 -3 -3 -4 -3 -2 -3 -4  2 -2 -2 -3 -2  3 -4 -2 -2  2  7
 0 -3 -4 -4 -1 -3 -3 -4 -4  3  1 -3  1 -1 -3 -2  0 -3 -2  4""",
}
#: Score against any other byte; gap open and gap extend scores that the matrices come with.
LOW = {"blosum45": -5, "blosum50": -5, "blosum62": -4, "blosum80": -6}
GAPS = {"blosum45": (-13, -2), "blosum50": (-13, -2), "blosum62": (-11, -1), "blosum80": (-10, -1)}

#: The code of each byte.
CODES = bytes(ALPHABET.index(chr(b)) if chr(b) in ALPHABET else OTHER for b in range(256))
_LETTERS = bytes(ord(ALPHABET[b]) if b < OTHER else ord("-") for b in range(256))


def encode(residues: str | bytes) -> bytes:
    """Residue codes, one for each byte; case counts, so lower-case letters are `other`."""
    return (residues.encode() if isinstance(residues, str) else residues).translate(CODES)


def decode(codes: bytes) -> str:
    """Letters of codes; `-` for other."""
    return codes.translate(_LETTERS).decode("ascii")


def matrix(name: str) -> np.ndarray:
    """The 21 x 21 matrix of a name; `blosumNN_20` means the same."""
    key = name.removesuffix("_20")
    if key not in LOWER_TRIANGLES:
        raise ValueError(f"unknown matrix {name!r}; known: {', '.join(sorted(LOWER_TRIANGLES))}")
    full = np.full((21, 21), LOW[key], dtype=np.int16)
    for i, row in enumerate(LOWER_TRIANGLES[key].strip().split("\n")):
        full[i, : i + 1] = full[: i + 1, i] = [int(x) for x in row.split()]
    return full


def padded_length(length: Column) -> Column:
    """The length rounded up to a multiple of four, as stored by the original layout and told in statistics."""
    return ((length + 3) - F.pmod(length + 3, F.lit(4))).cast("long")


def length_partition(length: Column) -> Column:
    """Number of the first bucket whose bound is not exceeded."""

    def bucket(n: Column) -> Column:
        case = F.when(n <= BOUNDS[0], 0)
        for i, bound in enumerate(BOUNDS[1:], 1):
            case = case.when(n <= bound, i)
        return case.cast("int")

    # Bound in a lambda, the length is worked out once a row; Catalyst would else paste it into every branch.
    return F.transform(F.array(length), bucket)[0]
