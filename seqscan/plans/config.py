"""What a search is run with."""

from __future__ import annotations

from dataclasses import dataclass, fields

from seqscan.functions import residues

KERNELS = ("half2", "dpxs16", "dpxs32", "float")
ALLOWED = {"single_pass": KERNELS, "many_pass_small": ("half2", "dpxs16"), "many_pass_large": ("float", "dpxs32"), "overflow": ("float", "dpxs32")}
# Scores from which the two 16-bit kernels count an overflow.
THRESHOLDS = {"half2": 2048, "dpxs16": 25000}


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of a search; gap scores default to those of the matrix.

    The kernel types do not change any score, as scores are exact here; they say which subjects count as overflows:
    those in the buckets that a 16-bit kernel checks and with a score at its threshold or above.
    """

    top: int = 10
    matrix: str = "blosum62"
    gop: int | None = None
    gex: int | None = None
    single_pass: str = "half2"
    many_pass_small: str = "half2"
    many_pass_large: str = "float"
    overflow: str = "float"

    def __post_init__(self):
        if self.top < 0:
            raise ValueError("top must not be negative")
        residues.matrix(self.matrix)
        for gap in (self.gop, self.gex):
            if gap is not None and gap >= 0:
                raise ValueError("gap scores are negative numbers")
        for name, allowed in ALLOWED.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    @classmethod
    def dpx(cls, **rest) -> SearchConfig:
        """With all four kernel types of the integer kind."""
        return cls(single_pass="dpxs16", many_pass_small="dpxs16", many_pass_large="dpxs32", overflow="dpxs32", **rest)

    @property
    def gaps(self) -> tuple[int, int]:
        gop, gex = residues.GAPS[self.matrix.removesuffix("_20")]
        return self.gop if self.gop is not None else gop, self.gex if self.gex is not None else gex

    @property
    def overflow_rules(self) -> list[tuple[int, int, int]]:
        """(bucket from, bucket to, threshold) in which overflows are counted."""
        rules = [(34, 34, THRESHOLDS[self.many_pass_small])]
        if self.single_pass in THRESHOLDS:
            rules.append((13, 33, THRESHOLDS[self.single_pass]))
        return rules

    def explain(self) -> str:
        gop, gex = self.gaps
        return "\n".join([*(f"{f.name}: {getattr(self, f.name)}" for f in fields(self) if f.name not in ("gop", "gex")), f"gop: {gop}", f"gex: {gex}"])


def parse_size(text: str) -> int:
    """`123` with an optional K, M or G (powers of 1024); an empty text is 0."""
    if not text:
        return 0
    factor = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(text[-1])
    return int(text[:-1] or 0) * factor if factor else int(text)
