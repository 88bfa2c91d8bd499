"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


def n_bins(m: int, max_bins: int) -> int:
    """Bins in use: never more than there are m-mers."""
    return min(4**m, max_bins)


@dataclass(frozen=True)
class CounterConfig:
    """Parameters of a k-mer counting job; see README for their meaning."""

    k: int = 28
    m: int = 10
    x: int = 3
    max_bins: int = 2048
    use_hash: bool = True
    long_sequences: bool = False
    input_path: str = ""
    output_path: str = ""
    prefix: str = ""
    write: bool = True
    binary: bool = False
    balance: bool = False
    tasks: int = 0
    canonical: bool = True
    uppercase: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.m <= min(self.k, 15):
            raise ValueError("m must lie between 1 and min(k, 15)")
        if self.x < 0 or self.max_bins < 1:
            raise ValueError("x must not be negative and max_bins at least 1")

    @property
    def bins(self) -> int:
        return n_bins(self.m, self.max_bins)

    def output_dir(self, debug: bool = False, root: str = "") -> str:
        """The folder of a job's files; of a debug job below ``root`` and without the kind of sequences."""
        name = f"{self.prefix}k{self.k}_m{self.m}_x{self.x}_b{self.bins}"
        return f"{root}/{name}" if debug else f"{self.output_path}{name}_s{int(self.long_sequences)}"


@dataclass(frozen=True)
class DistanceConfig:
    """Parameters of a multi-sequence distance job."""

    k: int = 20
    m: int = 4
    x: int = 3
    max_bins: int = 2048
    long_sequences: bool = False
    input_path: str = ""
    output_path: str = ""
    write: bool = True
    measure: str = "squared_euclidean"
    normalize: bool = False

    @property
    def bins(self) -> int:
        return n_bins(self.m, self.max_bins)

    def output_dir(self) -> str:
        return f"{self.output_path}k{self.k}_m{self.m}_x{self.x}_b{self.bins}_s{int(self.long_sequences)}"
