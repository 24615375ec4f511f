"""What a sort is asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Partition policies, by how a bound between two partitions may fall.
KEY, COUNT, SIZE = "key", "count", "size"


@dataclass(frozen=True)
class SortSpec:
    """Ascending total order by ``keys``, then ``tiebreak``; ``values`` are carried along (all other columns if None).

    ``partition``: "key" keeps all rows of a key in one partition, "count" balances rows, "size" balances
    bytes; the latter two split a hot key by the tie-break. ``imbalance`` is how many times an even share
    the first partition gets. ``strict_float_order`` tells -0.0 from 0.0 and puts negative NaN first.
    """

    keys: tuple[str, ...]
    values: tuple[str, ...] | None = None
    tiebreak: tuple[str, ...] = field(default=())
    partition: str = SIZE
    n_partitions: int = 8
    imbalance: float = 1.0
    strict_float_order: bool = False

    def __post_init__(self):
        if not self.keys:
            raise ValueError("a sort needs a key column")
        if self.partition not in (KEY, COUNT, SIZE):
            raise ValueError(f"unknown partition policy {self.partition!r}")
        if self.n_partitions < 1:
            raise ValueError("n_partitions must be at least 1")
