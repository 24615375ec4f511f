"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """A helper column's name for each of ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n = 0
        while (found := f"_{name}_{n}").lower() in taken:
            n += 1
        out.append(found)
    return tuple(out)


def refuse(df: DataFrame, *names: str) -> None:
    """An output column must not take the place of one of the input's."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the input already has a column {', '.join(sorted(clash))}")
