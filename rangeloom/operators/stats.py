"""Statistics of a sort, and how they are shown."""

from __future__ import annotations

from dataclasses import dataclass


def _spread(xs: list) -> tuple[float, float, float, float]:
    if not xs:
        return 0.0, 0.0, 0.0, 1.0
    mean = sum(xs) / len(xs)
    return min(xs), mean, max(xs), max(xs) / mean if mean else 1.0


@dataclass(frozen=True)
class RunGenerationStats:
    """Runs as (number, rows, bytes)."""

    runs: list[tuple[int, int, int]]
    seconds: float

    @property
    def rows(self) -> int:
        return sum(r[1] for r in self.runs)


@dataclass(frozen=True)
class MergeStats:
    """Partitions as (rows, bytes)."""

    runs_in: int
    partitions: list[tuple[int, int]]
    seconds: float

    @property
    def rows(self) -> int:
        return sum(p[0] for p in self.partitions)

    def imbalance(self) -> dict[str, float]:
        """Greatest over mean, of rows and of bytes."""
        return {"rows": _spread([p[0] for p in self.partitions])[3], "bytes": _spread([p[1] for p in self.partitions])[3]}


@dataclass(frozen=True)
class IoStats:
    """Bytes and records of a stage or run, as Spark's task metrics have them."""

    read_bytes: int = 0
    read_records: int = 0
    write_bytes: int = 0
    write_records: int = 0
    spill_bytes: int = 0

    def __add__(self, other: IoStats) -> IoStats:
        return IoStats(*(getattr(self, f) + getattr(other, f) for f in ("read_bytes", "read_records", "write_bytes", "write_records", "spill_bytes")))


@dataclass(frozen=True)
class SortStats:
    run_generation: RunGenerationStats
    merges: list[MergeStats]
    run_generation_io: IoStats | None = None
    merge_io: IoStats | None = None

    @property
    def seconds(self) -> float:
        return self.run_generation.seconds + sum(m.seconds for m in self.merges)

    def read_amplification(self) -> float | None:
        """Bytes the merges read over bytes the run generation wrote."""
        if not (self.run_generation_io and self.merge_io and self.run_generation_io.write_bytes):
            return None
        return self.merge_io.read_bytes / self.run_generation_io.write_bytes

    def __str__(self) -> str:
        g = self.run_generation
        lines = [f"Run generation: {len(g.runs)} runs, {g.rows:,} rows, {human_bytes(sum(r[2] for r in g.runs))}, {g.seconds:.2f} s"]
        for k, m in enumerate(self.merges, 1):
            low, mean, high, ratio = _spread([p[0] for p in m.partitions])
            lines.append(f"Merge {k}: {m.runs_in} runs into {len(m.partitions)} partitions, {m.rows:,} rows, {m.seconds:.2f} s")
            lines.append(f"  rows per partition: min {low:,.0f}, mean {mean:,.1f}, max {high:,.0f}, max/mean {ratio:.2f}; bytes max/mean {m.imbalance()['bytes']:.2f}")
        if (x := self.read_amplification()) is not None:
            lines.append(f"Read amplification: {x:.2f}")
        return "\n".join(lines)


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def throughput(rows: int, n_bytes: float, seconds: float) -> str:
    return f"{rows / seconds / 1e6:.2f} M rows/s, {human_bytes(n_bytes / seconds)}/s" if seconds > 0 else "n/a"


def io_by_stage(spark) -> dict[int, IoStats]:
    """Read, written and spilled bytes of every stage so far, from the session's own status store."""
    jvm, out = spark._jvm, {}
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    for k in range(stages.size()):
        s = stages.apply(k)
        seen = IoStats(s.inputBytes() + s.shuffleReadBytes(), s.inputRecords() + s.shuffleReadRecords(), s.outputBytes() + s.shuffleWriteBytes(), s.outputRecords() + s.shuffleWriteRecords(), s.diskBytesSpilled())
        out[s.stageId()] = out.get(s.stageId(), IoStats()) + seen
    return out


def io_since(spark, before: dict[int, IoStats]) -> IoStats:
    """Sum over the stages that weren't in ``before``."""
    return sum((io for k, io in io_by_stage(spark).items() if k not in before), IoStats())


def summary_table(runs: list[tuple[str, SortStats]]) -> str:
    """Fixed-width table of several configurations."""
    head = f"{'config':<24}{'runs':>8}{'rows':>14}{'run-gen s':>11}{'merge s':>10}{'total s':>10}{'M rows/s':>10}{'max/mean':>10}"
    out = [head, "-" * len(head)]
    for name, s in runs:
        merge = sum(m.seconds for m in s.merges)
        ratio = max((m.imbalance()["rows"] for m in s.merges), default=1.0)
        out.append(f"{name:<24}{len(s.run_generation.runs):>8}{s.run_generation.rows:>14,}{s.run_generation.seconds:>11.2f}{merge:>10.2f}{s.seconds:>10.2f}{s.run_generation.rows / max(s.seconds, 1e-9) / 1e6:>10.2f}{ratio:>10.2f}")
    return "\n".join(out)


def _table(head: list[str], rows: list[list[str]]) -> str:
    widths = [max(len(r[k]) for r in [head, *rows]) + 2 for k in range(len(head))]
    line = lambda r: "".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(r, widths, strict=True)))
    return "\n".join([line(head), "-" * sum(widths), *map(line, rows)])


def run_generation_table(runs: list[tuple[str, SortStats]]) -> str:
    """Runs of each configuration: number, rows and bytes of the least, mean and largest."""
    rows = []
    for name, s in runs:
        g = s.run_generation
        low, mean, high, _ = _spread([r[1] for r in g.runs])
        rows.append([name, f"{len(g.runs):,}", f"{g.rows:,}", f"{low:,.0f}", f"{mean:,.1f}", f"{high:,.0f}", human_bytes(sum(r[2] for r in g.runs)), f"{g.seconds:.2f}"])
    return _table(["config", "runs", "rows", "least", "mean", "largest", "bytes", "s"], rows)


def merge_table(runs: list[tuple[str, SortStats]]) -> str:
    """A row for each merge of each configuration."""
    rows = []
    for name, s in runs:
        for k, m in enumerate(s.merges, 1):
            even = m.imbalance()
            rows.append([name, str(k), f"{m.runs_in:,}", f"{len(m.partitions):,}", f"{m.rows:,}", f"{even['rows']:.2f}", f"{even['bytes']:.2f}", f"{m.seconds:.2f}"])
    return _table(["config", "merge", "runs in", "partitions", "rows", "rows max/mean", "bytes max/mean", "s"], rows)


def io_table(runs: list[tuple[str, SortStats]]) -> str:
    """Bytes and records read, written and spilled by each phase that was measured."""
    rows = []
    for name, s in runs:
        for phase, io in (("run generation", s.run_generation_io), ("merge", s.merge_io)):
            if io:
                rows.append([name, phase, human_bytes(io.read_bytes), f"{io.read_records:,}", human_bytes(io.write_bytes), f"{io.write_records:,}", human_bytes(io.spill_bytes)])
    return _table(["config", "phase", "read", "records", "written", "records", "spilled"], rows)
