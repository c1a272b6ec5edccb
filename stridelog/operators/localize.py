"""The earliest visible breaking step of each run, its cascade, and how sure it is.

Only runs with a failure (few, by experience) are looked at. Links of a recorded run lead
forward, so one ordered pass settles it: a step's breaking step is the smallest over
itself, its parent and the files it touches, and all steps of one breaking step form a
part of the graph of their own, which holds every path between them. The same pass
therefore keeps each step's place on the shortest path: by parent, or by the best
producer so far of a file within that part. A run is streamed in step order, never
brought together in one row; what stays in memory are some numbers for each step that a
failure reaches.

Runs that were not renumbered may link backward or in circles, or repeat a step. The pass only
notes these; ``levels`` settles them by joins, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import gates, graph, levels

LOCALIZATIONS = "run_id string, breaking_step int, breaking_gate string, cascade array<int>, confidence string, coverage string, candidates array<int>"
_NAMES = [c.split()[0] for c in LOCALIZATIONS.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(pa.int32())]
#: Rows of results that a task holds before it hands them on.
AT_ONCE = 2_000


class Pass:
    """One run, step by step in ascending order. Only steps that a failure reaches are kept."""

    def __init__(self):
        self.forward, self.last = True, None
        self.at: dict[int, int] = {}
        self.step, self.label, self.far, self.before, self.gate = [], [], [], [], []
        self.opaque, self.unlinked, self.targets, self.guessed = [], [], [], []
        self.least: dict[str, int] = {}
        self.best: dict[tuple[str, int], int] = {}
        self.base_made: dict[int, set[str]] = {}

    def nearer(self, a: int, b: int) -> bool:
        """Is the path to ``a`` shorter than that to ``b``, or as long and smaller?"""
        if self.far[a] != self.far[b]:
            return self.far[a] < self.far[b]
        while a != b and self.before[a] != self.before[b]:
            a, b = self.before[a], self.before[b]
        return self.step[a] < self.step[b]

    def add(self, step: int, kind: str, parent: int | None, gate: str | None, targets: bool, refs: list[dict]) -> None:
        self.forward = self.forward and step != self.last and (parent is None or parent < step)
        self.last = step
        if not self.forward:
            return
        above = self.at.get(parent)
        labels = [step] if gate is not None else []
        if above is not None:
            labels.append(self.label[above])
        labels += [self.least[r["file"]] for r in refs if r["file"] in self.least]
        if not labels:
            return
        label, own, via = min(labels), len(self.step), -1
        if label != step:
            if above is not None and self.label[above] == label:
                via = above
            for r in refs:
                maker = self.best.get((r["file"], label), -1)
                if maker >= 0 and maker != via and (via < 0 or self.nearer(maker, via)):
                    via = maker
        self.at[step] = own
        self.step.append(step), self.label.append(label), self.before.append(via), self.gate.append(gate)
        self.far.append(self.far[via] + 1 if via >= 0 else 0)
        self.opaque.append(kind in ("opaque_shell", "unmapped")), self.unlinked.append(parent is None), self.targets.append(targets)
        stands = via < 0 or via == above or any(r["base"] and r["file"] in self.base_made.get(via, ()) for r in refs)
        self.guessed.append(not stands)
        for r in refs:
            f = r["file"]
            if r["produces"]:
                self.least[f] = min(label, self.least.get(f, label))
                if (f, label) not in self.best or self.nearer(own, self.best[f, label]):
                    self.best[f, label] = own
            if r["base_produces"]:
                self.base_made.setdefault(own, set()).add(f)

    def results(self, run_id: str) -> Iterator[tuple]:
        if not self.forward:
            yield run_id, None, None, None, None, None, None
            return
        groups: dict[int, tuple] = {}
        on_path = [False] * len(self.step)
        for i, gate in enumerate(self.gate):
            if gate is not None:
                group = groups.setdefault(self.label[i], ([], [0, 0, 0, 0], set(), gate))
                if self.before[i] >= 0:
                    group[0].append(self.step[i])
                    on_path[i] = True
        for i in range(len(self.step) - 1, -1, -1):
            if on_path[i] and self.before[i] >= 0:
                on_path[self.before[i]] = True
        for i in [i for i, on in enumerate(on_path) if on]:
            _, seen, candidates, _ = groups[self.label[i]]
            via = self.before[i]
            unlinked, guessed = via >= 0 and self.unlinked[i], via >= 0 and self.guessed[i]
            seen[0 if self.targets[i] else 1] += self.opaque[i]
            seen[2] += unlinked
            seen[3] += guessed
            if self.opaque[i] or unlinked:
                candidates.add(self.step[i])
            if guessed:
                candidates.update(self.step[x] for x in (via, i) if self.targets[x])
        for label in sorted(groups):
            cascade, seen, candidates, gate = groups[label]
            notes = [f"{n} {noun}{'' if n == 1 else 's'}" for n, noun in zip(seen, levels.NOTES) if n]
            yield run_id, label, gate, cascade, "LOW" if notes else "HIGH", levels.joined(notes), sorted(candidates)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], _NAMES)


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LOCALIZATIONS of runs whose steps come in order; a run that is not forward is one row of nulls."""
    own, run, found = None, Pass(), []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("run_id", "step_index", "kind", "parent_step", "gate", "targets", "refs")]
        for run_id, *step in zip(*columns):
            if run_id != own:
                if own is not None:
                    found += run.results(own)
                own, run = run_id, Pass()
            run.add(*step)
        if len(found) >= AT_ONCE:
            yield _rows(found)
            found = []
    if own is not None:
        found += run.results(own)
    if found:
        yield _rows(found)


def step_rows(activities: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """run_id, pos, step_index, kind, parent_step, gate, targets, refs for all steps of runs that have a failure."""
    failing = materialize(gates.failures(gates.gate_results(activities) if results is None else results))
    dirty = failing.select("run_id").distinct()
    rows = graph.with_refs(activities.join(dirty, "run_id", "left_semi")).join(failing, ["run_id", "step_index"], "left")
    return rows.select("run_id", "pos", "step_index", "kind", "parent_step", "gate", F.col("shell").isNotNull().alias("targets"), "refs")


def localize(activities: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """A row per breaking step: run_id, breaking_step, breaking_gate, cascade, confidence, coverage, candidates."""
    rows = step_rows(activities, results)
    passed = materialize(rows.drop("pos").repartition("run_id").sortWithinPartitions("run_id", "step_index").mapInArrow(ordered, LOCALIZATIONS))
    out, left = passed.where("breaking_step IS NOT NULL"), passed.where("breaking_step IS NULL").select("run_id")
    return out if left.isEmpty() else out.unionByName(levels.localize(rows.join(left, "run_id", "left_semi")))


def breaks(activities: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Exploded: run_id, step_index, breaking_step for each failing step."""
    found = localize(activities, results)
    return found.select("run_id", "breaking_step", F.explode(F.concat(F.array("breaking_step"), "cascade")).alias("step_index"))
