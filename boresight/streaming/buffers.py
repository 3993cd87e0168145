"""The feature state of a live record stream: each record with its last records, for the same features as in batch.

Spark keeps for each session what the features need of the past: the last ``size - 1`` records and the state of off-bottom
runs. What comes out is a record with its buffer, so ``operators.features.add_features`` serves the stream unchanged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.operators.features import BUFFER

RUNS_BEFORE, LEAST_RUNS = 4, 2  # fixed values: earlier runs a run is held against, and how many it needs


@dataclass
class Runs:
    """Greatest value of each off-bottom run against the runs before it."""

    top: float | None = None  # of the open run
    open: bool = False
    past: list[float] = field(default_factory=list)
    held: float = 0.0

    def add(self, off: bool, value: float | None) -> float:
        """The overpull known at this record."""
        if not off and self.open:
            if self.top is not None:
                if len(self.past) >= LEAST_RUNS:
                    self.held = max(0.0, self.top - median(self.past))
                self.past = [*self.past, self.top][-RUNS_BEFORE:]
            self.top = None
        elif off and value is not None:
            self.top = value if self.top is None else max(self.top, value)
        self.open = off
        return self.held


def buffered_stream(feed: DataFrame, fields: list[str], kept: list[str], off: str = "off", value: str = "hookload", size: int = BUFFER) -> DataFrame:
    """A streaming ``feed(session, t, ...)`` with ``buffer``, the last ``size`` records' ``fields``, and ``overpull``.

    ``fields`` and ``value`` are doubles, ``kept`` columns pass through. Records of a session are taken in the order of ``t``
    within a micro-batch and as they come between micro-batches, so the source must deliver a session's files in order. A
    micro-batch of a session is held whole: the source's files a trigger bound it. A null ``off`` counts as on bottom.
    """
    wanted = list(dict.fromkeys(["session", "t", *kept]))
    types = {c: feed.schema[c].dataType.simpleString() for c in wanted}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "overpull double", *(f"`__{f}` array<double>" for f in fields)])

    def run(key: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        known = json.loads(store.get[0]) if store.exists else {"last": [], "runs": {}}
        last, runs = known["last"], Runs(**known["runs"])
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable").reset_index(drop=True)
        bare = lambda x: None if pd.isna(x) else float(x)
        records = last + [[bare(x) for x in row] for row in pdf[fields].itertuples(index=False, name=None)]
        out = pdf[wanted].copy()
        out["overpull"] = [runs.add(not pd.isna(o) and bool(o), bare(v)) for o, v in zip(pdf[off], pdf[value])]
        ends = range(len(last) + 1, len(records) + 1)
        for i, f in enumerate(fields):
            column = [r[i] for r in records]
            out[f"__{f}"] = [column[max(0, e - size) : e] for e in ends]
        store.update((json.dumps({"last": records[max(0, len(records) - size + 1) :], "runs": asdict(runs)}),))
        yield out

    passed = feed.select(*dict.fromkeys([*wanted, *fields, off, value]))
    framed = passed.groupBy("session").applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")
    zipped = F.transform(F.arrays_zip(*[f"__{f}" for f in fields]), lambda r: F.struct(*[r[f"__{f}"].alias(f) for f in fields]))
    return framed.select(*wanted, "overpull", zipped.alias("buffer"))
