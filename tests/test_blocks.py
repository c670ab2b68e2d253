"""Operators in blocks against the same ones over whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import catalog as C
from reelgrid.operators import shots as O


@pytest.fixture(scope="module")
def frames(spark):
    rng, rows = np.random.default_rng(3), []
    for run, n in (("a", 120), ("b", 7), (None, 40), ("c", 1)):
        for i in sorted(rng.choice(400, n, replace=False)):
            flat = [1.0, 0.0, 0.0] if rng.random() < 0.6 else [0.0, 1.0, 0.0]
            end = [None, None, "north", "both"][rng.integers(4)]
            rows.append((run, int(i), bool(rng.random() < 0.3), bool(rng.random() < 0.7), None if rng.random() < 0.1 else flat, end, f"f{i}", "labeled" if rng.random() < 0.2 else "unlabeled"))
    ddl = "run_id string, frame_index long, cut boolean, failed boolean, hist array<double>, visible_ends string, frame_id string, label_status string"
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("block", [1, 9, 50, 10_000])
def test_blocks(frames, block):
    clips = frames.withColumn("clip_id", F.col("run_id")).withColumn("seq", F.col("frame_index"))
    cases = {
        "cuts": lambda b: O.scene_cuts(frames.drop("cut"), block=b), "shots": lambda b: O.shots(frames, 4, block=b), "errors": lambda b: O.error_runs(frames, block=b), "abort": lambda b: O.until_abort(frames, 5, block=b),
        "segments": lambda b: O.segments(frames, 10, 2, block=b), "previous": lambda b: C.previous_labeled(clips, block=b), "sticky": lambda b: C.sticky_ends(clips, block=b),
    }
    for name, make in cases.items():
        got, want = make(block), make(None)
        assert got.columns == want.columns, name
        key = lambda r: (r.run_id or "", r.frame_index)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key), name
