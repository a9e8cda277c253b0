"""Bootstrap kernels: one pass over the draws, no arrays beside the rows, the same draws in blocks of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from pollmirror.operators import resample as B
from pollmirror.operators import statistics as S

CELLS = "run_id string, key string, jsd double, tau double, model_refusal_rate double, human_refusal_rate double, parity double"


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 2}", f"k{i:03}", *map(float, rng.random(5))) for i in range(80)]
    return spark.createDataFrame([*rows, ("r0", "none", None, None, None, None, None), *[("few", f"k{i}", 0.1, 0.2, 0.3, 0.4, 0.5) for i in range(3)]], CELLS)


def kernels(df):
    """The kernels of a plan, each with the types of the rows it is handed."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if "FlatMapGroupsIn" in node.nodeName():
            found.append(T._parse_datatype_json_string(node.child().schema().json()))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_replicates_of_run_ci_are_drawn_once(cells):
    found = kernels(B.run_ci(cells, resamples=50))
    assert len(found) == 1 and not any(isinstance(f.dataType, (T.ArrayType, T.StructType)) for f in found[0])


def test_run_ci_equals_the_plain_steps(cells):
    got = {(r.run_id, r.metric): r for r in B.run_ci(cells, resamples=200).collect()}
    assert {k[0] for k in got} == {"r0", "r1"} and len(got) == 8
    x = np.array([r.parity for r in cells.where("run_id = 'r1'").orderBy("key").collect()])
    r = got["r1", "sps"]
    own = np.random.default_rng(B._number(42, "r1", "sps", 0, "rows"))
    means = np.sort([x[own.integers(0, len(x), len(x))].mean() for _ in range(200)])
    assert r.n == len(x) and means[0] <= r.ci_lower < x.mean() < r.ci_upper <= means[-1]
    assert min(abs(means - r.ci_lower)) < 1e-12 and min(abs(means - r.ci_upper)) < 1e-12


def test_kernels_of_large_groups_are_handed_no_null_arrays(cells):
    for name, columns in {"mean": ["parity"], "median": ["jsd"], "correlation": ["jsd", "tau"]}.items():
        handed = kernels(S.statistic_ci(cells, ["run_id"], "key", columns, name, resamples=20, chunk_rows=10))
        arrays = [f.name for k in handed for f in k if isinstance(f.dataType, (T.ArrayType, T.StructType))]
        assert len(handed) >= 3 and set(arrays) == {"state"}  # the states themselves, never null


@pytest.mark.parametrize("rows", [50, 2500])
def test_weights_of_a_sample_do_not_depend_on_the_others(rows):
    rng, drawn = np.random.default_rng(5), np.array([rows, 3, 0, 2 * rows])
    at = np.repeat(np.arange(4), drawn) * rows + rng.integers(0, rows, int(drawn.sum()))
    want = np.bincount(at, minlength=4 * rows).reshape(4, rows)
    assert (S.draw_weights(np.random.default_rng(5), rows, drawn) == want).all()


def test_states_of_blocks_are_those_of_their_rows():
    rng = np.random.default_rng(6)
    rows, block = rng.random((300, 2)), rng.integers(0, 40, 300)
    for name in ("correlation", "tau"):
        stat, frame = S.STATISTICS[name], {"centre": rows.mean(axis=0), "edges": [np.array([0.3, 0.6])] * 2}
        want = [stat.state(rows[block == j], np.ones((1, int((block == j).sum()))), frame)[0] for j in range(40)]
        assert np.allclose(S._block_states(stat, rows, block, 40, frame), want)
