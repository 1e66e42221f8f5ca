"""What tasks hold at once, and what their processes hold after them."""

import random
import tracemalloc

import numpy as np

from pennyweight.llm import suffixes
from pennyweight.llm.blocks import Block
from pennyweight.llm.common import release
from pennyweight.llm.encoding import default_vocabulary, encoder

from .test_operators import ROWS, SCHEMA


def test_a_block_is_cut_and_decoded_by_one_process(spark):
    plan = suffixes.dedup_text(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert "MapInArrow" not in above and "Project" in above


def test_units_of_a_block_need_little_memory_beside_it():
    body = np.frombuffer(random.Random(5).randbytes(6 << 20), np.uint8)
    tracemalloc.start()
    try:
        suffixes.Units(Block(0, np.arange(1), np.array([0, len(body)]), body, None), 50, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * len(body)


def test_tables_of_the_encoder_go_when_another_operator_runs():
    first = encoder(default_vocabulary())
    release(forget=False)
    assert encoder(default_vocabulary()) is first
    release()
    assert encoder(default_vocabulary()) is not first
