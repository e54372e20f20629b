import pytest

from tidegate.errors import TidegateError
from tidegate.lineage.graph import reachable


def test_a_bound_that_cuts_nodes_off_is_an_error(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "source_node_id bigint, target_node_id bigint")
    start = spark.createDataFrame([(1,)], "node_id bigint")
    want = {(2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in reachable(chain, start).collect()} == {tuple(r) for r in reachable(chain, start, most=3).collect()} == want
    with pytest.raises(TidegateError):
        reachable(chain, start, most=2)
