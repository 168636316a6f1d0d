import pytest

from hazardlens.llm import common, linededup, ngramjoin


@pytest.mark.parametrize("run", [linededup._marks(3), ngramjoin._shared])
def test_operators_without_a_memory_drop_the_last_ones(run):
    common.worker_memory("language", lambda: "a large model")
    list(run(iter([])))
    assert not common._memory
