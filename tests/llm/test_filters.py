import numpy as np
import pytest

from netquarry.llm.cuckoo import Cuckoo
from netquarry.llm.fuse import BinaryFuse

SIZES = (0, 1, 2, 5, 100, 5000)


@pytest.mark.parametrize("n", SIZES)
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64)
    made = BinaryFuse.from_bytes(BinaryFuse.build(np.concatenate([keys, keys])).to_bytes())
    assert made.contains(keys).all()
    assert made.contains(others).mean() < 0.02


@pytest.mark.parametrize("n", SIZES)
def test_cuckoo_takes_back(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64)
    made = Cuckoo.build(keys)
    assert made.contains(keys).all() and made.contains(others).mean() < 0.01
    made.delete(keys[: n // 2])
    assert made.contains(keys[n // 2 :]).all()
    again = Cuckoo.from_bytes(made.to_bytes())
    again.delete(keys[n // 2 :])
    assert not again.table.any()
    if n:
        with pytest.raises(KeyError):
            again.delete(keys[:1])
