"""Memory that tasks leave behind in their worker."""

import gc

import numpy as np

from vellum.llm.common import release_memory


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_freed_memory_goes_back_to_the_system():
    """Many small arrays, of which a few live on between those that are freed."""
    arrays = [np.ones(190) for _ in range(100_000)]
    kept = arrays[::200]
    del arrays
    gc.collect()
    before = resident_mb()
    release_memory()
    assert before - resident_mb() > 50 and len(kept) == 500
