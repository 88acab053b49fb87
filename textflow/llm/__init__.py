"""Operators of a training-data pipeline: text quality, toxicity, near
duplicates, tokenization, packing, token files, secrets, licences, shared
lines, conversation prefixes and periodic runs.

Nothing else in the library imports this subpackage.  ``QUERIES`` and ``SQL``
in :mod:`textflow.llm.queries` are what the entry module registers.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with their code, so the
# package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TaskCache(dict):
    """A module-level cache that stays behind when code is sent to executors."""

    def __reduce__(self):
        return TaskCache, ()


#: What a Python worker keeps between tasks, by the module that holds it.
KEEPERS = ("_textflow_encoders", "_textflow_margins")


def forget(*keepers: str) -> None:
    """Let go of what this Python worker has kept for other operators' tasks:
    tokenizer units (``pieces.worker_encoder``), words' margins (``toxicity_ssk``)."""
    for name in keepers or KEEPERS:
        kept = sys.modules.get(name)
        if kept is not None:
            kept.__dict__.clear()


def give_back() -> None:
    """Return what a task has freed to the system: a Python worker waits for
    its next task beside the JVM, which may need the memory."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
