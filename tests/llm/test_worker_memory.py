"""What a Python worker keeps between tasks, and what it lets go."""

import re
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from textflow.llm import KEEPERS, forget
from textflow.llm.pieces import Encoder, worker_encoder


@pytest.fixture
def keepers(monkeypatch):
    for name in KEEPERS:
        monkeypatch.setitem(sys.modules, name, SimpleNamespace(a=1))
    return [sys.modules[name].__dict__ for name in KEEPERS]


def test_an_encoder_takes_the_place_of_margins(keepers):
    encoders, margins = keepers
    assert worker_encoder("k", lambda: Encoder(None)) is encoders["k"]
    assert not margins and list(encoders) == ["k"]


def test_others_are_forgotten_by_name_or_all(keepers):
    encoders, margins = keepers
    forget("_textflow_encoders")
    assert not encoders and margins == {"a": 1}
    forget()
    assert not margins


def _anonymous_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024


def test_an_encoder_keeps_little_beside_its_units():
    coder = Encoder(lambda units: (np.arange(len(units)), np.ones(len(units), np.int64)))
    rng = np.random.default_rng(1)
    began = _anonymous_mb()
    for _ in range(20):
        words = rng.integers(0, 50_000, 180_000)
        column = pa.array([" ".join(map(str, words[i:i + 1000])) for i in range(0, len(words), 1000)], pa.string())
        assert sum(len(ids) for _, found in coder.texts(column) for ids in found) == len(words)
    assert len(coder.number) <= 100_001 and _anonymous_mb() - began < 60
