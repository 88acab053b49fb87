"""The toxicity model depends on its rows alone, not on the process that learns it."""

import os
import subprocess
import sys

LEARN = """
import random
from textflow.llm.toxicity_ssk import learn
pick = random.Random(3)
plain = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
rude = ["zwoxer", "quilzap", "vrotzig", "xylwump"]
rows = [(" ".join(pick.choice(plain) for _ in range(30)) + (" " + pick.choice(rude) if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
print(learn(sorted(rows)).weight.tobytes().hex())
"""


def test_two_processes_learn_the_same():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = [subprocess.run([sys.executable, "-c", LEARN], cwd=root, env={**os.environ, "PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True, timeout=300).stdout
           for seed in ("1", "2", "77")]
    assert got[0] and got[0] == got[1] == got[2]
