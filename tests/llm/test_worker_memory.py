"""What a Python worker still holds after the pieces' tasks, when other stages run in it."""

import subprocess
import sys
from pathlib import Path

CODE = """
import random, re
import pyarrow as pa
from strideframe.llm import piece_fst

class Docs:
    select = lambda self, *columns: self
    mapInArrow = lambda self, work, schema: work

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(rng):
    for _ in range(2):
        texts = [" ".join("".join(rng.choices("aeinrst0123456789", k=9)) for _ in range(100)) for _ in range(2_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

work = piece_fst.piece_report(Docs(), with_pieces=True)
before = held()
n = sum(out.num_rows for seed in range(2) for out in work(batches(random.Random(seed))))
print(n, held() - before)
"""


def test_a_worker_gives_memory_back():
    """800,000 different stretches went through; the machine's tables and a bounded cache stay."""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, timeout=300, check=True).stdout
    n, mb = out.split()
    assert int(n) == 8_000 and float(mb) < 200
