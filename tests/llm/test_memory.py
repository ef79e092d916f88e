"""Workers give memory back: those that stay between tasks don't hold what earlier work needed."""

import pathlib
import subprocess
import sys

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from ossicle.llm import simhash, suffix

REPO = pathlib.Path(__file__).resolve().parents[2]
#: In a process of its own, as allocators keep what any test before has freed.
WORK = """
import random, re
import public_tokenizers
import pyarrow as pa
from ossicle.llm import simhash, tokens
from ossicle.llm.work import give_back, lean

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
words = [str(rng.random()) for _ in range(50_000)]

def rows():
    for _ in range(8):
        texts = [" ".join(rng.choices(words, k=4000)).encode() for _ in range(100)]
        ids = pa.array(range(100), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts, pa.binary())], ["doc_id", "doc", "tag", "data"])

PATH = public_tokenizers.path("byte_bpe_50k.json")
for batch in rows():
    for _ in tokens.encoded(batch.column(3).slice(0, 20), PATH):
        pass
del batch, _
n = sum(x.num_rows for x in RUN(rows()))
after, encoders = held(), len(tokens._encoders)
tokens.forget()
give_back()
print(n, encoders, after - held())
"""


def measured(run):
    out = subprocess.run([sys.executable, "-c", WORK.replace("RUN", run)], cwd=REPO, capture_output=True, text=True, timeout=300, check=True)
    n, encoders, mb = out.stdout.split()
    return int(n), int(encoders), float(mb)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_its_memory_back():
    n, encoders, mb = measured("lean(simhash._sketched(5))")
    assert (n, encoders) == (800, 0) and mb < 10
    n, encoders, mb = measured("simhash._sketched(5)")
    assert (n, encoders) == (800, 1) and mb > 25  # what a worker kept without it


@pytest.mark.parametrize("operator", [simhash.deduplicated, suffix.deduplicated])
def test_all_tasks_of_the_operators_that_follow_encoding_do(spark, monkeypatch, operator):
    given = []
    for kind, name in ((DataFrame, "mapInArrow"), (PandasGroupedOpsMixin, "applyInArrow")):
        monkeypatch.setattr(kind, name, lambda self, run, *a, f=getattr(kind, name), **b: given.append(run.__qualname__) or f(self, run, *a, **b))
    texts = [f"{i // 2} " + " ".join(str(j * (1 + i // 2)) for j in range(60)) for i in range(8)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert operator(docs).count() > 0
    assert len(given) > 3 and {x.split(".")[0] for x in given} <= {"lean", "lean_group"}
