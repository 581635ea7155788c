"""What Python workers keep after a task."""

import re
import subprocess
import sys
import zlib

from ordinale.llm import toxicity, workers
from ordinale.llm.storage import cut, discard

KEPT = """
import re, pyarrow as pa
from ordinale.llm import workers
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
def run(batches):
    for b in batches:
        small = [str(i) * 20 for i in range(400_000)]
        pin = small[::4000]
        large = pa.array(small)
        del small
        yield b
        del large
first = held()
for _ in FORM(run)(iter([1, 2])):
    pass
print(held() - first)
"""


def kept(form):
    out = subprocess.run([sys.executable, "-c", KEPT.replace("FORM", form)], capture_output=True, text=True, check=True)
    return int(out.stdout)


def test_a_task_gives_back_what_it_freed():
    if workers._trim is None:
        return
    plain, tidy = kept("(lambda r: r)"), kept("workers.tidy")
    assert tidy < plain - 20, (plain, tidy)


def test_rows_and_errors_pass_through():
    assert list(workers.tidy(lambda b: (x + 1 for x in b))(iter([1, 2]))) == [2, 3]
    try:
        list(workers.tidy(lambda b: (1 / x for x in b))(iter([0])))
    except ZeroDivisionError as e:
        assert re.search("zero", str(e))
    else:
        raise AssertionError("no error")


def test_learning_takes_one_worker_a_task(spark, documents, prose, monkeypatch):
    """A second Python node in a task, or rows made from a list, would take workers of their own, and those stay."""
    kind = type(spark.range(0))
    plain, inputs = kind.mapInArrow, []

    def seen(self, *args, **more):
        inputs.append(self._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, *args, **more)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 4 != 2][:9000]
    toxic = ids[::15]
    extra = dict.fromkeys(toxic, " vilething") | dict.fromkeys(toxic[100:105], " rarething")
    docs = cut(documents([(i, prose(i, 8) + extra.get(i, "")) for i in ids]))
    labels = cut(spark.createDataFrame([(i, 0, int(i in extra)) for i in ids], "doc_id long, quality int, toxic int"))
    model = toxicity.learn(docs, labels)
    discard(docs, labels)
    assert " rarething " in model.lexicon and len(inputs) == 3
    assert not any("MapInArrow" in p or "LogicalRDD" in p for p in inputs), inputs
