"""The sink with commits: one copy of every batch, whatever fails or is run again."""

import json
import os

import pyarrow as pa
import pytest

from tidewell.streaming.committed import DATA, CommittedSink, CommittedWriter, commits, read_committed

SCHEMA = "k long, s string"


def files(at, parts):
    at.mkdir(exist_ok=True)
    for p, rows in enumerate(parts):
        (at / f"{p}.json").write_text("\n".join(json.dumps({"k": k, "s": f"é{k}"}) for k in rows))
        os.utime(at / f"{p}.json", (1_700_000_000 + 10 * p,) * 2)
    return str(at)


def start(spark, src, out, ck, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src).repartition(3)
    q = rows.writeStream.format("committed").options(path=out, **options).option("checkpointLocation", ck).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def held(spark, out):
    return sorted(map(tuple, read_committed(spark, out, SCHEMA).collect()))


def test_batches_appear_once(spark, tmp_path):
    spark.dataSource.register(CommittedSink)
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    files(src, [range(10), range(10, 25)])
    start(spark, str(src), out, str(ck))
    want = [(k, f"é{k}") for k in range(25)]
    assert held(spark, out) == want
    # a crash after the commit, before Spark's own record of it: the last batch runs again
    for name in os.listdir(ck / "commits"):
        if name.strip(".").startswith("1"):
            os.remove(ck / "commits" / name)
    files(src, [range(10), range(10, 25), range(25, 30)])
    start(spark, str(src), out, str(ck))
    want += [(k, f"é{k}") for k in range(25, 30)]
    assert held(spark, out) == want
    assert {r.batch for r in commits(spark, out).collect()} == {0, 1, 2}
    assert len(os.listdir(f"{out}/{DATA}")) == commits(spark, out).count()  # the second run's files are gone
    # another run of the same folder numbers its batches from 0 too
    start(spark, files(tmp_path / "in2", [range(100, 103)]), out, str(tmp_path / "ck2"), run="b")
    assert held(spark, out) == want + [(k, f"é{k}") for k in range(100, 103)]


def test_killed_tasks_and_failed_batches_leave_nothing_to_read(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = lambda *k: pa.RecordBatch.from_pydict({"k": list(k), "s": ["x"] * len(k)}, pa.schema([("k", pa.int64()), ("s", pa.string())]))
    writer = CommittedWriter(out, "")
    lost = writer.write(iter([batch(1, 2)]))  # a task whose answer never came
    good = writer.write(iter([batch(1, 2), batch(3)]))

    def dies():
        yield batch(4)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.commit([good, None, writer.write(iter([]))], 0)
    again = writer.write(iter([batch(1, 2, 3)]))
    writer.commit([again], 0)  # the batch once more
    failed = writer.write(iter([batch(9)]))
    writer.abort([failed, None], 1)
    writer.commit([], 2)  # a batch without rows
    assert sorted(r.k for r in read_committed(spark, out, SCHEMA).collect()) == [1, 2, 3]
    assert {lost.file, good.file} <= set(os.listdir(f"{out}/{DATA}"))
    assert not {again.file, failed.file} & set(os.listdir(f"{out}/{DATA}"))
    assert (good.n_rows, commits(spark, out).count()) == (3, 1)


def test_options_are_checked():
    with pytest.raises(ValueError):
        CommittedSink({"path": "x", "run": "a-b"}).streamWriter(None, False)
    with pytest.raises(ValueError):
        CommittedSink({"path": "x"}).streamWriter(None, True)
