"""Files that grow, shrink, are renamed and replaced while they are read."""

import json
import os

import pytest

from threadlake.sources import growing
from threadlake.streaming import ingest

SCHEMA = "id long, text string"


def line(k, text="x"):
    return json.dumps({"id": k, "text": text}) + "\n"


@pytest.fixture
def reads(spark, tmp_path):
    """Writes files, runs the stream over what is new and gives the ids of all rows so far."""
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(growing.GrowingFiles)

    def run(piece=growing.PIECE):
        query = (
            spark.readStream.format("growing_files").option("pieceBytes", piece).load(str(folder))
            .writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
        )
        query.awaitTermination(120)
        rows = spark.read.schema(growing.SCHEMA).parquet(f"file://{tmp_path}/out").collect()
        return sorted((os.path.basename(r.file), json.loads(r.line)["id"]) for r in rows)

    return folder, run


def test_growth_rotation_and_truncation(reads):
    folder, run = reads
    a = folder / "a.jsonl"
    a.write_text(line(1) + line(2) + '{"id": 3, ')
    assert run() == [("a.jsonl", 1), ("a.jsonl", 2)]  # the line that is still written waits
    with a.open("a") as f:
        f.write('"text": "é"}\n' + line(4))
    (folder / "b.jsonl").write_text(line(10))
    seen = [("a.jsonl", 1), ("a.jsonl", 2), ("a.jsonl", 3), ("a.jsonl", 4), ("b.jsonl", 10)]
    assert run() == seen
    assert run() == seen  # nothing new
    a.rename(folder / "a.1.jsonl")  # rotated: the old file goes on under its new name, the new one begins at 0
    with (folder / "a.1.jsonl").open("a") as f:
        f.write(line(5))
    a.write_text(line(6))
    seen = sorted([*seen, ("a.1.jsonl", 5), ("a.jsonl", 6)])
    assert run() == seen
    with (folder / "b.jsonl").open("r+") as f:  # shorter than before: from the start
        f.truncate(0)
        f.write('{"id": 1}\n')
    assert run() == sorted([*seen, ("b.jsonl", 1)])


def test_pieces_hold_whole_lines(reads):
    folder, run = reads
    (folder / "a.jsonl").write_text("".join(line(k, "long " * (k % 7)) for k in range(200)) + "\n \n" + line(200))
    assert run(piece=50) == [("a.jsonl", k) for k in range(201)]


def test_ranges():
    start = {"a": [1, 10], "b": [2, 20]}
    assert growing.ranges({}, start) == [("a", 1, 0, 10), ("b", 2, 0, 20)]
    assert growing.ranges(start, {"a": [1, 15], "b": [2, 20]}) == [("a", 1, 10, 15)]
    assert growing.ranges(start, {"a": [3, 4], "b": [2, 5], "c": [1, 12]}) == [("a", 3, 0, 4), ("b", 2, 0, 5), ("c", 1, 10, 12)]


def test_last_whole_line(tmp_path):
    path = tmp_path / "f"
    for text, want in (("", 0), ("abc", 0), ("abc\n", 4), ("abc\nde", 4), ("a\n" + "x" * 200_000, 2), ("x" * 200_000 + "\ny", 200_001)):
        path.write_text(text)
        assert growing.whole_lines(str(path), len(text)) == want


def test_follow_appends_each_key_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(line(1) + "no json\n" + line(2) + line(2))

    def run():
        ingest.follow(spark, str(folder), SCHEMA, f"file://{tmp_path}/table", f"file://{tmp_path}/state", ["id"], "id").awaitTermination(120)
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/table").collect())

    assert run() == [1, 2]
    (folder / "a.jsonl").write_text(line(2))  # replaced by a shorter one: read again, and known
    with (folder / "a.jsonl").open("a") as f:
        f.write(line(3))
    assert run() == [1, 2, 3]
