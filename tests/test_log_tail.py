"""Lines of growing files: each exactly once."""

import os
import tempfile

import pytest

from floodgauge.sources import ids_log, log_tail
from floodgauge.sources.log_tail import LogTailReader, Range, matched, snapshot, tail_lines


class Follower:
    """A query that is started again from its checkpoint for every look at the files."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options
        self.out, self.mark = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")

    def look(self):
        q = (
            tail_lines(self.spark, self.path, **self.options).writeStream.format("json").option("path", self.out)
            .option("checkpointLocation", self.mark).trigger(availableNow=True).start()
        )
        assert q.awaitTermination(120)
        rows = self.spark.read.schema(log_tail.SCHEMA).json(self.out).collect()
        return sorted(r["value"] for r in rows)


def put(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_append_half_line_rotate_truncate_and_replace(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    log = os.path.join(folder, "eve.json")
    follower = Follower(spark, folder + "/eve*", splitBytes=7)
    assert follower.look() == []
    put(log, "first line\nsecond line\nhalf")
    assert follower.look() == ["first line", "second line"]
    assert follower.look() == ["first line", "second line"]
    put(log, " of a line\n\n   \nlast before rotation\nwaits")
    want = sorted(["first line", "second line", "half of a line", "", "   ", "last before rotation"])
    assert follower.look() == want
    os.rename(log, log + ".1")
    put(log + ".1", " until it ends\n")  # written by a process that still has the old file open
    put(log, "new file\r\n")
    want = sorted([*want, "waits until it ends", "new file"])
    assert follower.look() == want
    put(log, "after truncation, longer than what stood there before\n", "w")
    put(os.path.join(folder, "other.log"), "not asked for\n")
    want = sorted([*want, "after truncation, longer than what stood there before"])
    assert follower.look() == want
    put(log, "x\n", "w")
    put(log + ".2", "a third\nfile\n")
    assert follower.look() == sorted([*want, "x", "a third", "file"])


def test_latest_and_bad_lines(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    log = os.path.join(folder, "eve.json")
    put(log, '{"event_type": "flow"}\n')
    follower = Follower(spark, log, startingPosition="latest")
    assert follower.look() == []
    put(log, '{"event_type": "alert"}\n{"event_type": "fl\n')
    assert follower.look() == ['{"event_type": "alert"}', '{"event_type": "fl']
    lines = spark.read.schema(log_tail.SCHEMA).json(follower.out)
    parsed = ids_log.parse_lines(lines)
    assert [r["line"] for r in ids_log.quarantine(parsed).collect()] == ['{"event_type": "fl']
    assert [r["event_type"] for r in ids_log.valid_events(parsed).collect()] == ["alert"]


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
def test_ranges_give_every_line_once(monkeypatch, block):
    monkeypatch.setattr(log_tail, "BLOCK", block)
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "log")
    lines = ["", "a", "bb" * 20, "", "ccc", "ünï" * 9, "d" * 50, "e"]
    put(path, "\n".join(lines) + "\nopen")
    end = snapshot(path)
    assert end[path]["end"] == len(("\n".join(lines) + "\n").encode())
    for split in (1, 2, 5, 33, 1000):
        reader = LogTailReader({"path": path, "splitBytes": split})
        found = [v for p in reader.partitions({"files": {}}, {"files": end}) for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert found == lines


def test_files_are_known_by_their_beginning():
    was = {"p": {"head": "aa11", "end": 10}, "p.1": {"head": "bb22", "end": 20}}
    now = {"p": {"head": "cc", "end": 5}, "p.1": {"head": "aa1133", "end": 12}, "p.2": {"head": "bb22", "end": 20}}
    assert dict(matched(was, now)) == {"p": 0, "p.1": 10, "p.2": 20}
    assert dict(matched(was, {"p": {"head": "aa11", "end": 4}})) == {"p": 0}


def test_lines_lost_before_they_were_read_are_an_error():
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "log")
    put(path, "one\n")
    with pytest.raises(FileNotFoundError):
        list(LogTailReader({"path": path}).read(Range(path, "00", 0, 4)))
    os.rename(path, path + "x")
    rows = [b.to_pylist() for b in LogTailReader({"path": path + "*"}).read(Range(path, b"one\n".hex(), 0, 4))]
    assert rows == [[{"file": path + "x", "position": 0, "value": "one"}]]
