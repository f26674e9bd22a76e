"""Pending changes over a feed of files, run after run from one checkpoint."""

import json

import pytest

from marginalia.streaming import pending, watch


@pytest.fixture()
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in pending.ROCKSDB}
    for k, v in pending.ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Feed:
    def __init__(self, spark, root, shards):
        self.spark, self.root, self.shards, self.n, self.out = spark, root, shards, 0, []
        (root / "feed").mkdir()

    def send(self, *changes):
        """One more file of changes (second, kind, path[, old path]); gives what it makes the stream emit."""
        rows = [{"ts": f"2024-01-01T00:{int(at) // 60:02}:{at % 60:06.3f}Z", "kind": kind, "path": path[0] if path else None, "old_path": path[1] if len(path) > 1 else None} for at, kind, *path in changes]
        (self.root / "feed" / f"{self.n:03}.json").write_text("\n".join(map(json.dumps, rows)))
        self.n += 1
        got = []
        stream = pending.pending_changes(watch.read_changes(self.spark, str(self.root / "feed")), 1000, "0 seconds", self.shards)
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend((r["path"], r["kind"]) for r in df.collect())).option("checkpointLocation", str(self.root / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(got)


@pytest.mark.parametrize("shards", [1, 3])
def test_flush_disable_and_restart(rocks, tmp_path, shards):
    feed = Feed(rocks, tmp_path, shards)
    assert feed.send((0, "create", "a.md"), (0.5, "modify", "a.md"), (0.7, "modify", "b.md"), (0.8, "create", ".x.md")) == []
    assert feed.send((0.9, "flush")) == [("a.md", "modify"), ("b.md", "modify")]  # a new query goes on from the checkpoint
    assert feed.send((5, "modify", "c.md"), (5.1, "rename", "e.md", "d.md"), (5.2, "disable")) == []  # dropped
    assert feed.send((6, "modify", "f.md"), (7, "flush")) == []  # nothing is taken while disabled
    assert feed.send((8, "enable"), (8.1, "create", "g.md"), (8.2, "delete", "g.md"), (8.3, "rename", "i.md", "h.md"), (8.4, "flush")) == [("g.md", "delete"), ("h.md", "delete"), ("i.md", "create")]


def test_a_quiet_gap_ends_a_burst(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, 1)
    assert feed.send((0, "create", "a.md"), (0.9, "modify", "b.md"), (1.8, "modify", "a.md")) == []  # each restarts the timer
    assert feed.send((60, "create", "z.md")) == [("a.md", "modify"), ("b.md", "modify")]
    assert feed.send((61.5, "create", "y.md"), (64, "delete", "y.md"), (64.1, "flush")) == [("y.md", "create"), ("y.md", "delete"), ("z.md", "create")]


@pytest.mark.parametrize("shards", [1, 3])
def test_shards_share_the_timer(rocks, tmp_path, shards):
    paths = [f"{c}.md" for c in "abcdefgh"]
    feed = Feed(rocks, tmp_path, shards)
    burst = [(0.8 * i, "modify", p) for i, p in enumerate(paths)]  # no path is changed twice within a gap, all together never rest
    again = [(6.4 + 0.8 * i, "delete", p) for i, p in enumerate(paths)]
    assert feed.send(*burst, *again, (9.9, "disable"), (10.1, "enable"), (13, "flush")) == [(p, "delete") for p in paths[5:]]
    assert feed.send(*[(20 + at, *x) for at, *x in burst + again], (30, "flush"), (34, "create", "z.md"), (34.1, "flush")) == sorted([(p, "delete") for p in paths[:5]] + [(p, "modify") for p in paths[5:]] + [(p, "delete") for p in paths[5:]] + [("z.md", "create")])
