"""Devices that sync through a stream which stops and starts again."""

import json
import random

import pytest

from tessera.streaming.sync import REQUEST, STATE, apply_requests, progress_at, sync_batch, sync_stream


class Cloud:
    """A folder of requests and the stream that reads them; every sync is a run of its own from the checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def sync(self, *requests):
        for r in requests:
            self.n += 1
            (self.folder / "in" / f"{self.n:04}.json").write_text(json.dumps({"seq": self.n, **r}))
        stream = self.spark.readStream.schema(REQUEST).json(f"file://{self.folder}/in")
        sync_stream(stream, f"file://{self.folder}/table", f"file://{self.folder}/checkpoint", whole_every=3).trigger(availableNow=True).start().awaitTermination(120)
        return {r.user_id: (sorted(r.learned), r.log) for r in progress_at(self.spark, f"file://{self.folder}/table").collect()}


class Device:
    def __init__(self, cloud, learned=(), user="u"):
        self.cloud, self.user, self.learned, self.base, self.log, self.base_log = cloud, user, set(learned), None, {}, None

    def request(self):
        return {"user_id": self.user, "learned": sorted(self.learned), "log": self.log, **({} if self.base is None else {"base_learned": sorted(self.base), "base_log": self.base_log})}

    def sync(self):
        learned, log = self.cloud.sync(self.request())[self.user]
        self.learned, self.base, self.log, self.base_log = set(learned), set(learned), dict(log), dict(log)


@pytest.fixture()
def cloud(spark, tmp_path):
    return Cloud(spark, tmp_path)


def test_two_devices(cloud):
    """Words of both stay, a removal reaches the other device, and counts of a day add up."""
    a, b = Device(cloud), Device(cloud)
    a.learned.add("w1")
    a.log["d1"] = 2
    a.sync()
    b.learned.add("w2")
    b.log["d1"] = 3
    b.sync()
    assert b.learned == {"w1", "w2"} and b.log == {"d1": 5}
    a.sync()
    assert a.learned == {"w1", "w2"} and a.log == {"d1": 5}
    a.learned.remove("w1")
    a.log["d2"] = 1
    a.sync()
    b.sync()
    assert b.learned == {"w2"} and b.log == {"d1": 5, "d2": 1}


def test_first_sync_unites(cloud):
    Device(cloud, ["w1"]).sync()
    local = Device(cloud, ["w3"])
    local.sync()
    assert local.learned == {"w1", "w3"}


def test_two_tabs(cloud):
    """Tabs share a store: what one learns is there when the other syncs, and a removal in one stays removed."""
    store = Device(cloud)
    store.learned.add("w1")
    store.sync()
    store.sync()
    assert store.learned == {"w1"}
    store.learned.remove("w1")
    store.sync()
    store.sync()
    assert store.learned == set() and cloud.sync()["u"] == ([], {})


def test_batches_run_again(spark, tmp_path):
    """Each batch twice, in any number of versions, gives what a plain fold gives."""
    rnd, path = random.Random(5), f"file://{tmp_path}/t"
    want, rows = {}, []
    for seq in range(60):
        u, have, had = rnd.choice("abc"), set(rnd.sample("pqrst", 3)), rnd.choice([None, set(rnd.sample("pqrst", 2))])
        rows.append((u, seq, sorted(have), {"d": 1}, None if had is None else sorted(had), None))
        learned, n = want.get(u, (set(), 0))
        want[u] = ((learned | (have - (had or set()))) - ((had or set()) - have), n + 1)
    for batch in range(6):
        df = spark.createDataFrame(rows[10 * batch : 10 * batch + 10], REQUEST)
        for _ in range(2):
            sync_batch(df, batch, path, whole_every=4)
    got = {r.user_id: (set(r.learned), r.log["d"]) for r in progress_at(spark, path).collect()}
    assert got == want
    assert apply_requests(spark.createDataFrame([], STATE), spark.createDataFrame([(None, 1, ["x"], None, None, None), ("z", 1, None, None, ["x"], None)], REQUEST)).collect() == [("z", [], {})]
