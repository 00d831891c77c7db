"""Shared storage and connected components."""

import os
import random

import pytest

from paperloom.llm import shared


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.sparkContext, self.conf = Context(master), {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session(master))


def test_one_machine_gets_a_folder_of_its_own():
    session = Session("local[2]")
    assert os.path.isdir(shared.shared_folder(session)) and shared.shared_folder(session) == session.sparkContext.folder


def test_saved_tables_can_be_discarded(spark):
    table = shared.saved(spark.range(10).toDF("id"))
    path = shared._PATHS[table]
    assert table.count() == 10 and path.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(path)
    shared.discard(table)
    assert not os.path.exists(path)


def test_components(spark):
    rng = random.Random(1)
    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(120)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 0)]
    label = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    own = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.label for r in shared.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: label[x] for x in own}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
