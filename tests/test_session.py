"""Where intermediate tables go."""

import pytest

from dopplerlake.plans import session


class Fake:
    """A session with the settings and the master given."""

    def __init__(self, master, folder=None):
        self.values = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf, self.sparkContext = self, type("Context", (), {"master": master})

    def get(self, key, default):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="share"):
        session.shared_folder(Fake(master))
    assert session.shared_folder(Fake(master, "hdfs:///tmp/x")) == "hdfs:///tmp/x"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[2,3]"])
def test_one_process_may_use_a_folder_of_its_own(master):
    spark = Fake(master)
    assert session.shared_folder(spark).startswith("file://") and session.shared_folder(spark) == spark.values["spark.checkpoint.dir"]
