"""Where written steps go."""

import pytest

from barwright.scratch import shared_dir


class Session:
    def __init__(self, **conf):
        self.conf = self
        self.values = conf

    def get(self, key, default=None):
        return self.values.get(key.split(".", 1)[1].replace(".", "_"), default)

    def set(self, key, value):
        self.values[key.split(".", 1)[1].replace(".", "_")] = value


def test_shared_folder():
    assert shared_dir(Session(checkpoint_dir="s3a://x/y/", master="yarn")) == "s3a://x/y"
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(Session(master=master))
    assert shared_dir(Session(master="local[2]")) and shared_dir(Session(master="local"))
