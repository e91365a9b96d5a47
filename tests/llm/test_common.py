from types import SimpleNamespace

import pytest

from sievemill.llm import common


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_the_one_set_or_in_local_mode_one_of_its_own():
    assert common.shared_dir(session("spark://x", **{"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert common.shared_dir(session("local[2]")) == common.shared_dir(session("local[2]"))
    with pytest.raises(ValueError):
        common.shared_dir(session("spark://x"))
