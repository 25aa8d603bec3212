import base64
import types
import weakref

import pytest

from callweave.llm import bpe, common, langid


def stand_in(master, settings):
    conf = types.SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(stand_in("spark://host:7077", {}))
    assert common.shared_dir(stand_in("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    settings = {}
    assert common.shared_dir(stand_in("local[4]", settings)) == settings["spark.checkpoint.dir"]


def test_small_enough(spark):
    table = spark.createDataFrame([("x" * 100,), (None,)], "text string")
    assert common.small_enough(table, 200) and not common.small_enough(table, 100) and common.small_enough(table.limit(0), 0)


def test_a_worker_lets_the_caches_of_other_operators_go():
    """The codec of one stage, with all that it remembers, is gone in the next stage's tasks."""
    ranks = b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256))
    alive = weakref.ref(bpe.codec(ranks, r"\S+|\s+"))
    assert alive().encode("ab a") == [97, 98, 32, 97]
    assert bpe.codec(ranks, r"\S+|\s+") is alive()
    assert list(langid._counts(iter([]))) == []
    assert alive() is None
    bpe.codec(ranks, r"\S+|\s+")
    other = weakref.ref(bpe.codec(ranks, r"\w+|\W+"))
    assert len(common._KEPT) == 1 and other() is not None
    common.let_go()
