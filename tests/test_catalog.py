import pytest
from compare import connect, same

from keystrata.plans.catalog import QUERIES
from keystrata.plans.oracles import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_checksum_is_crc32(spark):
    import zlib

    one = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"))], "key binary, value binary")
    from keystrata.functions.scalar import checksum

    assert one.select(checksum()).first()[0] == zlib.crc32(b"kv")
