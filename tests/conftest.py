import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hopvec.session import DEFAULT_CONF
    b = (SparkSession.builder.master("local[*]").appName("hopvec-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests own their checkpoint folder (a cluster names one in spark.checkpoint.dir)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hopvec-test-ckpt-"))
    yield s
    s.stop()
