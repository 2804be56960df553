"""Session settings and the shared scratch folder."""

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def build_session(app="worktally", master=None, shuffle_partitions=None):
    """A session with adaptive execution; sizes are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    return b.getOrCreate()


def prepare(spark):
    """Runtime settings every plan relies on: UTC dates, adaptive skew handling."""
    for key, value in (("spark.sql.session.timeZone", "UTC"),
                       ("spark.sql.adaptive.enabled", "true"),
                       ("spark.sql.adaptive.skewJoin.enabled", "true"),
                       ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark, purpose):
    """A new folder for written tables and stream state.

    Lives under the folder the cluster names in ``spark.checkpoint.dir``. Only a local master,
    which has no other hosts, may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/worktally/{purpose}-{uuid.uuid4().hex}"


def by_value(module_name):
    """Functions of this module travel to the Python workers with the plan; workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
