import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage"))).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    """A seeded purchase log with one heavy user and one item almost everybody buys."""
    import numpy as np
    rng = np.random.default_rng(5)
    rows, order = [], 0
    for user in range(1, 61):
        for _ in range(40 if user == 7 else int(rng.integers(1, 9))):
            order += 1
            for item in rng.integers(1, 25, int(rng.integers(1, 6))):
                rows.append((user, order, int(item)))
            if rng.random() < 0.8:
                rows.append((user, order, 99))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(int(x) for x in r) for r in rows], "user bigint, order bigint, item bigint")


@pytest.fixture(scope="session")
def hist(log):
    from basketlens.functions.staging import stage
    from basketlens.operators.baskets import build_baskets, leave_last_out, min_orders
    return stage(leave_last_out(min_orders(build_baskets(log)))[0])


@pytest.fixture(scope="session")
def target(log):
    from basketlens.functions.staging import stage
    from basketlens.operators.baskets import build_baskets, leave_last_out, min_orders
    return stage(leave_last_out(min_orders(build_baskets(log)))[1])
