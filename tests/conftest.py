import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def tiny_transactions(spark):
    """10 rows, every 30 days from 2016-01-01 (reference fixture)."""
    from datetime import timedelta
    base = datetime(2016, 1, 1)
    cards = [1, 2, 1, 3, 2, 1, 3, 2, 1, 3]
    fraud = [0, 0, 0, 1, 0, 0, 1, 0, 0, 0]
    rows = []
    for i in range(10):
        rows.append((i + 1, base + timedelta(days=30 * i), cards[i], cards[i] * 10, 5.0 + 55 * i,
                     f"M{i % 3 + 1}", ["grocery", "gas", "online"][i % 3], ["Visa", "MC"][i % 2], 1, 0,
                     1000.0 + 1000 * i, fraud[i], True))
    return spark.createDataFrame(rows, "id long, date timestamp, card_id long, client_id long, amount double, "
                                       "merchant_id string, mcc_str string, card_brand string, has_chip int, "
                                       "card_on_dark_web int, credit_limit double, is_fraud int, has_label boolean")
