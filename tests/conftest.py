import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spendframe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "ProviderName": ("string", "AWS"), "ServiceCategory": ("string", "Compute"), "ServiceName": ("string", "VM"),
    "ChargeCategory": ("string", "Usage"), "PricingCategory": ("string", "Standard"), "ListCost": ("double", 100.0),
    "EffectiveCost": ("double", 100.0), "CommitmentDiscountId": ("string", None),
    "CommitmentDiscountStatus": ("string", None), "ConsumedQuantity": ("double", 1.0), "ResourceType": ("string", "Instance"),
    "ResourceId": ("string", "r-1"), "SkuId": ("string", None), "RegionId": ("string", "eu"),
    "SubAccountId": ("string", "acct"), "Tags": ("string", None), "tag_application": ("string", "app"),
    "tag_business_unit": ("string", "bu"), "tag_environment": ("string", "prod"),
}


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus="8", shuffle_partitions=4, memory="6g")


@pytest.fixture
def charges(spark):
    """Charges from literal rows; `day` sets a one-day period, everything else has a default."""
    def make(*rows):
        data = []
        for row in rows:
            day = dt.date.fromisoformat(row.get("day", "2024-01-01"))
            end = dt.date.fromisoformat(row["end"]) if "end" in row else day + dt.timedelta(days=1)
            data.append((day, end, *[row.get(c, default) for c, (_, default) in COLUMNS.items()]))
        schema = "ChargePeriodStart date, ChargePeriodEnd date, " + ", ".join(f"{c} {t}" for c, (t, _) in COLUMNS.items())
        df = spark.createDataFrame(data, schema)
        return df.withColumns({c: F.col(c).cast("decimal(28,9)") for c in ("ListCost", "EffectiveCost")})
    return make


@pytest.fixture
def one():
    """The single row of a frame as a dict."""
    def read(df):
        rows = df.collect()
        assert len(rows) == 1
        return rows[0].asDict()
    return read
