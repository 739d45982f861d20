from conftest import SF_SMALL
from txnscope.sources.tables import txn_view


def txn_small(spark):
    return txn_view(spark, SF_SMALL)
