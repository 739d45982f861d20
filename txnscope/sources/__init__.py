from txnscope.sources.tables import (  # noqa: F401
    load_table, transactions_from_events, transactions_from_orders,
    transactions_from_lineitem, with_score_fixture,
)
