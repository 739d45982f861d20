from txnscope.functions.calendar import calendar_columns  # noqa: F401
from txnscope.functions.amount import amount_columns  # noqa: F401
from txnscope.functions.flags import device_columns, interaction_columns  # noqa: F401
