from tallyflow.sources.adapters import event_ledger, order_ledger, table  # noqa: F401
from tallyflow.sources.ingest import backfill, gap_check, ingest_increment, unseen  # noqa: F401
from tallyflow.sources.readers import (  # noqa: F401
    RAW_TRANSFER,
    read_archive,
    read_document,
    read_labels,
    read_ohlcv,
    read_price_map,
    read_quotes,
    read_revenue,
    read_state,
    read_transfers,
)
from tallyflow.sources.normalise import excluded, normalise  # noqa: F401
from tallyflow.sources.sinks import (  # noqa: F401
    append_snapshot,
    bank_days,
    export_rows,
    publish_closed,
    to_document,
    write_document,
)
