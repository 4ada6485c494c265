from tallyflow.streaming.quotes import ROCKSDB, quote_batch, validate_quotes_stream  # noqa: F401
from tallyflow.streaming.streams import (  # noqa: F401
    alert_batch,
    drain,
    drain_updates,
    each_batch,
    ingest_batch,
    landed,
    latest_updates,
    pinned_batch,
    publish_batch,
    settled_days,
    sliding_kpis,
    stream_ledger,
    tumbling_counts,
)
