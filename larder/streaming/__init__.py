from larder.streaming.orders import (
    place_order_batch,
    process_order_batch,
    stream_create_orders,
    stream_daily_sales,
    stream_ingredient_needs,
    stream_price_orders,
    needs_between,
)
from larder.streaming.ledger import stream_customer_ledger, stream_ledger_summaries, stream_summary_ledger, summarise_batch

__all__ = [
    "process_order_batch", "place_order_batch", "stream_price_orders", "stream_create_orders", "stream_ingredient_needs", "needs_between",
    "stream_daily_sales", "stream_customer_ledger", "summarise_batch", "stream_ledger_summaries", "stream_summary_ledger",
]
