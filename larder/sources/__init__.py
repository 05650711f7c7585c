from larder.sources.tables import load_tables, read_table
from larder.sources.keyed import KeyedTable
from larder.sources.sinks import save_co_located, write_load, write_orders, write_order_lines

__all__ = ["load_tables", "read_table", "write_orders", "write_order_lines", "write_load", "save_co_located", "KeyedTable"]
