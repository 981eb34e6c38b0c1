"""Sources and sinks: tables, fixture views, objects, change feed."""

from .tables import read_table, write_table, read_jdbc_table, TestTables
from .objects import read_objects
from .feed import read_feed, read_feed_stream, decode_messages

__all__ = ["read_table", "write_table", "read_jdbc_table", "TestTables", "read_objects",
           "read_feed", "read_feed_stream", "decode_messages"]
