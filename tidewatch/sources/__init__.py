from tidewatch.sources.readers import load_flows, preview, read_table, row_count
from tidewatch.sources.fixtures import event_flows, lineitem_flows, vectors

__all__ = ["load_flows", "preview", "read_table", "row_count",
           "event_flows", "lineitem_flows", "vectors"]
