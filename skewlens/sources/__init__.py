"""Sources and sinks: landed pages, baseline records, stored tables, files, JDBC."""
