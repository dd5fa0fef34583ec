"""Sources and sinks: typed scans, parsers of pages, a fetching data source, and writers that append or replace."""
