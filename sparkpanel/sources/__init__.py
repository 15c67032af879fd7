from sparkpanel.sources.tables import load_table, load_tables, read_table, write_table

__all__ = ["load_table", "load_tables", "read_table", "write_table"]
