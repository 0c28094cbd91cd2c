from tendero.sources.tables import Tables, read_jdbc, read_table, write_bucketed

__all__ = ["Tables", "read_jdbc", "read_table", "write_bucketed"]
