from plumbline.sources.tables import Tables, read_table, register_views  # noqa: F401
