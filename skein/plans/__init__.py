"""Query plans over the stand-in tables, with their DuckDB SQL."""
