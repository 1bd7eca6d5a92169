"""SQL fragments shared by the DuckDB oracles."""


def hash_frac(key_sql: str, seed: int = 42) -> str:
    """md5(seed ':' key): first 8 hex digits / 2^32, as ``tabflow.functions.hash_fraction``."""
    return (f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8)) AS BIGINT) "
            f"/ 4294967296.0)")
