from adperf.sources.files import (
    append_rows,
    load_csv,
    load_parquet,
    sample_exact,
    sample_fraction,
    split_key,
    typed_raw,
    validate_columns,
    write_csv,
    write_parquet,
)
from adperf.sources.fixture import ad_facts_base, ad_facts_raw

__all__ = [
    "ad_facts_base", "ad_facts_raw", "append_rows", "load_csv", "load_parquet",
    "sample_exact", "sample_fraction", "split_key", "typed_raw", "validate_columns",
    "write_csv", "write_parquet",
]
