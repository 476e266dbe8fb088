import pandas as pd
import pytest


@pytest.fixture(scope="session")
def proofs(data_dir):
    return pd.read_parquet(f"{data_dir}/proofs_primes.parquet")
