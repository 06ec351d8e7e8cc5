import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from curata.session import checkpoint_dir, local_session
    s = local_session(cores=4, shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def papers_df(spark, data, extra=()):
    """Small hand-written record frame; ``data`` rows are dicts."""
    from curata.schema import PAPER_SCHEMA, conform
    from pyspark.sql import types as T
    fields = list(PAPER_SCHEMA.fields) + [T.StructField(n, T.StringType()) for n in extra]
    schema = T.StructType(fields)
    full = [tuple(d.get(f.name) for f in fields) for d in data]
    df = spark.createDataFrame(full, schema)
    return df if extra else conform(df)
