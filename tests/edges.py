"""Copies of the smallest tables without rows, and with nulls in every column."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq


def write(source, empty, nulls):
    for p in glob.glob(f"{source}/*.parquet"):
        t, name = pq.read_table(p), os.path.basename(p)
        schema = pa.schema([pa.field(f.name, f.type, True) for f in t.schema])
        pq.write_table(t.slice(0, 0), f"{empty}/{name}")
        rows = [t.slice(0, 60).cast(schema), pa.table({f.name: pa.nulls(2, f.type) for f in schema}, schema=schema)]
        for i, f in enumerate(schema):
            one = t.slice(i % max(1, t.num_rows), 1).cast(schema)
            rows.append(one.set_column(i, f, pa.nulls(one.num_rows, f.type)))
        pq.write_table(pa.concat_tables(rows), f"{nulls}/{name}")
