"""Small tables from driver rows, as local relations: Catalyst sees their rows, and reading them needs no job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
    arrays = [pa.array([dict(zip([x.name for x in f.type], v, strict=True)) if pa.types.is_struct(f.type) and isinstance(v, tuple) else v for v in c], f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
