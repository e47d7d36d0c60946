"""A table function and an aggregate for SQL: chunks of paragraphs, sums of vectors.

    register(spark)
    SELECT * FROM chunk_parts(TABLE(paragraphs) PARTITION BY (doc) ORDER BY (at), 500)
    SELECT label, vector_sum(embedding) FROM vectors GROUP BY label
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.udtf(returnType="doc long, part int, first int, paragraphs int, text string")
class ChunkParts:
    """Rows (doc, at, text) of one document in order to its chunks: neighbouring paragraphs joined by a line end, up to max_chars.

    A longer paragraph is a chunk of its own, whole; null texts are left out. Only the chunk that is being filled is held.
    """

    def __init__(self) -> None:
        self.doc, self.part, self.first, self.held, self.chars = None, 0, None, [], 0

    def _out(self) -> tuple:
        self.part += 1
        return self.doc, self.part, self.first, len(self.held), "\n".join(self.held)

    def eval(self, row: Row, max_chars: int) -> Iterator[tuple]:
        doc, at, text = row["doc"], row["at"], row["text"]
        if text is None:
            return
        if self.held and self.chars + 1 + len(text) > max_chars:
            yield self._out()
            self.held = []
        if not self.held:
            self.doc, self.first, self.chars = doc, at, -1
        self.held.append(text)
        self.chars += 1 + len(text)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._out()


@F.arrow_udf(ArrayType(DoubleType()))
def vector_sum(vectors: pa.Array) -> pa.Scalar:
    """The sum of a group's vectors, component by component; nulls and vectors of another length than the first are left out. Empty for none."""
    total: list[float] = []
    kept = vectors.drop_null()
    sizes = kept.value_lengths().to_numpy(zero_copy_only=False) if len(kept) else np.zeros(0, int)
    if len(kept):
        same = kept.filter(pa.array(sizes == sizes[0]))
        total = same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(sizes[0])).sum(0).tolist()
    return pa.scalar(total, pa.list_(pa.float64()))


def register(spark: SparkSession) -> None:
    """Makes chunk_parts and vector_sum known to SQL."""
    spark.udtf.register("chunk_parts", ChunkParts)
    spark.udf.register("vector_sum", vector_sum)


def centroids(spark: SparkSession, rows: DataFrame, *, by: str, vector: str, salt: str, parts: int = 64, rows_of_part: int = 4096) -> DataFrame:
    """(by, n, centroid): the mean vector of each group, in SQL.

    A group is first summed in parts of about rows_of_part vectors, as the aggregate holds what it sums: a group of any size
    is many tasks' work, and what meets at last is a row a part. Parts are dealt by a hash of salt and counted beforehand; at
    least ``parts`` of them stand in for a level of their own. Null vectors take no part.
    """
    register(spark)
    # the last component counts: such an aggregate cannot stand beside count(*)
    counted = F.array_append(F.col(vector).cast("array<double>"), F.lit(1.0))
    clean = rows.where(F.col(vector).isNotNull()).select(F.col(by).alias("by"), counted.alias("v"), F.xxhash64(salt).alias("h"))
    clean.createOrReplaceTempView("centroid_rows")
    spark.sql(f"SELECT by AS of, CAST(ceil(count(*) / {rows_of_part}) AS int) AS parts FROM centroid_rows GROUP BY by").createOrReplaceTempView("centroid_parts")
    return spark.sql(f"""
        WITH low AS (SELECT by, pmod(h, parts) AS part, vector_sum(v) AS s FROM centroid_rows JOIN centroid_parts ON by <=> of GROUP BY by, pmod(h, parts)),
        mid AS (SELECT by, part % {parts} AS part, vector_sum(s) AS s FROM low GROUP BY by, part % {parts}),
        whole AS (SELECT by, vector_sum(s) AS s FROM mid GROUP BY by)
        SELECT by AS `{by}`, CAST(element_at(s, -1) AS bigint) AS n, transform(slice(s, 1, size(s) - 1), x -> x / element_at(s, -1)) AS centroid FROM whole""")
