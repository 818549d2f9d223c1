"""Vector columns (arrays of floats): cleaning, length, cosine, element-wise mean."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Floors under the vector length when dividing by it.
PAIR_EPS = 1e-8
ANSWER_EPS = 1e-12


def nan_to_zero(vec: Column) -> Column:
    """Replace NaN elements by zero; infinities stay."""
    return F.transform(vec.cast("array<double>"), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vec: Column, eps: float = PAIR_EPS) -> Column:
    """Scale to length one; a zero vector stays zero."""
    doubles = vec.cast("array<double>")
    length = F.array(F.greatest(l2_norm(doubles), F.lit(eps)))
    # The length is bound to a lambda variable, so that it is worked out once per vector.
    return F.element_at(F.transform(length, lambda n: F.transform(doubles, lambda x: x / n)), 1)


def cosine(a: Column, b: Column, eps: float = PAIR_EPS) -> Column:
    """Cosine of two vectors, for single comparisons; many pairs go by matrix products."""
    return dot(l2_normalize(a, eps), l2_normalize(b, eps))


def mean_vectors(df: DataFrame, key: str, vec: str, count_name: str = "num_comments_used") -> DataFrame:
    """One mean vector per key and the number of rows behind it.

    Partial sums are formed before the shuffle, so a key that owns most rows costs no more
    than one partial vector per map task.
    """
    return (
        df.groupBy(key)
        .agg(
            Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_mean"),
            F.count(F.lit(1)).cast("int").alias(count_name),
        )
        .select(key, vector_to_array("_mean", "float32").alias(vec), count_name)
    )
