"""Hashed bag-of-words vectors and cosine similarity.

A vector is kept as integer counts per bucket plus the integer squared norm.
Dot products of counts are exact, so ``dot / sqrt(norm2 * norm2)`` does not
depend on the order in which Spark adds the terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import let, tokens


def token_bucket(token: Column, dim: int = fixed.VECTOR_DIM) -> Column:
    """First four bytes of sha1, big-endian, modulo the vector size."""
    head = F.conv(F.substring(F.sha1(token.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dim)).cast("int")


def bucket_counts(text: Column, dim: int = fixed.VECTOR_DIM) -> Column:
    """``array<struct<bucket, n>>`` of one text, ordered by bucket, inside the row.

    A text is one row, so counting needs no shuffle: sort the buckets, and the
    count of a bucket is the length of its run.
    """
    hashed = F.transform(tokens(text, fixed.VECTOR_TOKEN), lambda t: token_bucket(t, dim))
    return let(F.sort_array(hashed), runs)


def runs(ordered: Column) -> Column:
    """Run lengths of a sorted array variable as ``array<struct<bucket, n>>``."""

    def starts_run(x: Column, i: Column) -> Column:
        return F.when(F.coalesce(F.get(ordered, i - 1) != x, F.lit(True)), i)

    def measured(starts: Column) -> Column:
        ends = F.concat(
            F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(ordered))
        )
        counted = F.zip_with(
            starts,
            ends,
            lambda start, end: F.struct(
                F.get(ordered, start).alias("bucket"), (end - start).cast("long").alias("n")
            ),
        )
        return F.slice(counted, F.lit(1), F.size(starts))  # an empty text has one padded end

    return let(F.array_compact(F.transform(ordered, starts_run)), measured)


def squared_norm(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * c["n"])


def cosine(dot: Column, left_norm2: Column, right_norm2: Column) -> Column:
    """Cosine from exact integers; a zero vector has cosine 0."""
    denominator = F.sqrt((left_norm2 * right_norm2).cast("double"))
    return F.when(denominator > 0, dot / denominator).otherwise(F.lit(0.0))


def unit_weights(counts: Column, norm2: Column) -> Column:
    """The L2-normalised vector as ``array<struct<bucket, w>>``."""
    return F.transform(
        counts, lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / F.sqrt(norm2)).alias("w"))
    )


def dense_dot(left: Column, right: Column) -> Column:
    """Dot product of two equal-length dense arrays."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
