"""Similar past incidents: hashed template vectors and an exact threshold join.

Similarity depends on the template only, so everything expensive runs on the
distinct templates of a tenant, and groups are brought back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import let
from logspark.functions.vectors import bucket_counts, cosine, squared_norm
from logspark.operators.enrichment import top_groups
from logspark.operators.scale import checked_broadcast, cut


def embed(texts: DataFrame, key: list[str], text: str, dim: int = fixed.VECTOR_DIM) -> DataFrame:
    """``key, counts, norm2`` of each text, computed inside its row."""
    counted = texts.select(*key, bucket_counts(F.col(text), dim).alias("counts"))
    return counted.withColumn("norm2", squared_norm(F.col("counts")))


def template_index(groups: DataFrame) -> DataFrame:
    """Vector points of groups: one per group, with the columns a search returns.

    Each distinct template is embedded once and joined back from a table of its own, so that Spark
    can split the rows of a template that a large share of all groups has.
    """
    templates = cut(embed(groups.select("template").distinct(), ["template"], "template"), "embedded_templates")
    return groups.select(
        F.col("group_id").alias("id"),
        "user_id",
        "file_id",
        "template",
        "level",
        "severity",
        "fingerprint",
    ).join(templates, "template")


def upsert_points(stored: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """The last written point per id out of stored and new points.

    Among new points with one id and version the one with the larger content hash stays;
    a new point replaces a stored one of the same version.  Only the new points are
    ordered; the store is filtered by their ids, which are broadcast if they are small,
    so that an upsert of a small batch does not shuffle the store.
    """
    order = Window.partitionBy("id").orderBy(F.desc(version), F.desc(F.xxhash64(F.to_json(F.struct("*")))))
    ranked = new.withColumn("_rank", F.row_number().over(order))
    newest = cut(ranked.filter(F.col("_rank") == 1).drop("_rank"), "new_points")
    written, _ = checked_broadcast(newest.select(F.col("id").alias("_id"), F.col(version).alias("_written")), "new_ids")
    old = stored.join(written, (F.col("id") == F.col("_id")) & (F.col(version) <= F.col("_written")), "left_anti")
    newer = old.join(written, F.col("id") == F.col("_id"), "left_semi").select(F.col("id").alias("_id"))
    return old.unionByName(newest.join(newer.distinct(), F.col("id") == F.col("_id"), "left_anti"))


# --- exact threshold join --------------------------------------------------------------


def _bucket_ranks(vectors: DataFrame, dim: int) -> Column:
    """Literal array: rank of each bucket from rare to frequent.

    At most ``dim`` counts reach the driver, whatever the size of the data.
    """
    used = vectors.select(F.explode("counts.bucket").alias("bucket")).groupBy("bucket").count()
    frequency = {row["bucket"]: row["count"] for row in used.collect()}
    ranked = sorted(range(dim), key=lambda b: (frequency.get(b, 0), b))
    rank_of = {bucket: rank for rank, bucket in enumerate(ranked)}
    return F.array(*[F.lit(rank_of[b]) for b in range(dim)])


def _prefix(ranks: Column, threshold: float) -> Column:
    """Entries ``bucket, rank, n, rest2`` that a vector must share with any vector at or above the threshold.

    Order the buckets from rare to frequent and drop the longest tail whose norm
    stays below ``threshold`` times the vector's norm.  Two vectors that share
    no bucket outside their tails have a smaller cosine, because the whole dot
    product then lies in one vector's tail.  ``rest2`` is the squared norm of what follows an entry.
    """
    ordered = F.array_sort(
        F.transform(
            "counts",
            lambda c: F.struct(
                F.get(ranks, c["bucket"]).alias("rank"), c["bucket"].alias("bucket"), c["n"].alias("n")
            ),
        )
    )
    kind = "array<struct<bucket:int,rank:int,n:bigint,rest2:bigint>>"
    start = F.struct(F.col("norm2").alias("rest2"), F.array().cast(kind).alias("kept"))
    bound = F.lit(threshold * threshold - 1e-9) * F.col("norm2")

    def add(acc: Column, c: Column) -> Column:
        rest2 = acc["rest2"] - c["n"] * c["n"]
        entry = F.struct(c["bucket"].alias("bucket"), c["rank"].alias("rank"), c["n"].alias("n"), rest2.alias("rest2"))
        kept = F.when(acc["rest2"] >= bound, F.array_append(acc["kept"], entry)).otherwise(acc["kept"])
        return F.struct(rest2.alias("rest2"), kept.alias("kept"))

    return F.aggregate(ordered, start, add, lambda acc: acc["kept"])


def _dot(left: Column, right: Column) -> Column:
    """Dot product of two count lists through a bucket map of the right one."""
    def summed(weights: Column) -> Column:
        return F.aggregate(
            left,
            F.lit(0).cast("long"),
            lambda acc, c: acc + c["n"] * F.coalesce(F.try_element_at(weights, c["bucket"]), F.lit(0)),
        )

    return let(F.map_from_entries(right), summed)


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    group: str,
    item: str,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    dim: int = fixed.VECTOR_DIM,
) -> DataFrame:
    """All pairs of the same ``group`` with cosine at or above a positive threshold.

    Both sides have ``group, item, counts, norm2``.  Rows that share a prefix bucket meet as ids and
    numbers only, and are added up per pair.  What two vectors can still share lies behind the last bucket they met in, so the norms
    of the two rests bound it; a pair that cannot reach the threshold goes before any vector is looked at.
    """
    ranks = _bucket_ranks(right, dim)

    def numbered(side: DataFrame, tag: str) -> DataFrame:
        kept = side.filter(F.col("norm2") > 0).select(group, item, "counts", "norm2", F.monotonically_increasing_id().alias("id"))
        return cut(kept, f"similar_{tag}")

    def postings(side: DataFrame, tag: str) -> DataFrame:
        entries = side.select(group, "id", "norm2", F.explode(_prefix(ranks, threshold)).alias("e"))
        named = [F.col(f"e.{c}").alias(f"{tag}_{c}") for c in ("n", "rest2")]
        return entries.select(group, "e.bucket", "e.rank", F.col("id").alias(f"{tag}_id"), F.col("norm2").alias(f"{tag}_norm2"), *named)

    lefts, rights = numbered(left, "left"), numbered(right, "right")
    joined = postings(lefts, "left").join(postings(rights, "right").drop("rank"), [group, "bucket"])
    rest = F.sqrt(F.col("left_rest2").cast("double") * F.col("right_rest2"))
    met = joined.groupBy("left_id", "right_id").agg(
        F.sum(F.col("left_n") * F.col("right_n")).alias("dot"),
        F.max(F.struct("rank", rest.alias("rest"))).alias("last"),
        F.max(F.col("left_norm2").cast("double") * F.col("right_norm2")).alias("norms"),
    )
    able = met.filter(F.col("dot") + F.col("last.rest") >= F.lit(threshold) * F.sqrt("norms") - 1e-6).select("left_id", "right_id")
    both = able.join(_tagged(lefts, "left", group, item), "left_id").join(_tagged(rights.drop(group), "right", None, item), "right_id")
    score = cosine(
        _dot(F.col("left_counts"), F.col("right_counts")), F.col("left_norm2"), F.col("right_norm2")
    )
    scored = both.select(group, f"left_{item}", f"right_{item}", score.alias("score"))
    return scored.filter(F.col("score") >= threshold)


def _tagged(side: DataFrame, tag: str, group: str | None, item: str) -> DataFrame:
    own = [F.col(c).alias(f"{tag}_{c}") for c in ("id", item, "counts", "norm2")]
    return side.select(*([group] if group else []), *own)


# --- similar incidents ---------------------------------------------------------------------


def _capped(rows: DataFrame, key: list[str], order: list[Column], limit: int) -> DataFrame:
    """Enough rows per key that removing any one run still leaves the best ``limit``.

    Every run keeps at most ``limit`` rows, then the key keeps ``2 * limit``: the
    excluded run takes at most half of them.  Both are rank filters that prune
    before the shuffle.
    """
    per_run = F.row_number().over(Window.partitionBy(*key, "file_id").orderBy(*order))
    overall = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    kept = rows.withColumn("_in_run", per_run).filter(F.col("_in_run") <= limit).drop("_in_run")
    return kept.withColumn("_overall", overall).filter(F.col("_overall") <= 2 * limit).drop("_overall")


def similar_groups(
    seeds: DataFrame,
    history: DataFrame,
    limit: int = fixed.SIMILAR_LIMIT,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """The best ``limit`` past groups of other runs of the tenant for every seed group.

    Own-run groups are excluded before ranking.  The result carries the raw score.
    """
    known = cut(
        embed(history.select("user_id", "template").distinct(), ["user_id", "template"], "template"),
        "template_vectors",
    )
    wanted = known.join(
        seeds.select("user_id", "template").distinct(), ["user_id", "template"], "left_semi"
    )
    pairs = similar_pairs(wanted, known, "user_id", "template", threshold)
    members = _capped(
        history.select("user_id", "template", "file_id", "group_id", "severity"),
        ["user_id", "template"],
        [F.asc("group_id")],
        limit,
    )
    best = [F.desc("score"), F.asc("match_group_id")]
    matches = pairs.join(
        members.select(
            "user_id",
            F.col("template").alias("right_template"),
            "file_id",
            F.col("group_id").alias("match_group_id"),
            F.col("severity").alias("match_severity"),
        ),
        ["user_id", "right_template"],
    )
    shortlist = _capped(matches, ["user_id", "left_template"], best, limit).select(
        "user_id",
        F.col("left_template").alias("template"),
        F.col("file_id").alias("match_file_id"),
        "match_group_id",
        F.col("right_template").alias("match_template"),
        "match_severity",
        "score",
    )
    found = seeds.join(shortlist, ["user_id", "template"]).filter(
        F.col("match_file_id") != F.col("file_id")
    )
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(*best))
    return found.withColumn("match_rank", rank).filter(F.col("match_rank") <= limit)


def similar_incidents(
    groups: DataFrame,
    history: DataFrame,
    limit: int = fixed.SIMILAR_LIMIT,
    seed_groups: int | None = None,
) -> DataFrame:
    """Similar past groups per run, over all its groups or the ``seed_groups`` largest; the first match per group is kept."""
    narrow = groups.select("file_id", "user_id", "group_id", "template", "count", "fingerprint")
    seeds = cut(top_groups(narrow, seed_groups).drop("count", "fingerprint"), "seed_groups")
    found = similar_groups(seeds, history, limit)
    shown = found.withColumn("score", F.round("score", 3))
    in_turn = [F.asc("group_rank"), F.asc("match_rank")]
    once = F.row_number().over(Window.partitionBy("file_id", "match_group_id").orderBy(*in_turn))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), *in_turn))
    return (
        shown.withColumn("_turn", once)
        .filter(F.col("_turn") == 1)
        .withColumn("position", place)
        .filter(F.col("position") <= limit)
        .select(
            "user_id",
            "file_id",
            "position",
            F.col("group_id").alias("seed_group_id"),
            "match_group_id",
            "match_file_id",
            "match_template",
            "match_severity",
            "score",
        )
    )
