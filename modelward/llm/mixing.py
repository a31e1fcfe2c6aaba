"""Mixing sources to target weights: capped water-filling of word budgets, then seeded repetitions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a source are ordered by a seeded hash; so many ranges of it are summed before any document is ranked.
BUCKETS = 4096
#: Sources whose plan is sent to all tasks; more are joined by a shuffle.
SENT_SOURCES = 10_000


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source with ``source, source_size, weight``.

    The total of all sizes is shared by weight. A source stops at ``max_epochs`` times its size; what it can't take is
    shared again by weight among the others until none is above. Sorted by the share at which a source fills up, the full
    ones are a prefix, so that one running sum finds the fixed point that repeated sharing reaches. Sources without words
    get 0. The window runs over one row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.select(
        "*", cap.alias("_cap"), F.sum("source_size").over(everything).cast("double").alias("_total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("_filled"), (F.sum(F.col("weight").cast("double")).over(everything) - F.coalesce(F.sum(F.col("weight").cast("double")).over(before), F.lit(0.0))).alias("_open"),
    )
    level = (F.col("_total") - F.col("_filled")) / F.col("_open")
    # The water level is that of the first source that stays below its cap; what later ones give is lower, as it takes the
    # sources before them for full.
    ranked = ranked.withColumn("_level", F.max(F.when(level * F.col("weight") <= F.col("_cap"), level)).over(everything))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("weight")))
    return ranked.select(*sources.columns, target.alias("target"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, 3, repeating, by the sources' code points with null last; one row per source."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("long"))


def sampled_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", size_column: str | None = None, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` except clashing names, with ``size, source_size, target, taken``.

    ``taken`` are the words that the mix takes of a document. Every document of a source is repeated
    ``floor(target / source_size)`` times whole. The rest of the target goes to documents in the order of a seeded hash, one
    more repetition each; the document at which it is used up gives a fraction of a repetition, so a source's words add up
    to its target rounded to whole words. The hash is cut into ``BUCKETS`` ranges whose sums come first; only documents in
    the one range where the rest runs out are ranked, so no task sorts a whole source.

    ``size_column`` names sizes that are already counted; ``text_column`` is not read then.

    Null source is a source of its own, last in order. Null and empty texts have size 0 and nothing is taken of them.
    Repeated rows are each their own document in the mix; rows alike in id and text have the same place in the order, which
    the hash order breaks by nothing else, so they give alike fractions only as far as the words last. An empty table gives
    no rows.
    """
    given = ["_source", "_size", "_place", "_bucket", "size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in given and c != size_column]
    words = F.col(size_column) if size_column else word_count(F.col(text_column))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.col(source_column).alias("_source"), words.alias("_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))).alias("_place"),
    ).withColumn("_bucket", F.conv(F.substring("_place", 1, 3), 16, 10).cast("int"))
    marked = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))  # null sources join as well
    rows = rows.withColumn("_key", marked)

    ranges = rows.groupBy("_key", "_source", "_bucket").agg(F.sum("_size").alias("_words"))
    sizes = ranges.groupBy("_key", F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    plan = water_filled(weights(sizes), max_epochs).select("_key", "source_size", "target")
    # Whole repetitions and the words left over; a cap that is a whole number of epochs leaves none.
    plan = plan.withColumn("_goal", F.round("target").cast("long")).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("_goal") - F.col("_whole") * F.col("source_size"))
    so_far = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(so_far), F.lit(0))).join(plan, "_key")
    # One range per source: the last that begins before the rest is used up.
    edge = edges.where(F.col("_before") <= F.col("_rest")).groupBy("_key", "source_size", "target", "_whole", "_rest").agg(F.max(F.struct("_bucket", "_before")).alias("_edge"))
    # The plan has a row per source. Up to a checked number it is sent to all tasks, and no text is shuffled for it.
    edge = edge.checkpoint()
    placed = rows.join(F.broadcast(edge) if edge.count() <= SENT_SOURCES else edge, "_key")
    inside = F.col("_bucket") == F.col("_edge._bucket")
    early = placed.where(~inside).withColumn("_extra", F.when(F.col("_bucket") < F.col("_edge._bucket"), F.col("_size")).otherwise(F.lit(0)))
    by_place = Window.partitionBy("_key").orderBy("_place", "_size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_edge._before") + F.coalesce(F.sum("_size").over(by_place), F.lit(0))
    late = placed.where(inside).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - ahead)))
    both = early.unionByName(late)
    return both.select(*[F.col(f"`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target", (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long").alias("taken"))


def repeated_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document as often as whole texts come nearest to the words taken.

    Documents without words weigh nothing and stay as they are. Columns may have any names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = sampled_mix(docs.select(whole, F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(source_column).alias("origin")), source_column="origin", **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    return mixed.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
