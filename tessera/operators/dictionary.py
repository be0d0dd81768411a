"""Names that texts contain, and names' longest listed prefixes, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces by which names and texts are joined.
GRAM = 3


def _grams(c: Column, size: Column | int) -> Column:
    """All different pieces of c of a size; none where c is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(c, i, size)))).otherwise(F.array().cast("array<string>"))


def rarest_pieces(names: DataFrame, pieces: DataFrame) -> DataFrame:
    """(name, piece): of each name's pieces the one that the fewest texts have. A name with a piece that no text has is left out.

    pieces: (text, piece), each pair once.
    """
    own = names.select("name", F.explode(_grams(F.col("name"), F.least(F.lit(GRAM), F.length("name")))).alias("piece"))
    asked = own.select("piece").distinct()
    counts = pieces.join(asked, "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    held = own.join(counts, "piece", "left").groupBy("name").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return held.filter("n > 0").select("name", "piece")


def containing(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(text, name) for every different text and different name that it contains; null and empty names are in no text.

    A text that contains a name has all of the name's pieces of GRAM characters (of a shorter name, the name itself). Each name is met by its
    rarest piece alone, and the texts that have that piece are searched. No name is held against a text without it.
    """
    texts = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    names = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    sizes = [r[0] for r in names.select(F.least(F.lit(GRAM), F.length("name"))).distinct().collect()]  # 1, 2, 3 at most
    if not sizes:
        return texts.select("text", F.lit("").alias("name")).limit(0)
    pieces = F.concat(*[_grams(F.col("text"), k) for k in sorted(sizes)])
    texts = texts.withColumn("key", F.xxhash64("text"))
    held = texts.select("key", F.explode(pieces).alias("piece")).distinct()  # texts of one key are told apart below
    met = held.join(rarest_pieces(names, held.withColumnRenamed("key", "text")), "piece").select("key", "name")
    return texts.join(met, "key").filter(F.contains("text", "name")).select("text", "name")


def longest_prefix(names: DataFrame, name: str, groups: DataFrame, prefix: str) -> DataFrame:
    """(name, prefix): each different name with the longest listed prefix that it begins with, if any; an empty prefix is none.

    A name is cut at the lengths that listed prefixes have, and joined on the cuts.
    """
    listed = groups.select(F.col(prefix).alias("prefix")).filter("prefix <> ''").distinct()
    lengths = listed.select(F.length("prefix").alias("n")).agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # one row
    rows = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().crossJoin(F.broadcast(lengths))
    cuts = rows.select("name", F.explode(F.filter("lengths", lambda n: n <= F.length("name"))).alias("n"))
    cuts = cuts.select("name", F.substring(F.col("name"), F.lit(1), F.col("n")).alias("prefix"))
    return cuts.join(listed, "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
