"""Many misspelled terms against many names, as one similarity join.

A name's similarity to a term is the best ratio of matching blocks of the term with the
whole name, or with one of its words and then lowered where lengths differ (functions.text.
similarity). A ratio of strings with q and s letters that have m letters in common, counted
with repeats, is at most 2 m / (q + s). That bound makes candidates by a prefix filter: a
string is the set of its letters, the second a other than the first, in one fixed order,
rare ones first; two strings that can reach a floor share a letter among so many of their
first ones that the rest alone could not. Of each pair of strings that meets, the bound itself is
then computed from the letters in generated code, and only what passes is compared letter
by letter, in Arrow batches, each distinct pair of strings once.

Scale: strings are distinct words and names, compared once however many names have them.
No pair is lost, none is sampled, and there is no limit on candidates; what meets is stated
by `pairs`. Where a name has to share three letters in a row with the term, as people and
characters do, that is tested on pairs of names that reach the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import trigrams
from lumidex.functions.text import LENGTH_EXPONENT, title_ratio

#: From what similarity on a name is used for a term, and offered; how many are offered.
CORRECTION_FLOOR, SUGGESTION_FLOOR, MAX_SUGGESTIONS = 0.8, 0.6, 3
#: Any fixed order loses nothing; with the letters that most words have last, fewest strings meet.
COMMON_LAST = "zqxjkvbpygfwmucldrhsnioate"


def letters(text: Column) -> Column:
    """A string's letters in the join's order, each with its number among equal ones: as sortable structs."""
    alike = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.sort_array(F.transform(alike, lambda c, i: F.struct((F.array_position(alike, c) - i).alias("again"), F.instr(F.lit(COMMON_LAST), c).alias("common"), c.alias("c"))))


def _strings(rows: DataFrame, floor: float) -> DataFrame:
    """rows (s) with n, all (their letters) and probe (the first ones, of which any partner within floor has one)."""
    least = F.ceil(F.col("n") * (floor / (2 - floor)) - 1e-9)  # letters that the longest partner allowed has in common, at least
    held = rows.select("s", F.length("s").alias("n"), letters(F.col("s")).alias("all")).where("n > 0")
    return held.withColumn("probe", F.slice("all", F.lit(1), F.greatest(F.col("n") - least + 1, F.lit(1)).cast("int")))


def pairs(terms: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(q, s, part, reach) of terms (q) and strings (s, part: whether a word of a name) that can reach floor by their letters; reach is the ratio that they need."""
    a = _strings(terms.select(F.col("q").alias("s")).distinct(), floor).select(F.col("s").alias("q"), F.col("n").alias("q_n"), F.col("all").alias("q_all"), F.col("probe").alias("q_probe"))
    b = _strings(names.select("s").distinct(), floor)
    met = a.withColumn("k", F.explode("q_probe")).join(b.withColumn("k", F.explode("probe")), "k")
    met = met.where(F.col("k") == F.array_min(F.array_intersect("q_probe", "probe")))  # each pair once, at the first letter shared
    bound = 2.0 * F.size(F.array_intersect("q_all", "all")) / (F.col("q_n") + F.col("n"))
    near = met.withColumn("bound", bound).where(F.col("bound") >= floor - 1e-9).select("q", "q_n", "s", "n", "bound")
    close = F.pow(F.least("q_n", "n") / F.greatest("q_n", "n"), LENGTH_EXPONENT)
    parts = near.join(names.select("s", "part").distinct(), "s").withColumn("weight", F.when(F.col("part"), close).otherwise(1.0))
    return parts.where(F.col("bound") * F.col("weight") >= floor - 1e-9).select("q", "s", "part", "weight")


def strings_of(names: DataFrame) -> DataFrame:
    """(key, s, part): the lower-cased names (key, name) and their words."""
    lower = F.lower("name")
    whole = names.select("key", lower.alias("s"), F.lit(False).alias("part"))
    return whole.union(names.select("key", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(lower, r"\s+", " ")), " "))).alias("s"), F.lit(True).alias("part"))).where("s <> ''")


def similar(terms: DataFrame, names: DataFrame, floor: float = SUGGESTION_FLOOR, sharing_trigram: bool = False, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """(term_id, key, name, score, place): for each of terms (term_id, value) the most similar of names (key, name, weight), best first, heavier and then by name among equal ones.

    A null or empty value has none. sharing_trigram: names have to share three letters in a row with the value.
    """
    asked = terms.select("term_id", F.lower(F.trim("value")).alias("q")).where("q <> ''")
    held = strings_of(names)
    met = pairs(asked, held, floor)
    scored = met.select("q", "s", "part", (title_ratio(F.col("q"), F.col("s")) * F.col("weight")).alias("score")).where(F.col("score") >= floor)
    by_name = scored.join(held, ["s", "part"]).groupBy("q", "key").agg(F.max("score").alias("score"))
    found = by_name.join(names.select("key", "name", "weight"), "key")
    if sharing_trigram:
        found = found.where(F.arrays_overlap(trigrams(F.col("q")), trigrams(F.col("name"))))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("weight"), "name", "key")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return asked.join(best, "q").select("term_id", "key", "name", "score", "place")


def resolved(terms: DataFrame, names: DataFrame, sharing_trigram: bool = False, floor: float = CORRECTION_FLOOR) -> DataFrame:
    """(term_id, key, name, used, place) of terms (term_id, value) that no name equals: the name to use, if it reaches floor, or else those to offer."""
    found = similar(terms, names, SUGGESTION_FLOOR, sharing_trigram)
    best = F.max("score").over(Window.partitionBy("term_id"))
    return found.withColumn("used", best >= floor).where(~F.col("used") | (F.col("place") == 1)).select("term_id", "key", "name", "used", "place")
