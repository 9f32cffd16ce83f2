"""Entity resolution: blocking, evidence scores, verdicts, and the resolver's rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.text import article_norm, colon_prefix, norm_title, same_director, title_ratio, without_editions

#: Points of a title by the level at which it was found.
TITLE_POINTS = {0: 3, 1: 2, 2: 1}
DATABASE, COMMERCE = "database", "commerce"


def forms(df: DataFrame, title: str = "title") -> DataFrame:
    """df once for each level (0 the title, 1 without editions, 2 before the colon) with its key."""
    t = F.col(title)
    keys = F.array(F.struct(F.lit(0).alias("level"), norm_title(t).alias("key")), F.struct(F.lit(1).alias("level"), norm_title(without_editions(t)).alias("key")), F.struct(F.lit(2).alias("level"), norm_title(colon_prefix(t)).alias("key")))
    return df.withColumn("form", F.explode(F.filter(keys, lambda k: k["key"].isNotNull() & (k["key"] != "")))).select(*df.columns, "form.level", "form.key")


def candidates(queries: DataFrame, films: DataFrame) -> DataFrame:
    """(q.*, c.*, level): for each query the films of the first pair of levels at which any share a key.

    An equi-join on the key; what a query's candidates have in common is a window over the
    query, whose partitioning the aggregations after it keep.
    """
    q = forms(queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]), "q_title").withColumnsRenamed({"level": "q_level", "key": "q_key"})
    c = forms(films.select(*[F.col(x).alias(f"c_{x}") for x in films.columns]), "c_title").withColumnsRenamed({"level": "c_level", "key": "c_key"})
    pairs = q.join(c, F.col("q_key") == F.col("c_key")).withColumn("pair", F.struct("q_level", "c_level"))
    found = pairs.withColumn("b_pair", F.min("pair").over(Window.partitionBy("q_id"))).where(F.col("pair") == F.col("b_pair"))
    return found.withColumn("level", F.greatest("q_level", "c_level")).drop("q_level", "c_level", "q_key", "c_key", "pair", "b_pair").dropDuplicates(["q_id", "c_id"])


def _names(c: Column) -> Column:
    return F.transform(F.split(F.lower(c), ","), lambda n: F.trim(n))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with score, year_points, gap, corroborated and out (why a candidate is ruled out, else null)."""
    delta = F.col("q_year") - F.col("c_year")
    near = F.abs(delta) <= 1
    both_dirs = (F.coalesce("q_director", F.lit("")) != "") & (F.coalesce("c_director", F.lit("")) != "")
    same = F.arrays_overlap(_names(F.col("q_director")), _names(F.col("c_director")))
    run = F.abs(F.col("q_runtime_min") - F.col("c_runtime_min"))
    run_ok, run_bad = run <= F.greatest(F.lit(2.0), F.col("c_runtime_min") * 0.05), run > F.col("c_runtime_min") * 0.15
    no = lambda c: F.coalesce(c, F.lit(False))
    out = (
        F.when(no(~near & (F.col("q_year_kind") == DATABASE)), "other").when(no(delta < -1), "early")
        .when(both_dirs & ~no(same), "other").when(no(~run_ok & run_bad), "other")
    )
    year_points = F.when(no(near), 2).otherwise(0)
    corroborated = (both_dirs & no(same)) | no(run_ok)
    points = F.when(F.col("level") == 0, TITLE_POINTS[0]).when(F.col("level") == 1, TITLE_POINTS[1]).otherwise(TITLE_POINTS[2])
    score = points + year_points + F.when(both_dirs & no(same), 3).otherwise(0) + F.when(no(run_ok), 2).otherwise(0)
    return pairs.withColumns({"out": out, "year_points": year_points, "gap": no(delta > 1) & (F.col("q_year_kind") == COMMERCE), "corroborated": corroborated, "score": score})


def verdicts(queries: DataFrame, films: DataFrame, popularity: bool = False) -> DataFrame:
    """(id, kind, film_id, reason, tied) of each query (id, title, year, year_kind, director, runtime_min, edition_hint).

    films has id, title, year, director, runtime_min, popularity. kind is match, review or
    create. Candidates are Columns of one join; a query's verdict is one aggregation and an
    ordered choice.
    """
    pairs = scored(candidates(queries, films))
    alive = F.col("out").isNull()
    pairs = pairs.withColumn("top_score", F.max(F.when(alive, F.col("score"))).over(Window.partitionBy("q_id")))
    top = alive & (F.col("score") == F.col("top_score"))
    about = F.struct(F.coalesce("c_popularity", F.lit(float("-inf"))).alias("popularity"), "c_id", "c_year", "year_points", "gap", "corroborated", "level")
    grouped = pairs.groupBy("q_id").agg(
        F.count_if(alive).alias("n_alive"),
        F.count_if(~alive).alias("n_out"),
        F.count_if(F.col("out") == "other").alias("n_other"),
        F.max(alive & F.col("gap")).alias("any_gap"),
        F.sort_array(F.collect_list(F.when(top, about)), asc=False).alias("best"),
    )
    one = F.try_element_at("best", F.lit(1))
    unique = F.size("best") == 1
    if popularity:
        unique = unique | (F.try_element_at("best", F.lit(2))["popularity"] < one["popularity"])
    rows = queries.join(grouped, queries["id"] == F.col("q_id"), "left")
    hint = F.coalesce("edition_hint", F.lit(False))
    reason = (
        F.when((F.col("n_alive") == 0) & (F.col("n_other") > 0), "conflict")
        .when((F.col("n_alive") > 0) & ~unique, "ambiguous")
        .when(hint & (one["year_points"] == 2) & F.col("any_gap"), "rerelease-ambiguous")
        .when(one["gap"] & ~(hint | one["corroborated"]), "year-gap")
        .when((one["level"] == 2) & (one["year_points"] == 0) & ~one["corroborated"], "weak-title")
        .when(F.col("year").isNotNull() & one["c_year"].isNull() & ~one["corroborated"] & (F.col("n_out") > 0), "yearless-among-dated")
    )
    kind = F.when(F.col("q_id").isNull() | ((F.col("n_alive") == 0) & (F.col("n_other") == 0)), "create").when(F.col("reason").isNotNull(), "review").otherwise("match")
    tied = F.when(F.col("reason") == "ambiguous", F.array_sort(F.transform("best", lambda b: b["c_id"])))
    return rows.withColumn("reason", F.when(F.col("q_id").isNotNull(), reason)).withColumn("kind", kind).select("id", "kind", F.when(F.col("kind") == "match", one["c_id"]).alias("film_id"), "reason", tied.alias("tied"))


#: Words of titles that are about a film, not the film.
JUNK = r"(?i)\bmaking\b|bande-annonce|trailer|q&a|\bpanel\b|behind the scenes|a look at|featurette|sing-along|timelapse|\bw/\b|on pov|\breviews?\b|the journey to|podcast"


#: Fixed value: from which ratio two titles are alike.
ALIKE = 0.85


def title_levels(pairs: DataFrame) -> DataFrame:
    """pairs (q_title, q_forms, c_titles) with title_level: 3 a same form, 2 a longer title, 1 a similar one, 0 none.

    Only where no candidate of a query has a same form do forms without their article count.
    """
    each = pairs.withColumn("c_one", F.explode("c_titles"))
    norm, own, query = norm_title(F.col("c_one")), norm_title(F.col("q_form")), norm_title(F.col("q_title"))
    spread = each.withColumn("q_form", F.explode("q_forms")).withColumns({"n_c": norm, "n_f": own, "n_q": query, "a_c": article_norm(F.col("c_one")), "a_f": article_norm(F.col("q_form"))})
    prefix = F.startswith(F.col("n_c"), F.col("n_q")) & (F.length("n_q") >= 8)
    # equal forms, and what lengths alone keep below the ratio, reach the UDF as nulls, which it passes by
    size = lambda c: F.length(c).cast("double")
    near = 2 * F.least(size("n_q"), size("n_c")) >= ALIKE * (size("n_q") + size("n_c"))
    asked = (F.col("n_c") != F.col("n_f")) & ~prefix & near
    alike = F.coalesce(title_ratio(F.when(asked, F.col("n_q")), F.when(asked, F.col("n_c"))) >= ALIKE, F.lit(False))
    level = F.when(F.col("n_c") == F.col("n_f"), 3).when(prefix, 2).when(alike, 1).otherwise(0)
    rest = [F.any_value(c).alias(c) for c in pairs.columns if c not in ("q_id", "c_id")]
    found = spread.withColumns({"l": level, "l_article": F.col("a_c") == F.col("a_f")}).groupBy("q_id", "c_id").agg(F.max("l").alias("l"), F.max("l_article").alias("l_article"), *rest)
    exact = F.coalesce(F.max(F.col("l") == 3).over(Window.partitionBy("q_id")), F.lit(False))
    return found.withColumn("title_level", F.when(~exact & F.col("l_article"), 3).otherwise(F.col("l"))).select(*pairs.columns, "title_level")


def resolve(pairs: DataFrame) -> DataFrame:
    """(q_id, kind, c_id, reason) by the resolver's ordered rules.

    pairs has a row for each query and candidate: q_id, q_title, q_forms, q_year, q_class
    (database, mc, apple-field), q_director, q_editions, c_id, c_titles, c_year, c_directors,
    c_votes, c_kind, c_in_tmdb, c_in_omdb, c_omdb_title. Signals are Columns of a candidate;
    what a query's rules ask (how many, which one, whether votes dominate) are aggregates.
    """
    p = title_levels(pairs).where("title_level > 0")
    p = p.where(~F.coalesce("c_omdb_title", F.lit("")).rlike(JUNK) | F.col("q_title").rlike(JUNK))
    matched = same_director(F.col("q_director"), F.col("c_directors"))
    p = p.withColumn("dm", F.when((F.coalesce("q_director", F.lit("")) != "") & (F.coalesce("c_directors", F.lit("")) != ""), matched))
    late = F.col("q_class").isin("mc", "apple-field")
    gap = F.abs(F.col("c_year") - F.col("q_year"))
    fits = F.col("q_year").isNull() | F.col("c_year").isNull() | (gap <= 2) | F.coalesce("dm", F.lit(False)) | (late & (F.col("c_year") < F.col("q_year")))
    conflict = F.coalesce(~F.col("dm"), F.lit(False))
    p = p.withColumns({
        "alive": ~conflict & (F.col("c_kind").isin("movie", "") | F.coalesce("dm", F.lit(False))) & fits,
        "conflict": conflict,
        "year_points": F.when(gap <= 1, 2).when(gap <= 2, 1).otherwise(0),
        "older": F.coalesce((gap > 2) & ~F.coalesce("dm", F.lit(False)) & late & (F.col("c_year") < F.col("q_year")), F.lit(False)),
        "agreement": F.col("c_in_tmdb") & F.col("c_in_omdb"),
        "directed": F.coalesce("dm", F.lit(False)),
    })
    p = p.withColumn("score", F.col("title_level") + F.col("year_points") + F.when(F.col("directed"), 3).otherwise(0) + F.col("agreement").cast("int"))
    # an exact title beats longer ones outright; an unkeyed entry without votes beside a keyed one of its year is a duplicate
    of_query = Window.partitionBy("q_id")
    p = p.withColumn("any_exact", F.coalesce(F.max(F.when(F.col("alive"), F.col("title_level") == 3)).over(of_query), F.lit(False)))
    p = p.withColumn("counts", F.coalesce(F.col("alive") & (~F.col("any_exact") | (F.col("title_level") == 3)), F.lit(False)))
    p = p.withColumn("keyed_years", F.collect_set(F.when(F.col("counts") & F.col("c_in_tmdb"), F.col("c_year"))).over(of_query))
    twin = ~F.col("c_in_tmdb") & (F.col("c_votes") < 10) & F.coalesce(F.array_contains("keyed_years", F.col("c_year")), F.lit(False))
    p = p.withColumn("left_over", ~twin)
    about = F.struct((-F.col("score")).alias("less"), "c_id", "c_votes", "title_level", "year_points", "agreement")
    row = lambda cond: F.array_sort(F.collect_list(F.when(F.col("counts") & cond, about)))
    g = p.groupBy("q_id").agg(
        F.any_value("q_title").alias("q_title"), F.any_value("q_year").alias("q_year"), F.any_value("q_class").alias("q_class"), F.any_value("q_director").alias("q_director"), F.any_value("q_editions").alias("q_editions"),
        row(F.col("directed")).alias("directed"), row(F.col("directed") & (F.col("agreement") | (F.col("c_votes") >= 100))).alias("strong"),
        row(F.col("left_over") & (F.col("year_points") >= 1)).alias("near"), row(F.col("left_over") & F.col("older")).alias("old"), row(F.col("left_over")).alias("rest"),
        F.max("counts").alias("any_counts"), F.max("conflict").alias("any_conflict"),
    )
    return _ruled(pairs.select("q_id").distinct(), g)


def _dominant(found: str) -> Column:
    """Of an array of candidates the one whose votes leave the others far behind, else null."""
    by_votes = F.sort_array(F.transform(found, lambda c: F.struct(c["c_votes"].alias("v"), c["c_id"].alias("c_id"), c["agreement"].alias("agreement"))), asc=False)
    first, second = F.try_element_at(by_votes, F.lit(1)), F.try_element_at(by_votes, F.lit(2))
    return F.when((first["v"] >= 1000) & (second.isNull() | (first["v"] >= 20 * F.greatest(F.lit(1), second["v"]))), first)


def _ruled(queries: DataFrame, g: DataFrame) -> DataFrame:
    rows = queries.join(g.withColumnRenamed("q_id", "g_id"), F.col("q_id") == F.col("g_id"), "left")
    n = lambda c: F.size(c)
    first = lambda c: F.try_element_at(c, F.lit(1))
    late = F.col("q_class").isin("mc", "apple-field")
    generic = (F.size(F.split(F.trim("q_title"), r"\s+")) <= 2) & (F.coalesce("q_director", F.lit("")) == "")
    near1 = F.exists("near", lambda c: c["year_points"] == 2)
    editions = F.size(F.coalesce("q_editions", F.array().cast("array<string>"))) > 0
    near_top, dom_near, dom_old, strong = first("near"), _dominant("near"), _dominant("old"), first("strong")
    sole = (n("near") == 1) & (near_top["agreement"] | (near_top["c_votes"] >= 1000) | (~generic & (near_top["year_points"] == 2)))
    top = first("rest")
    rule = lambda reason, ident=None: F.struct(F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), (F.lit(None).cast("string") if ident is None else ident.cast("string")).alias("c_id"))
    chosen = (
        F.when(~F.coalesce("any_counts", F.lit(False)), rule(F.when(F.coalesce("any_conflict", F.lit(False)), "director conflicts only").otherwise("no candidates")))
        .when((n("directed") == 1) & (first("directed")["title_level"] >= 2), rule("director corroborated", first("directed")["c_id"]))
        .when((n("directed") > 1) & (n("strong") == 1) & (strong["title_level"] >= 2), rule("director corroborated (one keyed/voted entry among duplicates)", strong["c_id"]))
        .when(n("directed") > 1, rule("ambiguous (several director hits)"))
        .when((n("old") > 0) & (n("near") > 0) & ((F.col("q_class") == "apple-field") | ((F.col("q_class") == "mc") & ~near1) | editions), rule("rerelease-ambiguous"))
        .when(sole, rule(F.concat(F.lit("exact title + year"), F.when(near_top["agreement"], " + agreement").otherwise("")), near_top["c_id"]))
        .when((n("near") > 0) & dom_near.isNotNull(), rule("votes dominate among year-near exact titles", dom_near["c_id"]))
        .when(n("near") > 0, rule("ambiguous"))
        .when((n("old") == 1) & late & first("old")["agreement"], rule("unique older exact title (commerce year = re-release)", first("old")["c_id"]))
        .when((n("old") > 0) & late & dom_old["agreement"], rule("votes dominate among older exact titles", dom_old["c_id"]))
        .when((n("old") > 0) & late, rule("ambiguous (older candidates)"))
        .when(F.col("q_year").isNull() & (n("rest") == 1) & top["agreement"] & ~generic, rule("dateless: unique exact + agreement", top["c_id"]))
        .when((top["title_level"] == 2) & (top["year_points"] >= 1) & top["agreement"], rule("longer official title + year + agreement", top["c_id"]))
        .otherwise(rule("weak"))
    )
    out = rows.withColumn("chosen", chosen)
    return out.select("q_id", F.when(F.col("chosen.c_id").isNotNull(), "match").otherwise("review").alias("kind"), F.col("chosen.c_id").alias("c_id"), F.col("chosen.reason").alias("reason"))
