"""Scalar functions of the catalogue as Column expressions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that an arrival counts as new, and after which a miss is tried again.
NEW_DAYS = 30


def film_key(title: Column, year: Column) -> Column:
    """A title's natural key; a missing year is spelled None."""
    return F.concat(F.lower(F.trim(title)), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("None")), F.lit(")"))


def service_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def norm_genre(genre: Column) -> Column:
    return F.regexp_replace(F.lower(genre), "[^a-z0-9]", "")


def known(text: Column) -> Column:
    """text, or null where it says N/A."""
    return F.nullif(text, F.lit("N/A"))


def printed_rank(label: Column, rank: Column) -> Column:
    """The rank a list prints: the number of a label such as =6, else the line's."""
    number = F.regexp_extract(F.coalesce(label, F.lit("")), "^=?([0-9]+)$", 1)
    return F.coalesce(F.nullif(number, F.lit("")).cast("long"), rank.cast("long"))


def listing_weight(ordered: Column, trust: Column, printed: Column, size: Column) -> Column:
    """What one list adds to a canon score: its trust, scaled by the place where it is ordered."""
    scaled = trust * (F.lit(1.0) - (printed - 1) / size)
    return F.when(F.coalesce(ordered, F.lit(False)) & (size > 0), scaled).otherwise(trust.cast("double"))


def sane_year(text: Column, this_year: int) -> Column:
    """The year that a date text begins with, if a film can be of it."""
    year = F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int")
    return F.when(year.between(1880, this_year + 2), year)


def leading_year(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}"), F.substring(text, 1, 4).try_cast("int"))


def votes(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def minutes(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)\s*min", 1), F.lit("")).try_cast("int")


def minutes_of_seconds(text: Column) -> Column:
    """Whole minutes, halves to the even one."""
    return F.bround(text.try_cast("double") / 60).cast("int")


def price_history(text: Column) -> Column:
    """The prices of DATE:±price pieces joined by ~; what cannot be read or is not positive is left out."""
    price = lambda piece: F.regexp_replace(F.split_part(piece, F.lit(":"), F.lit(-1)), "^[+-]", "").try_cast("decimal(10,2)")
    return F.filter(F.transform(F.split(text, "~"), price), lambda p: p > 0)


def lowest_price(text: Column) -> Column:
    return F.array_min(price_history(text))


def target_price(low: Column) -> Column:
    return (low + F.lit(1).cast("decimal(10,2)")).cast("decimal(10,2)")


def string_list(text: Column) -> Column:
    """The strings of a JSON array in a string; anything else has none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def soonest_key(month: Column, day: Column, this_month: Column) -> Column:
    """Orders month-day labels by how far ahead they are."""
    return F.struct(F.pmod(month - this_month, F.lit(12)).alias("ahead"), day.alias("day"))


def leaving_label(slug: Column) -> Column:
    """Month and day of a leaving-month-day slug."""
    month, day = F.regexp_extract(slug, "leaving-([a-z]+)-([0-9]+)", 1), F.regexp_extract(slug, "leaving-([a-z]+)-([0-9]+)", 2)
    return F.when(month != "", F.concat_ws(" ", F.initcap(month), day.cast("int").cast("string")))


def expiry_label(instant: Column) -> Column:
    """Month and day, at five hours behind UTC, of an ISO instant."""
    return F.date_format(F.from_utc_timestamp(F.try_to_timestamp(instant), "-05:00"), "MMMM d")


def trigrams(text: Column) -> Column:
    """Windows of three characters of the lower-cased text; none below three."""
    lower = F.lower(text)
    windows = F.transform(F.sequence(F.lit(1), F.length(lower) - 2), lambda i: F.substr(lower, i, F.lit(3)))
    return F.when(F.length(lower) >= 3, windows).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The words of a text in one string, with a space between any two."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def tier_for_score(score: Column) -> Column:
    """10 or more: 1; 9: 2; 8: 3; 7: 4; 6: 5; below, null: such a title is not ranked."""
    return F.when(score >= 6, F.greatest(F.lit(1), F.lit(11) - score))


def queue_key(seed: int, film_id: Column) -> Column:
    """A title's place in the shuffle of a session."""
    return F.crc32(F.concat(F.lit(f"{seed}:"), film_id.cast("string")).cast("binary"))


def watch_url(template: Column, listing: Column, title: Column) -> Column:
    """A service's title search where it has a template, else the listing's URL."""
    encoded = F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))
    return F.coalesce(F.replace(F.nullif(template, F.lit("")), F.lit("{title}"), encoded), F.nullif(listing, F.lit("")))


def redirect_kind(status: Column, location: Column) -> Column:
    """film, supplement, gone or retry, by what a forwarding link answered."""
    path = F.coalesce(F.try_parse_url(location, F.lit("PATH")), location, F.lit(""))
    moved = status.isin(301, 302, 303, 307, 308)
    return (
        F.when(moved & path.rlike("^/(films|movies)/"), "film").when(moved & (path != ""), "supplement")
        .when(status.isin(404, 410), "gone").otherwise("retry")
    )


def embedding_text(overview: Column, plot: Column, tagline: Column) -> Column:
    """What a title's vector is made from; null if there is nothing."""
    parts = F.filter(F.transform(F.array(overview, plot, tagline), lambda t: F.trim(t)), lambda t: t != "")
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def app_url(store_id: Column) -> Column:
    """A link that opens a title in the television app."""
    return F.when(store_id.isNotNull(), F.concat(F.lit("com.apple.tv://tv.apple.com/movie/"), store_id))
