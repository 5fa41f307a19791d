"""Scalar functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPOCH


def make_id(repo: Column, kind: Column, raw: Column) -> Column:
    """`{repo}_{kind}_{raw}`: repo trimmed with spaces and slashes as underscores, kind trimmed and lower-cased, raw trimmed
    with spaces as underscores and without colons; null where raw is null or empty."""
    raw = F.translate(F.trim(raw.cast("string")), " :", "_")
    return F.when(raw != "", F.concat_ws("_", F.translate(F.trim(repo), " /", "__"), F.lower(F.trim(kind)), raw))


def table_name(name: Column) -> Column:
    """A type's name as part of a table name: ASCII letters and digits only."""
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "")


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def safe_timestamp(text: Column, fallback: Column | None = None) -> Column:
    """ISO text with a `Z` if it has none; a missing value is the fallback, then the epoch."""
    value = F.coalesce(F.when(F.trim(text) != "", text), *([fallback] if fallback is not None else []), F.lit(EPOCH))
    return F.when(value.endswith("Z") | value.rlike("[+-][0-9]{2}:?[0-9]{2}$"), value).otherwise(F.concat(value, F.lit("Z")))


def parsed(text: Column) -> Column:
    """ISO text as a timestamp, without an offset in UTC; null if it doesn't parse or stands for no time (year 1)."""
    return F.when(~text.startswith("0001-01-01"), F.try_to_timestamp(text))


def duration_s(start: Column, end: Column) -> Column:
    """Seconds between two ISO texts, at least 0; null if one doesn't parse."""
    seconds = (F.unix_micros(parsed(end)) - F.unix_micros(parsed(start))) / 1e6
    return F.when(seconds < 0, 0.0).otherwise(seconds)


#: Fixed value: type, scope, breaking mark and subject of a conventional commit header.
COMMIT = r"^(\w+)(?:\(([^)]+)\))?(!)?:\s+(.+)$"


def conventional_commit(message: Column) -> Column:
    """Struct of is_conventional, commit_type (`other` if not conventional, `unknown` without a message), scope,
    is_breaking (the mark, or BREAKING CHANGE in the body), subject, body and issues (distinct numbers after a #)."""
    whole = F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", "")
    head = F.trim(F.split_part(whole, F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.regexp_extract(whole, r"(?s)^[^\n]*\n(.*)$", 1), r"^\s+", "")
    is_one = head.rlike(COMMIT)
    part = lambda k: F.regexp_extract(head, COMMIT, k)
    return F.struct(
        is_one.alias("is_conventional"),
        F.when(whole == "", "unknown").when(is_one, F.lower(part(1))).otherwise("other").alias("commit_type"),
        F.when(is_one, F.nullif(part(2), F.lit(""))).alias("scope"),
        (is_one & ((part(3) == "!") | body.contains("BREAKING CHANGE"))).alias("is_breaking"),
        F.when(is_one, F.trim(part(4))).otherwise(head).alias("subject"),
        body.alias("body"),
        issue_references(F.coalesce(message, F.lit(""))).alias("issues"),
    )


def issue_references(text: Column) -> Column:
    """Distinct numbers that follow a #, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("bigint")))


#: Fixed value: major, minor, patch and pre-release of a version name.
SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z-]+))?(?:\+[0-9A-Za-z-]+)?$"


def semver(name: Column) -> Column:
    """Struct of major, minor, patch and prerelease; null if the name isn't a version."""
    part = lambda k: F.regexp_extract(name, SEMVER, k)
    number = lambda k: part(k).try_cast("int")
    return F.when(name.rlike(SEMVER), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), F.nullif(part(4), F.lit("")).alias("prerelease")))


def release_kind(name: Column) -> Column:
    """major (x.0.0), minor (x.y.0) or patch; other for what isn't a version."""
    v = semver(name)
    return F.when(v.isNull(), "other").when(v["patch"] > 0, "patch").when(v["minor"] > 0, "minor").otherwise("major")


#: Reaction names, and which of them count as negative.
REACTIONS = ("THUMBS_UP", "THUMBS_DOWN", "LAUGH", "HOORAY", "CONFUSED", "HEART", "ROCKET", "EYES")
NEGATIVE = ("THUMBS_DOWN", "CONFUSED")
POSITIVE = tuple(r for r in REACTIONS if r not in NEGATIVE)


def reactions(groups: Column) -> Column:
    """Struct of a count for each reaction, positive, negative and unknown, from an array of (content, n)."""
    total = lambda keep: F.aggregate(groups, F.lit(0).cast("bigint"), lambda a, g: a + F.when(keep(g["content"]), g["n"].cast("bigint")).otherwise(0))
    of = lambda names: F.coalesce(total(lambda c: c.isin(*names)), F.lit(0))
    each = [of([r]).alias(r.lower()) for r in REACTIONS]
    more = [of(POSITIVE).alias("positive"), of(NEGATIVE).alias("negative")]
    return F.struct(*each, *more, F.coalesce(total(lambda c: ~c.isin(*REACTIONS)), F.lit(0)).alias("unknown"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, rounded to 2; 0 where whole is 0."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(0.0)
