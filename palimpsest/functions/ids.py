"""Identifiers: slugs, dated ids, versions, hashes and coercion to known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(prefix: str, name: Column) -> Column:
    """prefix and the ASCII words of a name, joined by underscores; null where there are none."""
    body = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.nullif(body, F.lit("")))


def scoped_id(prefix: Column, day: Column, episode: Column, seq: Column) -> Column:
    """prefix_YYYY_MM_DD_EE_SSS."""
    return F.format_string("%s_%s_%02d_%03d", prefix, F.date_format(day, "yyyy_MM_dd"), episode.cast("int"), seq.cast("int"))


def versioned_id(previous: Column, version: Column) -> Column:
    """The id with its version number, if it has one, replaced."""
    return F.concat(F.regexp_replace(previous, "_v[0-9]+$", ""), F.lit("_v"), version.cast("string"))


def user_hash(user_id: Column) -> Column:
    return F.sha2(user_id, 256)


def derived_id(message_ids: Column) -> Column:
    """16 hex digits of the joined message ids."""
    return F.substring(F.sha2(F.array_join(message_ids, "|"), 256), 1, 16)


def member(value: Column, members: Sequence[str], default: str | None = None) -> Column:
    """A value trimmed and upper-cased where it is one of the members, else the default."""
    upper = F.upper(F.trim(value))
    return F.when(upper.isin(*members), upper).otherwise(F.lit(default))


# Edges that lead to a person.
PERSON_EDGES = ("mentions_obs", "mentions_evt", "mentions_sess")


def edge_target_kind(edge: Column) -> Column:
    """What kind of standing record an edge leads to, from its name."""
    return (
        F.when(edge.isin(*PERSON_EDGES), "person")
        .when(edge.startswith("adopted_as"), "principle")
        .when(edge.endswith("_bel"), "belief")
        .when(edge.endswith("_pat") | edge.endswith("regulates_obs") | edge.endswith("regulates_sess"), "pattern")
        .otherwise("other")
    )
