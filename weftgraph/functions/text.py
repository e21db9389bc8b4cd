"""Paths, identifiers and sets of terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that say nothing about a feature.
GENERIC_TERMS = "app apps src source packages clientpackages resources assets js ts components component pages page index lib shared common frontend backend test tests spec nuxt vue design module modules section add create implement build support new with for the and".split()


def normalize_route_path(path: Column) -> Column:
    """`{x}` as `{param}`, single slashes, none at the ends; an empty path is `/`."""
    p = F.btrim(F.regexp_replace(F.regexp_replace(path, r"\{[^}]+\}", "{param}"), "/{2,}", "/"), F.lit("/"))
    # a condition on it would make it twice
    return F.regexp_replace(p, r"\A\z", "/")


def strip_api_prefix(path: Column) -> Column:
    """Without `/api` or `/api/vN` in front, then normalised."""
    return normalize_route_path(F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, "^/", "")), r"(?i)^/api(/v\d+)?(?=/|$)", ""))


def comparable_path(path: Column) -> Column:
    """Without query and fragment, parameters alike, lower-cased, with a leading slash."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\$?\{[^}]+\}", "{param}"), "/+", "/")
    p = F.lower(F.regexp_replace(p, "(?<=.)/$", ""))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def endpoint_verb(id: Column) -> Column:
    """The verb of an endpoint id; null for other ids."""
    return F.nullif(F.regexp_extract(id, r"^(?:api|http):([^:]+):", 1), F.lit(""))


def endpoint_path(id: Column) -> Column:
    """The path of an endpoint id; null for other ids."""
    return F.nullif(F.regexp_extract(id, r"^(?:api|http):[^:]+:(.*)$", 1), F.lit(""))


def endpoint_version(path: Column) -> Column:
    """N of `/api/vN`; null without one."""
    return F.nullif(F.regexp_extract(path, r"/api/v(\d+)", 1), F.lit(""))


def split_camel(value: Column) -> Column:
    """A space at each border of lower and upper case."""
    return F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")


def split_terms(value: Column) -> Column:
    """Distinct lower-cased terms of two letters or more that say something."""
    words = F.split(F.lower(F.regexp_replace(split_camel(value), "[^A-Za-z0-9]+", " ")), r"\s+")
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, GENERIC_TERMS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def divergent_terms(a: Column, b: Column) -> tuple[Column, Column]:
    """Terms of two paths after the directories that they begin with in common."""
    x, y = F.split(F.translate(a, "\\", "/"), "/"), F.split(F.translate(b, "\\", "/"), "/")
    most = F.least(F.size(x), F.size(y)) - 1
    place = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    apart = F.filter(place, lambda i: (i > most) | (F.lower(F.element_at(x, i)) != F.lower(F.element_at(y, i))))
    common = F.when(most < 1, 0).otherwise(F.coalesce(F.element_at(F.when(F.size(apart) > 0, apart), 1) - 1, most))
    rest = lambda p: split_terms(F.array_join(F.slice(p, common + 1, F.size(p)), "/"))
    return rest(x), rest(y)


def short_label(id: Column) -> Column:
    """The last namespace segment."""
    return F.substring_index(id, "\\", -1)


def estimate_tokens(text: Column, per: float = 4) -> Column:
    """About how many tokens a text takes."""
    return F.ceil(F.length(text) / per).cast("long")


def fetch_path(path: Column) -> Column:
    """The path that a request written in code asks for: from `/api/vN/` on, or else without the hosts put in before it."""
    p = F.regexp_replace(F.regexp_replace(path, r"\$\{[^}]+\}", "{param}"), "/+", "/")
    api = F.regexp_extract(p, r"/?(api/v\d+/[^?\s]*)", 1)
    bare = F.regexp_replace(p, r"^(\{[^{}]+\})+", "")
    return F.when(api != "", F.concat(F.lit("/"), api)).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def location(file: Column, start: Column, end: Column) -> Column:
    """`file:start-end`, a question mark for a row that isn't known; null without a file."""
    row = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.when(file != "", F.concat(file, F.lit(":"), row(start), F.lit("-"), row(end)))


# Tags of SVG and MathML that have a dash and are no components.
DASHED_TAGS = ("annotation-xml", "color-profile", "font-face", "font-face-src", "font-face-uri", "font-face-format", "font-face-name", "missing-glyph")


def component_name(tag: Column) -> Column:
    """The component that a tag names (`user-card` and `userCard`: `UserCard`); null for tags that the standards reserve."""
    upper = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))
    parts = F.split(tag, "-")
    joined = F.transform(parts, lambda w, n: F.when((n == 0) | w.rlike("^[0-9]"), w).when(w.rlike("^[a-z]"), upper(w)).otherwise(F.concat(F.lit("-"), w)))
    return F.when(tag.isin(*DASHED_TAGS), F.lit(None)).otherwise(upper(F.array_join(joined, "")))


def workspace_matches(actual: Column, wanted: str) -> Column:
    """Whether a workspace is the one asked for, or ends with it, whatever its case and separators."""
    a = F.lower(F.translate(actual, "\\", "/"))
    w = wanted.replace("\\", "/").lower()
    return F.coalesce((a == w) | a.endswith("/" + w), F.lit(False))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob with `*`."""
    import re

    return "^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$"
