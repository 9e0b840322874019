"""Rule-based 1-5 ratings of name fields, and the scales they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATINGS = [
    "funder_org_type",
    "installer_quality",
    "location_type",
    "scheme_pattern",
    "text_language",
    "coordination",
]

# The default of each rating when a response lacks it.
RATING_DEFAULTS = {
    "funder_org_type": 3,
    "installer_quality": 3,
    "location_type": 5,
    "scheme_pattern": 3,
    "text_language": 3,
    "coordination": 3,
}

# What 1 to 5 mean on each scale.
RATING_SCALES = {
    "funder_org_type": ["Government", "International", "NGO/Charity", "Religious", "Private"],
    "installer_quality": ["Very Poor", "Poor", "Fair", "Good", "Excellent"],
    "location_type": ["School", "Religious", "Health", "Government", "Village/None"],
    "scheme_pattern": ["Invalid", "Code Only", "Location Only", "Descriptive", "Full Name"],
    "text_language": ["English Only", "Mostly English", "Mixed", "Mostly Local", "Local Only"],
    "coordination": ["Perfect", "Good", "Neutral", "Poor", "Red Flag"],
}

# Keyword lists per rating value, first match wins.
FUNDER_WORDS = [
    (1, ["government", "ministry", "district"]),
    (2, ["world bank", "unicef", "danida"]),
    (3, ["vision", "foundation"]),
    (4, ["church", "mission"]),
]
LOCATION_WORDS = [
    (1, ["school", "shule"]),
    (2, ["church", "kanisa"]),
    (3, ["hospital", "dispensary"]),
]
SCHEME_WATER_WORDS = ["maji", "water", "pipe", "scheme"]
SCHEME_TYPE_WORDS = ["gravity", "spring", "bore", "well", "pump"]
LOCAL_WORDS = ["maji", "shule", "kanisa", "halmashauri", "msingi", "dini", "afya", "serikali"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit("nan"))


def _any(c: Column, words: list[str]) -> Column:
    lowered = F.lower(_text(c))
    out = F.lit(False)
    for word in words:
        out = out | lowered.contains(word)
    return out


def _first_match(c: Column, table: list[tuple[int, list[str]]], default: int) -> Column:
    rating = None
    for value, words in table:
        rating = F.when(_any(c, words), value) if rating is None else rating.when(_any(c, words), value)
    return rating.otherwise(default)


def rate_org_type(funder: Column) -> Column:
    return _first_match(funder, FUNDER_WORDS, 5)


# Texts that stand for a missing name, and the longest names of quality 1, 2 and 3.
MISSING_NAMES = ["0", "nan"]
NAME_LENGTHS = [1, 3, 10]


def rate_name_quality(name: Column) -> Column:
    text = _text(name)
    out = F.when(text.isin(*MISSING_NAMES), 1)
    for quality, longest in enumerate(NAME_LENGTHS, start=1):
        out = out.when(F.length(text) <= longest, quality)
    return out.otherwise(len(NAME_LENGTHS) + 1)


def rate_location(place: Column) -> Column:
    return _first_match(place, LOCATION_WORDS, 5)


def rate_scheme(name: Column) -> Column:
    """Water word and type word 5, water word 4, placeholder 1, short code 2, else place 3."""
    text = _text(name)
    return (
        F.when(text.isin("0", "nan") | (F.length(text) <= 1), 1)
        .when(_any(name, SCHEME_WATER_WORDS) & _any(name, SCHEME_TYPE_WORDS), 5)
        .when(_any(name, SCHEME_WATER_WORDS), 4)
        .when((F.length(text) <= 4) | text.rlike("[0-9]") | text.rlike("^[A-Z]{2} "), 2)
        .otherwise(3)
    )


def rate_language(*fields: Column) -> Column:
    """Share of the given fields with a local word, spread over the scale."""
    hits = F.lit(0)
    for c in fields:
        hits = hits + _any(c, LOCAL_WORDS).cast("int")
    share = hits.cast("double") / F.lit(float(len(fields)))
    return (
        F.when(share == 0, 1).when(share < 0.5, 2).when(share == 0.5, 3).when(share < 1, 4).otherwise(5)
    )


# Words that mark public and private organisations.
PUBLIC_FUNDER_WORDS = ["government", "ministry", "district"]
PUBLIC_INSTALLER_WORDS = ["government", "district", "council", "dwe", "rwe"]
PRIVATE_FUNDER_WORDS = ["private", "company"]


def rate_coordination(funder: Column, installer: Column) -> Column:
    f, i = F.lower(_text(funder)), F.lower(_text(installer))
    missing = f.isin(*MISSING_NAMES) | i.isin(*MISSING_NAMES)
    public_funder = _any(funder, PUBLIC_FUNDER_WORDS)
    public_installer = _any(installer, PUBLIC_INSTALLER_WORDS)
    return (
        F.when(missing, 5)
        .when(f == i, 1)
        .when(public_funder & public_installer, 2)
        .when(_any(funder, PRIVATE_FUNDER_WORDS) & public_installer, 4)
        .otherwise(3)
    )


def all_ratings(prefix: str = "") -> list[Column]:
    """The six ratings of a row that has the name columns, as ints in scale order."""
    c = F.col
    rules = [
        rate_org_type(c("funder")),
        rate_name_quality(c("installer")),
        rate_location(c("subvillage")),
        rate_scheme(c("scheme_name")),
        rate_language(c("funder"), c("ward"), c("subvillage")),
        rate_coordination(c("funder"), c("installer")),
    ]
    return [rule.cast("int").alias(prefix + name) for name, rule in zip(RATINGS, rules)]
