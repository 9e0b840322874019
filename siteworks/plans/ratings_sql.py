"""The rule ratings written as SQL, for cross-checks only."""

from siteworks.functions import ratings as r


def _any(column, words):
    return "(" + " or ".join(f"contains(lower(coalesce({column}, 'nan')), '{w}')" for w in words) + ")"


def _first(column, table, default):
    return "case " + " ".join(f"when {_any(column, words)} then {v}" for v, words in table) + f" else {default} end"


def _text(column):
    return f"coalesce({column}, 'nan')"


ORG_SQL = _first("funder", r.FUNDER_WORDS, 5)
QUALITY_SQL = (f"case when {_text('installer')} in ('0', 'nan') or length({_text('installer')}) <= 1 then 1 "
               f"when length({_text('installer')}) <= 3 then 2 when length({_text('installer')}) <= 10 then 3 else 4 end")
LOCATION_SQL = _first("subvillage", r.LOCATION_WORDS, 5)
_S = _text("scheme_name")
_WATER, _TYPE = _any("scheme_name", r.SCHEME_WATER_WORDS), _any("scheme_name", r.SCHEME_TYPE_WORDS)
SCHEME_SQL = (f"case when {_S} in ('0', 'nan') or length({_S}) <= 1 then 1 when {_WATER} and {_TYPE} then 5 when {_WATER} then 4 "
              f"when length({_S}) <= 4 or regexp_matches({_S}, '[0-9]') or regexp_matches({_S}, '^[A-Z]{{2}} ') then 2 else 3 end")
_HITS = " + ".join(f"cast({_any(c, r.LOCAL_WORDS)} as int)" for c in ["funder", "ward", "subvillage"])
LANGUAGE_SQL = f"case when ({_HITS}) = 0 then 1 when ({_HITS}) = 1 then 2 when ({_HITS}) = 2 then 4 else 5 end"
_F, _I = "lower(coalesce(funder, 'nan'))", "lower(coalesce(installer, 'nan'))"
_PUBLIC = _any("installer", ["government", "district", "council", "dwe", "rwe"])
COORDINATION_SQL = (f"case when {_F} in ('0', 'nan') or {_I} in ('0', 'nan') then 5 when {_F} = {_I} then 1 "
                    f"when {_any('funder', ['government', 'ministry', 'district'])} and {_PUBLIC} then 2 "
                    f"when {_any('funder', ['private', 'company'])} and {_PUBLIC} then 4 else 3 end")

RULES_SQL = dict(zip(r.RATINGS, [ORG_SQL, QUALITY_SQL, LOCATION_SQL, SCHEME_SQL, LANGUAGE_SQL, COORDINATION_SQL]))
# A CTE to follow the sites view: id and the six ratings.
RATED_SQL = ", rated as (select id, " + ", ".join(f"cast({sql} as int) as {name}" for name, sql in RULES_SQL.items()) + " from sites) "
