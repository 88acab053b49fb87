"""Incident-report extractors as native column expressions.

Each function maps a string column (a report field or the free-text narrative)
to a feature column.  They are built from Spark SQL string/date functions, so
Catalyst can prune, push down and code-generate them; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and phrases the extractors look for.  They must equal
# the reference's lists for equal results.
LOCATION_CODES = [("Farm", "1"), ("Residenti", "2"), ("Commerci", "3"), ("Publi", "4")]
ENTRY_SIDES = ["PREMISES-REAR", "PREMISES-FRONT", "PREMISES-SIDE"]
ENTRY_POINTS = [
    ("POINT OF ENTRY-DOOR", "POE - DOOR"),
    ("POINT OF ENTRY-WINDOW", "POE - WINDOW"),
    ("POINT OF ENTRY-FENCE", "POE - FENCE"),
    ("POINT OF ENTRY-DOOR: GARAGE", "POE - GARAGE"),
]
SIGNATURE_CODES = [("DEFECA", "1"), ("URINAT", "2"), ("MASTURB", "3"), ("GRAFFIT", "4")]
NEGATIONS = ["NOT ", "NO ", "HAVEN'T", "DIDN'T", "DIDNT", "HAVENT"]
MESSY_WORDS = ["MESSY", "MESSIL", "RUMMAG", "TIPPED"]
SECURE_WORDS = ["LOCKED", "FENCED", "GATED", "SECURED", "BOLTED"]
CREATED_BY = "__________________________________ CREATED BY"
SECTION_WORDS = "NARRATIVE|CIRCUMSTANCES"
UNKNOWN = "UNKNOWN"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(c: Column, pairs) -> Column:
    """First (needle, value) whose needle occurs in c; else UNKNOWN; null stays null."""
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for needle, value in pairs:
        expr = expr.when(c.contains(needle), F.lit(value))
    return expr.otherwise(F.lit(UNKNOWN))


def location_type(c) -> Column:
    """X1: '1' farm, '2' residential, '3' commercial, '4' public, else UNKNOWN."""
    return _first_match(_col(c), LOCATION_CODES)


def ordinal_day(c) -> Column:
    """Proleptic Gregorian ordinal of a trimmed d/M/yyyy date (0001-01-01 is 1)."""
    d = F.try_to_date(F.trim(_col(c)), "d/M/yyyy")
    return (F.datediff(d, F.lit("0001-01-01").cast("date")) + 1).cast("int")


def hour_of(c, fix_noon: bool = False) -> Column:
    """Hour before the first ':'; +12 when the text holds PM.

    The reference turns '12:30 PM' into 24 and '12:30 AM' into 12; ``fix_noon``
    maps those to 12 and 0 instead.
    """
    c = _col(c)
    h = F.trim(F.split(c, ":").getItem(0)).try_cast("int")
    pm = c.contains("PM")
    if fix_noon:
        h = F.when(h == 12, F.lit(0)).otherwise(h)
    return (h + F.when(pm, F.lit(12)).otherwise(F.lit(0))).cast("int")


def entry_side(c) -> Column:
    """First premises side named in the narrative."""
    return _first_match(_col(c), [(x, x) for x in ENTRY_SIDES])


def entry_point(c) -> Column:
    """First point of entry; either spelling maps to the long one."""
    c = _col(c)
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for long_form, short_form in ENTRY_POINTS:
        expr = expr.when(c.contains(long_form) | c.contains(short_form), F.lit(long_form))
    return expr.otherwise(F.lit(UNKNOWN))


def weekday_of(c) -> Column:
    """Weekday of a d/M/yyyy date, Monday = 0 (not trimmed)."""
    return F.weekday(F.try_to_date(_col(c), "d/M/yyyy")).cast("int")


def grid_key(northing, easting) -> Column:
    """X7: 'northing-easting' text key."""
    return F.concat_ws("-", _col(northing).cast("string"), _col(easting).cast("string"))


def narrative_section(c) -> Column:
    """The method-of-entry part of a narrative.

    Null -> ''.  Take the text after the last CREATED BY line; if it names a
    NARRATIVE or CIRCUMSTANCES heading, keep what follows the last one, drop its
    first character and cut at the first '*' or ':'.
    """
    c = F.coalesce(_col(c), F.lit(""))
    tail = F.element_at(F.split(c, CREATED_BY, -1), -1)
    after = F.element_at(F.split(tail, SECTION_WORDS, -1), -1)
    cut = F.split(F.substring(after, 2, 1 << 30), r"[*:]", -1).getItem(0)
    has_heading = tail.contains("NARRATIVE") | tail.contains("CIRCUMSTANCES")
    return F.when(has_heading, cut).otherwise(tail)


def _alternation(words) -> str:
    # words hold only letters, blanks and apostrophes: no regex escaping needed
    return "|".join(words)


def sentence_vote(c, words, negations=NEGATIONS) -> Column:
    """Vote over '.'-sentences that hold any of ``words``: +1, or -1 when the
    sentence also holds a negation.  1 if the sum is positive, else 0."""
    c = _col(c)
    hit = _alternation(words)
    neg = _alternation(negations)
    sentences = F.filter(F.split(c, r"\.", -1), lambda s: s.rlike(hit))
    total = F.aggregate(
        sentences, F.lit(0),
        lambda acc, s: acc + F.when(s.rlike(neg), F.lit(-1)).otherwise(F.lit(1)))
    return F.when(c.isNull(), F.lit(None).cast("int")) \
        .otherwise(F.when(total > 0, F.lit(1)).otherwise(F.lit(0)))


def search_messy(c) -> Column:
    """Was the search messy (vote on MESSY/MESSIL/RUMMAG/TIPPED)."""
    return sentence_vote(c, MESSY_WORDS)


def signature_act(c) -> Column:
    """Signature act category '1'..'4' or UNKNOWN."""
    return _first_match(_col(c), SIGNATURE_CODES)


def property_secured(c) -> Column:
    """Was the property secured (vote on LOCKED/FENCED/GATED/SECURED/BOLTED)."""
    return sentence_vote(c, SECURE_WORDS)


def fingerprint(c, bits: int = 256) -> Column:
    """SHA-2 hex digest of the UTF-8 text (the reference uses 224 bits)."""
    return F.sha2(_col(c), bits)
