"""Classification of texts by ordered rules: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import match_key

Rules = Sequence[tuple[str, str]]


def first_match(text: Column, rules: Rules, otherwise: str | None = None) -> Column:
    """The label of the first (pattern, label) whose pattern occurs in ``text``; patterns suit RE2 and Java alike."""
    found = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        found = F.when(text.rlike(pattern), label).otherwise(found)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def rules_sql(text: str, rules: Rules, otherwise: str | None = None) -> str:
    """The same classification as a SQL expression."""
    whens = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(text, p.replace("'", "''"), label) for p, label in rules)
    return f"CASE {whens} ELSE {'NULL' if otherwise is None else repr(otherwise)} END"


# Level words in titles, most telling first; matched on folded lower-case words.
LEVEL_RULES: Rules = (
    (r"\b(intern|interns|internship|trainee|apprentice|werkstudent|working student|praktikant|praktikum|stagiaire|alternant|becario)\b", "intern"),
    (r"\b(chief [a-z ]*officer|ceo|cto|cfo|coo|svp|evp|managing director|founder|geschaftsfuhrer)\b", "executive"),
    (r"\b(director|directeur|directrice|direktor|vp|vice president|head of)\b", "director"),
    (r"\b(engineering|sales|office|store|team|plant|hr|finance|general|regional|operations|marketing) manager\b|\b(abteilungsleiter|leiter|gerente|responsable)\b", "manager"),
    (r"\b(team lead|tech lead|lead|supervisor|foreman|teamleiter)\b", "lead"),
    (r"\b(senior|sr|snr|principal|staff|expert|iii|iv)\b", "senior"),
    (r"\b(mid level|intermediate|medior|experienced|ii)\b", "mid"),
    (r"\b(junior|jr|entry level|graduate|new grad|associate|debutant)\b", "entry"),
)

EMPLOYMENT_RULES: Rules = (
    (r"\bintern(ship)?s?\b|trainee|apprentice|werkstudent|working student|\bstage\b|stagiaire", "internship"),
    (r"part ?time|teilzeit", "part_time"),
    (r"contract|freelance|consultant|interim", "contract"),
    (r"full ?time|permanent|regular|vollzeit|salaried|employee", "full_time"),
    (r"temp|fixed term|seasonal|casual", "temporary"),
)


def seniority(title: Column, published: Column | None = None) -> Column:
    """The level that a title's words state, else the one the source publishes; null for neither."""
    found = first_match(match_key(title), LEVEL_RULES)
    if published is None:
        return found
    levels = [label for _, label in LEVEL_RULES]
    return F.coalesce(found, F.when(published.isin(levels), published))


def employment_type(text: Column) -> Column:
    key = match_key(text)
    return F.when(key != "", first_match(key, EMPLOYMENT_RULES, "other"))


_SPELLED = {w: i for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}
_AMOUNT = "[0-9]{1,2}|" + "|".join(_SPELLED)
YEARS = rf"(?i)(?:^|[^\w.])(up to |at most |maximum |under |less than |bis zu |jusqu.à |hasta )?({_AMOUNT}) ?(?:\+|plus)? ?(?:(?:-|–|to|bis|à) ?[0-9]{{1,2}} ?\+? ?)?(?:years?|yrs?|jahren?|ans|années|años)\b"
WORKED = r"(?i)experien|expérien|erfahrung|background|worked|working|track record|expertise|practice"
AGE = r"(?i)years? old|ago\b|founded|our company|our history|we have|warranty|for over [0-9]+ years|since [0-9]{4}"
HEADING = r"^\W*\p{L}[\p{L} /&'’-]{2,40}:?\s*$"
WISHED = r"(?i)nice to have|preferred|bonus|optional|desirable|wünschenswert|von vorteil|atouts?\b|deseable"


def years_asked(text: Column) -> Column:
    """The least years of experience that a text's first line about them asks for, 1 to 20; null for none.

    Read line by line with the section in mind: below a heading of wishes
    nothing counts until the next heading. Ceilings, ages and the age of a
    company don't count.
    """
    spelled = F.create_map(*[F.lit(x) for pair in _SPELLED.items() for x in pair])

    def step(acc: Column, line: Column) -> Column:
        said = F.lower(F.regexp_extract(line, YEARS, 2))
        n = F.coalesce(F.try_element_at(spelled, said), said.try_cast("int"))
        asked = line.rlike(WORKED) & ~line.rlike(AGE) & (F.regexp_extract(line, YEARS, 1) == "") & n.between(1, 20)
        heading = line.rlike(HEADING)
        wished = F.when(heading, line.rlike(WISHED)).otherwise(acc["wished"])
        return F.struct(wished.alias("wished"), F.coalesce(acc["years"], F.when(asked & ~wished & ~line.rlike(WISHED), n)).alias("years"))

    start = F.struct(F.lit(False).alias("wished"), F.lit(None).cast("int").alias("years"))
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.aggregate(lines, start, step, lambda acc: acc["years"])


SPONSORSHIP = r"(?i)\bvisas?\b|\bsponsor|work permit|\bh-?1b\b|\bvisum\b|parrainage"
DENIED = r"(?i)\b(?:no|not|never|cannot|unable|without|kein|keine|ohne|pas|aucune?|sin)\b|n['’]t\b"
HEDGED = r"(?i)\b(?:may|might|could|possibl[ey]|case[ -]by[ -]case|depend\w*|limited|subject to|consider\w*)\b"
OFFERED = r"(?i)\b(?:available|offer\w*|provid\w*|support\w*|sponsor(?:s|ed)?|help\w*|assist\w*|cover\w*)\b"


def visa_offered(text: Column) -> Column:
    """Whether a text offers sponsorship, by its sentences on it: one that denies decides, then one that offers; hedges tell nothing."""
    said = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?;\r\n]+"), lambda s: s.rlike(SPONSORSHIP))
    no = F.exists(said, lambda s: s.rlike(DENIED))
    yes = F.exists(said, lambda s: s.rlike(OFFERED) & ~s.rlike(HEDGED))
    return F.when(no, False).when(yes, True)
