"""Template residue, filler and error pages in a corpus, found by alignment.

Texts are cut into segments (lines and sentences). Patterns only nominate:
segments with marked spans, names of fields, filler words or error wording.
What is flagged follows from aligning them over the whole corpus:

* Segments of the same template, filled ones included, are those with equal
  skeletons (spans, numbers and capitalised runs masked); segments that differ
  elsewhere are aligned at the place itself, by the literal words on both sides
  of a span. A place is a slot if its value varies between aligned records, or
  if records fill it. Brackets that read alike everywhere are wording.
* A mark that nobody fills (a blank, a default, an instruction, filler) is a
  slot that kept its default if its segment stands in different texts.
* A page is an error template if its wording is repeated over different texts.

A slot is flagged where it still holds a variable's name, a default or a blank;
this exact check reads the value's form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

SENTENCE = r"(?<=[.!?])\s+(?=[\p{Lu}\p{Lt}\p{Lo}\p{N}(\[{<$%_*@#\"'“„«-])"
_NAME = r"[#/]?\s*[A-Za-z_][\w.:-]*(?:\s[\w.:-]+){0,5}"
# Names of fields that templates leave in place of their value without any delimiter.
_BARE = r"(?:First|Last|Full|Given|Family|Company|Candidate|Client|Customer|Employer|Recruiter|Manager|Buyer|Recipient) Name|Job Title|Name Here"

# Marked spans of the usual template languages and mail forms, written so that Python and Java read them alike.
SPANS = {
    "tag": r"\{%.{1,60}?%\}|\{\{[#/!>].{0,60}?\}\}",
    "variable": rf"\{{\{{\{{?\s*{_NAME}\s*\}}?\}}\}}|\$\{{\s*{_NAME}\s*\}}|<<\s*{_NAME}\s*>>|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@|\*\|\s*{_NAME}\s*\|\*|<%=?\s*{_NAME}\s*%>"
    r"|(?<!_)__(?=[A-Za-z])[A-Za-z][\w.]*?[A-Za-z0-9]__(?!_)|\{\s*[A-Za-z_][\w.]{0,40}\s*\}|\{\d{1,2}\}|(?<![\w#])#[A-Za-z_][\w.]{1,40}#(?!\w)|(?<![\w%])%[A-Za-z_]{3,40}%(?!\w)",
    "bracket": r"\[\[[^\[\]]{1,80}\]\]|\[[^\[\]]{0,80}\]|<[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9 _.'’-]{2,60}>",
    "blank": r"_{3,}|\.{5,}|(?<![\w?])\?{3,}|\bx{4,}\b|\b(?-i:XXX)\b|\b(?:dd|tt|jj|mm)[./-](?:mm|dd)[./-](?:yyyy|yy|jjjj|aaaa)\b|\b(?:yyyy|jjjj|aaaa)-mm-(?:dd|tt|jj)\b|\bhh:mm\b",
    "default": r"(?<=[:=]|[:=] |\bhello |\bhi |\bdear |\bat |\bin |\bfor |\bto |\bby |\bfrom |\bhallo |\bbonjour |\bhola |\bchez |\bbei |\bà |\ben )(?:undefined|null|nan|\[object object\])(?=\s*(?:[,.;!]|$))",
    "bare": rf"(?<=\w )\b(?-i:{_BARE})\b",
}
_LOOKBEHIND = re.compile(r"\(\?<=([^()]*\|[^()]*)\)")


def _python_form(pattern: str) -> str:
    """Python wants lookbehinds of one width: alternatives become lookbehinds of their own."""
    return _LOOKBEHIND.sub(lambda m: "(?:" + "|".join(f"(?<={x})" for x in m[1].split("|")) + ")", pattern)


SPAN = re.compile("|".join(f"(?P<{kind}>{_python_form(p)})" for kind, p in SPANS.items()), re.IGNORECASE)
FIELD_WORDS = re.compile(
    r"\b(?:names?|titles?|company|employer|candidate|city|town|country|department|team|date|deadline|buyer|authority|salary|amount|location|address|office|e-?mail|phone|"
    r"manager|recruiter|recipient|lot|number|url|link|description|position|role|job|firma|name|ort|datum|stelle|abteilung|nom|ville|poste|entreprise|empresa|puesto|ciudad|fecha|nombre)\b",
    re.IGNORECASE,
)
INSTRUCTION = re.compile(
    r"\b(?:insert|enter|add|fill|type|your|replace|describe|tbd|tba|todo|to be (?:completed|confirmed|filled|added)|compléter|remplir|insérer|indiquer|einfügen|ausfüllen|eintragen|ergänzen|insertar|rellenar|completar|introducir)\b",
    re.IGNORECASE,
)
# Segments that speak of templates, shells or placeholders as their subject.
SUBJECT = re.compile(
    r"\b(?:handlebars|jinja2?|mustache|liquid|velocity|freemarker|templates?|templating|merge fields?|syntax|shell|bash|regex|environment variables?|square brackets|curly brac\w+|placeholders?|markdown|html|css|xpath|latex|vorlagen?|platzhalter|gabarits?|plantillas?)\b|\{%",
    re.IGNORECASE,
)
OPEN_SEGMENT = re.compile(
    r"(?:todo|fixme|tbd)\b\s*[:\-–].*|(?:your|insert|enter|add|sample) (?:own )?(?:text|copy|content|description)(?: goes)? here\b.*|insert .{0,60} here[.!]?"
    r"|hier (?:bitte )?(?:ihren )?text (?:einfügen|eingeben)\b.*|(?:insérez|saisissez|votre) .{0,20}texte ici\b.*|(?:inserte|su|introduzca) .{0,20}texto aquí\b.*"
    r"|\((?:add|insert|enter|describe|fill in|write|list|include|ajouter|hier|añadir)\b[^()]*\)",
    re.IGNORECASE,
)

# Words of the usual filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nullam risus eget urna mollis ornare vel leo "
    "vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae perspiciatis unde omnis iste natus error accusantium doloremque laudantium "
    "curabitur blandit tempus porttitor donec mi porta maecenas faucibus integer cras justo odio dapibus ac facilisis egestas aenean lacinia bibendum nulla "
    "cum sociis natoque penatibus magnis dis parturient montes nascetur ridiculus mus etiam pellentesque fusce tellus mauris condimentum nibh fermentum massa".split()
)
MASHED = frozenset("asdf asdfg asdfgh asdfasdf qwer qwert qwerty qwertz jkl sdf dfg fgh hjkl zxcv zxcvb yxcv uiop test testing foo bar baz blah bla xyz abc lala".split())
TRIAL = re.compile(
    r"(?:this is )?(?:a |just a |only a )?(?:sample|dummy|filler|placeholder|example|trial) (?:text|copy|posting|content|document)[.!]?"
    r"|(?:this is )?(?:just |only )?(?:a )?test (?:posting|post|job|entry|document|page|ad)\b.{0,30}\b(?:ignore|not apply|delete|disregard)\b.*|(?:please )?(?:ignore|disregard) this (?:test|posting|entry)\b.*"
    r"|(?:dies ist )?(?:nur )?(?:ein )?(?:blindtext|beispieltext|mustertext|testanzeige)\b.*|(?:ceci est )?(?:un )?(?:texte (?:d['’]exemple|factice|de test))\b.*|(?:esto es )?(?:un )?texto de (?:ejemplo|prueba)\b.*",
    re.IGNORECASE,
)

_CODE = r"(?:http )?(?:error |fehler |erreur )?\(?[1-5]\d\d\)?"
ERROR = re.compile(
    rf"(?:{_CODE}[\s:,–-]*)?(?:page )?(?:not found|bad gateway|forbidden|internal server error|service (?:temporarily )?unavailable|gateway time-?out|unauthorized|bad request|access (?:is |was )?denied|too many requests|request blocked|connection (?:refused|reset|timed out))(?:\s*\(?\d{{3}}\)?)?(?=\s*(?:$|[.!:(|–-])).{{0,80}}"
    r"|(?:fehler|erreur|error|errore)(?: code)?[\s:#]*\d{2,5}\b.{0,60}"
    r"|.{0,60}\b(?:url|page|resource|document|address)\b.{0,30}\b(?:was not found|could not be found|cannot be found|can['’]?t be found|no longer exists|does not exist|doesn['’]t exist)\b.{0,40}"
    r"|(?:die )?.{0,40}seite\b.{0,20}\b(?:nicht gefunden|existiert nicht|nicht (?:mehr )?verfügbar)\b.{0,30}"
    r"|.{0,30}p[áa]gina\b.{0,30}\bno (?:encontrada|existe|se encuentra|disponible)\b.{0,20}|.{0,20}page\b.{0,30}\b(?:introuvable|n['’]existe (?:pas|plus)|non trouvée)\b.{0,20}|pagina non trovata.{0,20}"
    r"|une erreur\b.{0,20}\best survenue\b.{0,30}|(?:ha ocurrido|se ha producido) un error\b.{0,40}|.{0,10}ist ein (?:\w+ )?fehler aufgetreten\b.{0,30}|si è verificato un errore\b.{0,30}"
    r"|(?:oops|ups|hoppla)\b.{0,60}|(?:sorry, )?something went wrong\b.{0,60}|an? (?:\w+ )?error (?:has )?occurred\b.{0,60}"
    r"|.{0,60}\b(?:enable|activate|allow|turn on|switch on|activez|activer|aktivieren|aktiviere|active|activar|habilite|attiva|attivare)\b.{0,20}\b(?:javascript|scripting|scripts|cookies)\b.{0,60}"
    r"|.{0,30}\b(?:javascript|scripting|cookies)\b.{0,20}\b(?:disabled|turned off|not enabled|not supported|désactivé|deaktiviert|desactivado|required to (?:view|use|run|see|continue))\b.{0,60}"
    r"|.{0,40}\b(?:does not|doesn['’]t|will not|cannot) (?:work|run|load) without (?:scripts|javascript|cookies)\b.{0,30}"
    r"|(?:your |this )?browser is (?:not|no longer|un)\s?supported\b.{0,60}|(?:please )?(?:turn|switch) on (?:java)?script(?:ing|s)?\b.{0,30}"
    r"|checking your browser\b.{0,100}|(?:please )?(?:verify|confirm|prove) (?:that )?you(?:['’]re| are) (?:a |not a )?(?:human|robot)\b.{0,60}"
    r"|(?:too many|slow down)\b.{0,20}\b(?:requests|try again)\b.{0,60}|you (?:do not|don['’]t) have (?:permission|access)\b.{0,60}|your (?:ip|request|access)\b.{0,30}\b(?:blocked|denied)\b.{0,60}"
    r"|(?:this |the |our )?(?:site|page|website|service|server|system) is (?:currently |temporarily )?(?:down|unavailable|offline|unable|under maintenance)\b.{0,100}"
    r"|(?:your )?session (?:has )?(?:expired|timed out)\b.{0,60}"
    r"|traceback \(most recent call last\).{0,80}|(?:exception in thread|fatal error|uncaught (?:type)?error)\b.{0,120}|\w*(?:error|exception): .{0,120}|\{\s*\"?(?:error|errors|fault)\"?\s*:.{0,300}\}?",
    re.IGNORECASE,
)
# What comes along with error messages, without being one by itself.
ALONGSIDE = re.compile(
    r"nginx.{0,12}|apache.{0,30}|cloudflare.{0,30}|back to (?:the )?(?:home|start).{0,20}|go back|(?:error )?(?:reference|request id|ray id|trace id|incident)\b.{0,60}|file \".{1,80}\", line \d+.{0,40}|at [\w.$]+\(.{0,60}\)"
    r"|(?:please )?(?:try again|reload|sign in again|contact)\b.{0,60}|(?:we|this) (?:will|may|should) .{0,60}|switch it on.{0,30}|slow down.{0,60}|.{0,20}error code\b.{0,20}",
    re.IGNORECASE,
)

# Nominations, looked up as plain words and pieces of the lower-cased text: a text or segment without any has no span, filler, instruction or error.
SPAN_CHARS = re.compile(r"[{\[<%@#_$*?]|\.{5}")
SPAN_SIGNS = re.compile(r"\{|\[|<[A-Za-zÀ-ÿ<%]|%[A-Za-z_%]|@@|#[A-Za-z_]|\*\||__|\?{3}|\.{5}")
SPAN_PIECES = ("xxx", "undefined", "null", " nan", ":nan", "=nan", "hh:mm", "yyyy", "jjjj", "aaaa", "dd/mm", "dd.mm", "dd-mm", "mm/dd", "mm.dd", "mm-dd", "tt.mm", "tt/mm", "tt-mm", "name here", "job title", " name")
FILLER_SIGNS = frozenset(w for w in FILLER_WORDS if len(w) > 4) | MASHED
OPEN_PIECES = (
    "todo", "fixme", "tbd", " here", "hier ", "texte ici", "texto aquí", "(add", "(insert", "(enter", "(describe", "(fill", "(write", "(list", "(include", "(ajouter", "(hier", "(añadir",
    "sample ", "dummy ", "filler ", "placeholder ", "example ", "trial ", "test ", "ignore this", "disregard this", "blindtext", "beispieltext", "mustertext", "testanzeige", "texte d", "texte factice", "texto de ",
)
ERROR_PIECES = (
    "not found", "gateway", "forbidden", "unavailable", "unauthorized", "request", "denied", "too many", "blocked", "connection", "fehler", "erreur", "error", "be found", "no longer", "not exist", "n't exist", "n’t exist",
    "gefunden", "existiert", "verfügbar", "encontrada", "existe", "encuentra", "disponible", "introuvable", "trouvée", "trovata", "oops", "ups", "hoppla", "went wrong", "script", "cookies", "browser", "human", "robot", "slow down", "permission",
    "your access", "is down", "currently", "temporarily", "offline", "is unable", "maintenance", "session", "traceback", "exception", "fault",
)
BULLET = r"[-*•–]\s+(?:\[[ xX✓]?\]\s+)?|\[[ xX✓]?\]\s+"
# Line ends with blanks, bullets and check boxes behind them, bullets within a line, and ends of sentences.
CUT = rf"\s*[\r\n]\s*(?:{BULLET})?|\s[-*•–]\s+\[[ xX✓]?\]\s+|{SENTENCE}"
_SENTENCE_CHARS = r"(?:[^\W_a-zß-ÿ]|[(\[{<$%_*@#\"'“„«-])"
_CUT = re.compile(rf"\s*[\r\n]\s*(?:{BULLET})?|\s[-*•–]\s+\[[ xX✓]?\]\s+|(?<=[.!?])\s+(?={_SENTENCE_CHARS})")
_HEAD = re.compile(BULLET)
JAVA_SPAN = "(?iU)" + "|".join(SPANS.values())
# Runs of capitalised words behind the first one, and numbers: what differs between filled records of a template.
VALUES = r"(\s)\p{Lu}[\p{L}\p{M}\p{N}'’&-]*(?:\s\p{Lu}[\p{L}\p{M}\p{N}'’&-]*)*|\d+(?:[.,:]\d+)*"
FOUND = "m string, segment string, lo long, hi long, unit string, before string, after string, value string, kind string"


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, without bullets, check boxes and blanks around; empty ones left out."""
    found = (s.strip() for s in _CUT.split(_HEAD.sub("", text.strip(), count=1) if _HEAD.match(text.strip()) else text))
    return [s for s in found if s]


def shape(segment: Column) -> Column:
    """Hash of a segment with its numbers and capitalised runs masked."""
    return F.xxhash64(F.lower(F.regexp_replace(segment, VALUES, "$1*")))


def plain_shapes(text: Column) -> Column:
    """The shapes of a text's segments; those with an undelimited name or a run of X in place of a value are no filled ones."""
    cut = F.filter(F.split(text, CUT), lambda s: (s != "") & ~s.contains("XXX") & ~s.contains(" Name") & ~s.contains("Job Title"))
    return F.array_distinct(F.transform(cut, lambda s: shape(F.trim(s))))


def masked(text: str) -> str:
    return re.sub(r"\d+", "#", re.sub(r"\s+", " ", text)).strip().lower()


def span_kind(match: re.Match) -> str:
    """variable, blank, default, instruction, field, bare, box or literal; tags of template languages are literals."""
    group = match.lastgroup
    if group in ("blank", "default", "bare", "variable"):
        return group
    if group == "tag":
        return "literal"
    inner = match[0].strip("[]<> ").strip("_")
    if not inner.strip(" ._-…"):
        return "blank" if re.search(r"[._…-]{2}", match[0]) else "box"
    if not re.search(r"[^\W\d_]{2}", inner):  # numbers, single characters and marks are references or code
        return "literal"
    if INSTRUCTION.search(inner):
        return "instruction"
    if re.search(r"\w[_.]\w|[a-z][A-Z]|^[A-Z][A-Z_]{2,}$", inner) or FIELD_WORDS.search(inner):
        return "field"
    return "literal"


def _any_of(pieces: tuple[str, ...], low: str) -> bool:
    return any(piece in low for piece in pieces)


def is_filler(segment: str) -> bool:
    if TRIAL.fullmatch(segment.strip(" -*•\t")):
        return True
    words = re.findall(r"[^\W\d_]+", segment.lower())
    if len(words) < 3:
        return False
    if sum(w in FILLER_WORDS for w in words) >= 0.7 * len(words) and sum(len(w) > 3 and w in FILLER_WORDS for w in words) >= 3:
        return True
    if sum(w in MASHED for w in words) >= 0.7 * len(words):
        return True
    return len(words) >= 4 and len(set(words)) == 1


def page_of(parts: list[str]) -> str | None:
    """Masked wording of a page that holds an error message and at most one segment of other content, else None."""
    errors, content, wording = 0, 0, []
    for part in parts:
        if content > 1:  # a page with real content, whatever else it says
            return None
        if _any_of(ERROR_PIECES, part.lower()) and ERROR.fullmatch(part):
            errors += 1
            wording.append(masked(part))
        elif ALONGSIDE.fullmatch(part):
            wording.append(masked(part))
        elif len(part) > 45 or part.endswith((".", "!", "?")) and len(part.split()) > 4:
            content += 1
            wording.append(masked(part))
    return " | ".join(wording) if errors and content < 2 else None


def _literal(text: str, last: bool) -> str:
    """The word or mark next to a span, lower-cased; ^ or $ at the segment's bound."""
    found = re.findall(r"\w+|[^\w\s]", text.lower())
    return (found[-1] if last else found[0]) if found else ("^" if last else "$")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, instructions and filler of distinct nominated segments."""
    for batch in batches:
        rows: list[tuple] = []
        for m, segment, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("m", "segment", "lo", "hi"))):
            head = (m, segment, lo, hi)
            if OPEN_SEGMENT.fullmatch(segment):
                rows.append((*head, "slot", "^", "$", m, "instruction"))
                continue
            if is_filler(segment):
                rows.append((*head, "filler", None, None, None, None))
                continue
            spans = [(s, span_kind(s)) for s in SPAN.finditer(segment)]
            if all(kind == "literal" for _, kind in spans) or SUBJECT.search(SPAN.sub(" ", segment)) or "{%" in segment:
                continue
            for span, kind in spans:
                before, after = SPAN.sub("*", segment[: span.start()]), SPAN.sub("*", segment[span.end() :])
                rows.append((*head, "slot", _literal(before, True), _literal(after, False), span[0].strip("[]<>{}$%@*|#= _").lower(), kind))
        columns = list(zip(*rows)) if rows else [()] * 9
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["m", "segment", "lo", "hi", "unit", "before", "after", "value", "kind"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


SPAN_SIGN, OPEN_SIGN, ERROR_SIGN = 1, 2, 4


@lru_cache(maxsize=1)
def _signs():
    """One automaton of all pieces, so that a text is read once for all of them."""
    import ahocorasick

    bits: dict[str, int] = {}
    for pieces, bit in ((SPAN_PIECES, SPAN_SIGN), (OPEN_PIECES, OPEN_SIGN), (ERROR_PIECES, ERROR_SIGN)):
        for piece in pieces:
            bits[piece] = bits.get(piece, 0) | bit
    built = ahocorasick.Automaton()
    for piece, bit in bits.items():
        built.add_word(piece, bit)
    built.make_automaton()
    return built


def _signs_in(low: str) -> int:
    found = 0
    for _, bit in _signs().iter(low):
        found |= bit
    return found


def _has_span(low: str, text: str) -> bool:
    return SPAN_CHARS.search(text) is not None and SPAN_SIGNS.search(text) is not None or _any_of(SPAN_PIECES, low)


def _has_filler(low: str) -> bool:
    words = low.split()
    return not FILLER_SIGNS.isdisjoint(words) or sum(map(eq, words, words[1:])) > 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nominated segments of each text, and the masked wording of what may be an error page."""
    for batch in batches:
        uids, kept, pages = [], [], []
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
            low = text.lower()
            signs, filler = _signs_in(low), _has_filler(low)
            span = signs & SPAN_SIGN or SPAN_CHARS.search(text) is not None and SPAN_SIGNS.search(text) is not None
            opened, error = signs & OPEN_SIGN, signs & ERROR_SIGN
            if not (span or filler or opened or error):
                continue
            parts = segments(text)
            found = [p for p in parts if span and _has_span(p.lower(), p) or filler and _has_filler(p.lower()) or opened and (OPEN_SEGMENT.fullmatch(p) or TRIAL.fullmatch(p))]
            page = page_of(parts) if error else None
            if found or page is not None:
                uids.append(uid)
                kept.append(list(dict.fromkeys(found)))
                pages.append(page)
        arrays = [pa.array(uids, pa.int64()), pa.array(kept, pa.list_(pa.string())), pa.array(pages, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "nominated", "page"])


def find_residue(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, reason) of every flagged row: `slot`, `filler` or `page`.

    Null, empty and blank texts are never flagged. Rows with equal keys are one
    record; equal texts are one text, so copies align with nothing and are
    flagged together. What stands in a single text of the collection, with no
    other to align it with, isn't flagged. Texts of any length are read whole.
    """
    rows = df.select(key.alias("key"), text.alias("text")).where(F.col("text").rlike(r"\S")).withColumn("uid", F.xxhash64("text"))
    cut = materialize(rows.select("uid", "text").mapInArrow(_cut, "uid long, nominated array<string>, page string"), "nominated")
    nominated = cut.select("uid", F.explode("nominated").alias("segment"))
    nominated = nominated.withColumn("m", F.lower(F.regexp_replace(F.regexp_replace("segment", r"\s+", " "), r"\d+", "#")))
    # Counts of different texts only need to tell one from more, so the least and greatest hash do, combined before the shuffle.
    distinct = nominated.groupBy("m").agg(F.min("segment").alias("segment"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    marks = materialize(distinct.select("m", "segment", "lo", "hi").mapInArrow(_marks, FOUND), "marks")

    slots = marks.where(F.col("unit") == "slot").withColumn("skeleton", shape(F.regexp_replace("segment", JAVA_SPAN, "*")))
    several = F.col("lo") < F.col("hi")
    places = slots.groupBy("before", "after").agg((F.min("value") < F.max("value")).alias("varies"), (F.min("lo") < F.max("hi")).alias("several"))
    varied = places.where("varies and several").select("before", "after")
    shapes = slots.select("skeleton").distinct()
    filled = rows.select(F.explode(plain_shapes(F.col("text"))).alias("skeleton")).join(shapes, "skeleton", "left_semi").distinct()
    residue = slots.where(F.col("kind") != "literal")
    kept = [
        # Places that vary between aligned records; names without delimiters and boxes need records that fill them.
        residue.where(~F.col("kind").isin("bare", "box")).join(varied, ["before", "after"], "left_semi"),
        residue.join(filled, "skeleton", "left_semi"),
        # Marks that nobody fills, in different texts.
        residue.where(F.col("kind").isin("blank", "default", "instruction") & several),
    ]
    found = kept[0].select("m")
    for part in kept[1:]:
        found = found.unionByName(part.select("m"))
    wordings = found.withColumn("reason", F.lit("slot")).unionByName(marks.where((F.col("unit") == "filler") & several).select("m", F.lit("filler").alias("reason")))
    by_segment = nominated.select("uid", "m").join(wordings.distinct(), "m").select("uid", "reason")

    pages = cut.where(F.col("page").isNotNull()).select("uid", F.col("page").alias("wording"))
    repeated = pages.groupBy("wording").agg((F.min("uid") < F.max("uid")).alias("several")).where("several").select("wording")
    by_page = pages.join(repeated, "wording", "left_semi").select("uid", F.lit("page").alias("reason"))
    flagged = by_segment.unionByName(by_page).distinct()
    return rows.select("key", "uid").join(flagged, "uid").select("key", "reason").distinct()
