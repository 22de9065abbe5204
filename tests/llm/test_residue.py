import pytest
from pyspark.sql import functions as F

from weirflow.llm.residue import CUT, ERROR, ERROR_PIECES, JAVA_SPAN, SPAN, find_residue, segments

CONTENT = "You report to the head of clinical and guide {n} engineers across Seville and Perth.\nWe expect {n} years with Kotlin.\n"
# Two records of each template with different names left in it.
VARIABLES = [
    ("Dear {{first_name}}, thank you.", "Dear {{company}}, thank you."), ("Le poste est situé à [department].", "Le poste est situé à [office.city]."), ("Please reply to %%buyer%% before <<deadline>>.", "Please reply to @@company@@ before ${CITY}."),
    ("Join __company_name__ as our next Data Engineer.", "Join __job.title__ as our next Copy Editor."), ("The salary is ${SALARY_MIN} per year.", "The salary is *|SALARY_MAX|* per year."), ("Bewerben Sie sich bei <%= company %> in *|CITY|*.", "Bewerben Sie sich bei #start_date# in #office#."),
    ("{0} is hiring {1} people in {2}.", "{3} is hiring {2} people in {1}."), ("At <<department>> we label routes for buyers.", "At {{city}} we plan rosters for fitters."), ("[Name of contracting authority]", "<Enter job title>"),
]
# Marks that nobody fills, filler and error pages: the same in different texts.
REPEATED = [
    "Hello null, welcome to the team at null.", "Company: undefined, Location: undefined", "Salary: £____ to £____", "Starting on dd/mm/yyyy at 09:00", "[INSERT COMPANY DESCRIPTION HERE]", "(add three bullet points about the role)", "Hier Text einfügen",
    "[à compléter]", "XXXX years of experience with XXXX required.", "TODO: describe the benefits", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf asdf asdf qwer qwer test test", "This is sample text. This is sample text.",
    "Test posting please ignore test test 123", "Blah blah blah blah blah.",
]
PAGES = [
    "404 Not Found\nThe requested URL was not found on this server.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "Erreur {n}\nUne erreur interne est survenue.", "Access Denied\nYou do not have permission to view this page.\nReference {n}.4",
    "Seite nicht gefunden\nDie von Ihnen aufgerufene Seite existiert nicht mehr.", '{"error":{"code":{n},"message":"upstream failed"}}', "Traceback (most recent call last):\n  File \"render.py\", line {n}, in page\nKeyError: 'posting'", "Checking your browser before you continue... This may take {n} seconds.",
]
REAL = [
    None, "", " \n ", CONTENT, CONTENT + "Our designers never ship lorem ipsum to clients: real copy comes first.", CONTENT + "JavaScript is required for this role; TypeScript is a plus.", CONTENT + "Salary [gross] is paid on the 5th.",
    CONTENT + "You will write Handlebars templates such as {{#each items}} and unit test them.", CONTENT + "Kenntnisse in Jinja ({% for %}, {{ variable }}) sind von Vorteil.", CONTENT + "Export ${HOME}/bin in your shell before the coding task.",
    CONTENT + "Access denied alarms from the badge system go to the audit desk.", CONTENT + 'The migration log said "page not found" 12 times; we learned from it.', CONTENT + "Vous testerez la page d’erreur 404 du site.", CONTENT + "if (a<b && c>0) { return a[3]; }",
    CONTENT + "Error pages, maintenance windows and retries are part of the on-call week.", CONTENT + "You fill {company} style merge fields in mail campaigns for nurses.", "- [x] Skip to main content\n" + CONTENT, "Please enable two-factor sign-in on your first day.\n" + CONTENT,
    CONTENT + "- [ ] automate crane inspections for Tampa\n- [x] ship design tokens\n[] write notes", CONTENT + "See [Smith 2020] and [3].", "- [ ] plan routes for Bergen - [ ] label tokens for Bari Index grew.\n" + CONTENT,
]


def at(text, n):
    return text.replace("{n}", str(n)) if text else text


def flagged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("template", F.lit("clash")).withColumn("uid", F.lit("clash"))
    return {r.key: r.reason for r in find_residue(df, F.col("id"), F.col("text")).collect()}


def test_residue_and_real_text(spark):
    texts = [at(CONTENT + x, n) for pair in VARIABLES for n, x in enumerate(pair, 3)]
    texts += [at(f"{x}\n{CONTENT}", n) for x in REPEATED for n in (5, 6)]
    texts += [at(f"Home | Jobs\n{x}", 41) for x in PAGES] + [at(f"{x}\nMenu  Search  Sign in", 57) for x in PAGES]
    true = len(texts)
    texts += [at(x, n) for x in REAL for n in (7, 8)]
    found = flagged(spark, texts)
    assert [t for i, t in enumerate(texts[:true]) if i not in found] == [] and [t for i, t in enumerate(texts) if i >= true and i in found] == []


def test_without_alignment_nothing_is_found(spark):
    """One record of each template has nothing to be aligned with; copies of one text are that text."""
    texts = [at(CONTENT + first, 100 + n) for n, (first, _) in enumerate(VARIABLES[1:6])] + [at(f"{x}\n{CONTENT}", n) for n, x in enumerate(REPEATED[:4] + REPEATED[8:9] + REPEATED[10:])] + [at(x, 41) for x in PAGES]
    assert flagged(spark, texts) == {} and flagged(spark, texts * 2) == {}


def test_filled_records_make_a_slot(spark):
    """A record that fills the place shows it to be one, for names without delimiters too."""
    filled = [f"Dear {x}, thank you for your interest in the {y} opening {n}." for n, (x, y) in enumerate((("Anna", "Data Engineer"), ("Paul Meyer", "Nurse")))]
    left = ["Dear {{first_name}}, thank you for your interest in the Driver opening 9.", "Dear First Name, thank you for your interest in the Clerk opening 8.", "Our First Name policy is kind."]
    assert flagged(spark, filled + left) == {2: "slot", 3: "slot"}
    assert flagged(spark, left[1:]) == {} == flagged(spark, left[:1])


def test_alignment_tells_slots_from_wording(spark):
    """The same mark everywhere is wording; so are boxes, unless records fill them."""
    fixed = [f"Set items in angle mode [department] to taste {i}." for i in range(5)] + [f"Box [ ] is left open {i}." for i in range(3)]
    varied = [f"We meet in [{x}_name] on Mondays." for x in ("room", "city", "team")]
    assert set(flagged(spark, fixed + varied)) == {8, 9, 10}
    assert set(flagged(spark, ["Lot [ ] is open.", "Lot Seven is open.", "Lot [ ] is closed."])) == {0}


@pytest.mark.parametrize("lines", [1, 45, 3000])
def test_pages_of_any_length(spark, lines):
    page = "Exception in thread main\n" + "\n".join(f"at com.x.Y{n}(Y.java:12)" for n in range(lines))
    assert flagged(spark, [page, f"{page}\nCookie settings", "Exception handling is part of the job, and so are long nights with the pager beside the bed.\nWe pay for both of them."]) == {0: "page", 1: "page"}


def test_long_and_empty(spark):
    assert set(flagged(spark, ["word after " * 100_000 + "\nDear {{first_name}},", "plain text " * 100_000, "Dear {{last_name}},"])) == {0, 2}
    assert flagged(spark, []) == {}


def test_patterns_read_alike_in_java(spark):
    texts = [x for pair in VARIABLES for x in pair] + REPEATED + [at(x, 5) for x in REAL if x] + ["_" * 3, "Hi null.", "an XXX a xxx XXXX", "Dear Last Name,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", F.regexp_replace("t", JAVA_SPAN, "*").alias("s")).collect()}
    assert got == {t: SPAN.sub("*", t) for t in texts}
    cuts = {r.t: [x.strip() for x in r.s if x.strip()] for r in df.select("t", F.split("t", CUT).alias("s")).collect()}
    assert all(cuts[t] == segments(t) for t in texts if not t.startswith("- "))
    assert all(any(p in x.lower() for p in ERROR_PIECES) for page in PAGES for x in page.split("\n") if ERROR.fullmatch(x))
