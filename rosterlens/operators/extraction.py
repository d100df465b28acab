"""People from pages, by rules that are data.

A rule names a container (one per person), how to find each field inside it, and where the
category stands. All rules are matched in one pass over the element rows; what matched is kept,
joined by container, carried down from headings, and cleaned with Column functions. The first
rule in priority order that yields a row wins its page; a remembered rule goes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import contacts, urls
from rosterlens.functions.names import strip_honorific
from rosterlens.functions.text import blank_to_null, collapse, full_trim
from rosterlens.operators.ordered import keep_first
from rosterlens.operators.table_roles import TableRoles, people_in_tables
from rosterlens.session import stage
from rosterlens.sources.elements import page_elements

FIELDS = ["name", "title", "email", "phone", "category", "profile_url"]
PERSON_SCHEMA = "page_id bigint, url string, rule string, ord int, " + ", ".join(f"{f} string" for f in FIELDS) + ", extras map<string,string>"
DEFAULT_CATEGORY = "Staff Directory"
MIN_FREE_TEXT = 20


@dataclass(frozen=True)
class Find:
    """Which elements, and what to take from them.

    ``take``: text, attr:<name>, mailto, tel, link (resolved href), script_email, or one of
    lead_name, free_title, free_email, free_phone, labelled_phone for running text.
    """

    tag: str | None = None
    cls: str | None = None
    attr: str | None = None
    value: str | None = None
    prefix: str | None = None
    cell: int | None = None
    inside: str | None = None
    take: str = "text"

    def matches(self) -> Column:
        tests = []
        if self.tag:
            tests.append(F.col("tag").isin(self.tag.split("|")))
        if self.cls:
            tests.append(F.array_contains("classes", self.cls))
        if self.attr:
            got = F.col("attrs")[self.attr]
            tests.append(got.isNotNull())
            if self.value is not None:
                tests.append(got == self.value)
            if self.prefix is not None:
                tests.append(F.startswith(F.lower(got), F.lit(self.prefix)))
        if self.cell is not None:
            tests.append(F.col("cell") == self.cell)
        if self.inside:
            wanted = F.lit(f" {self.inside} ")
            tests.append(F.exists("lineage", lambda a: F.contains(a["mark"], wanted)))
        if self.take.startswith("free_") or self.take == "lead_name":
            tests.append(holds_contact(F.col("text")))
        whole = F.lit(True)
        for t in tests:
            whole = whole & t
        return F.coalesce(whole, F.lit(False))

    def taken(self) -> Column:
        text, href = F.col("text"), F.col("attrs")["href"]
        if self.take.startswith("attr:"):
            return F.col("attrs")[self.take[5:]]
        return {
            "text": text,
            "mailto": contacts.mailto_address(href),
            "tel": contacts.tel_number(href),
            "link": F.when(~F.lower(href).rlike("^(mailto|tel|javascript):"), urls.resolve_link(href, F.col("url"))),
            "script_email": contacts.script_email(text),
            "lead_name": contacts.leading_name(text),
            "free_title": contacts.title_between(text, contacts.leading_name(text)),
            "free_email": contacts.find_email(text),
            "free_phone": contacts.find_phone(text),
            "labelled_phone": contacts.find_labelled_phone(text),
        }[self.take]


def holds_contact(text: Column) -> Column:
    """Running text long enough to be a person line, with a name and an email or a phone."""
    contact = text.rlike(contacts.EMAIL_PATTERN) | text.rlike(contacts.PHONE_PATTERN)
    return (F.length(text) >= MIN_FREE_TEXT) & text.rlike(contacts.TWO_WORD_NAME_PATTERN) & contact


@dataclass(frozen=True)
class Rule:
    """One layout. ``fields`` maps a field (or an extra) to its finders, best first."""

    name: str
    container: Find
    fields: dict[str, list[Find]]
    heading: Find | None = None
    page_heading: Find | None = None
    category: str | None = None
    key: tuple[str, ...] = ("name", "email", "phone")
    phone_format: Callable[[Column], Column] = field(default=contacts.dashed_phone)
    need_contact: bool = False


@dataclass(frozen=True)
class PythonRule:
    """A user's function (html, url) -> list of person dicts, or None. It runs inside the tasks."""

    name: str
    fn: Callable[[str, str], list[dict] | None]


AnyRule = Rule | PythonRule | TableRoles
RULES: dict[str, AnyRule] = {}


def register_rule(rule: AnyRule) -> None:
    RULES[rule.name] = rule


def _mail(**where) -> Find:
    return Find(tag="a", attr="href", prefix="mailto:", take="mailto", **where)


def _tel(**where) -> Find:
    return Find(tag="a", attr="href", prefix="tel:", take="tel", **where)


MICRODATA = Rule(
    "microdata", Find(attr="itemtype", value="https://schema.org/Person"),
    {
        "name": [Find(attr="itemprop", value="name")], "title": [Find(attr="itemprop", value="jobTitle")],
        "email": [Find(attr="itemprop", value="email", take="mailto"), _mail()],
        "phone": [Find(attr="itemprop", value="telephone", take="tel"), _tel()],
    },
    category=DEFAULT_CATEGORY,
)
DATA_ROWS = Rule(
    "data_rows", Find(tag="tr", attr="data-name"),
    {
        "name": [Find(tag="tr", attr="data-name", take="attr:data-name"), Find(cell=0)],
        "title": [Find(tag="tr", attr="data-position", take="attr:data-position")],
        "category": [Find(tag="tr", attr="data-dept", take="attr:data-dept")],
        "email": [Find(tag="tr", attr="data-email", take="attr:data-email"), _mail()], "phone": [Find(cell=1)],
    },
    heading=Find(tag="h2|h3|caption"), phone_format=full_trim,
)
SECTION_TABLES = Rule(
    "section_tables", Find(tag="tr", inside="table"),
    {"name": [Find(tag="td", cell=0)], "title": [Find(tag="td", cell=1)], "email": [_mail()], "phone": [_tel(), Find(tag="td", cell=2)]},
    heading=Find(tag="h2|h3|caption"), key=("name", "title", "email", "category"), need_contact=True,
)
GENERIC_TABLE = Rule(
    "generic_table", Find(tag="tr", inside="table"),
    {"name": [Find(tag="td", cell=0)], "title": [Find(tag="td", cell=1)], "email": [_mail()], "phone": [_tel()]},
)
FREE_TEXT = Rule(
    "free_text", Find(tag="div|p|li", take="lead_name"),
    {f: [Find(tag="div|p|li", take=t)] for f, t in {"name": "lead_name", "title": "free_title", "email": "free_email", "phone": "free_phone"}.items()},
    category=DEFAULT_CATEGORY,
)
BASE_RULES = [MICRODATA, DATA_ROWS, SECTION_TABLES, GENERIC_TABLE, FREE_TEXT]


def card_rule(name: str, card: str, name_cls: str, title_cls: str, heading_cls: str | None = None, **options) -> Rule:
    """A rule for repeated cards: classes of the card, its name and title, and of the headings between cards."""
    fields = {
        "name": [Find(cls=name_cls)], "title": [Find(cls=title_cls)], "email": [_mail()], "phone": [_tel()],
        "profile_url": [Find(tag="a", cls=name_cls, attr="href", take="link"), Find(tag="a", attr="href", prefix="/", take="link")],
    }
    return Rule(name, Find(cls=card), fields, heading=Find(cls=heading_cls) if heading_cls else None, **options)


def grouped_table_rule(name: str, table_cls: str, heading: Find, columns: list[str], **options) -> Rule:
    """A rule for one table whose heading rows give the category of the rows below them."""
    fields: dict[str, list[Find]] = {c: [Find(tag="td", cell=i, inside=f".{table_cls}")] for i, c in enumerate(columns)}
    fields["email"] = [_mail(), *fields.get("email", [])]
    fields["phone"] = [_tel(), *fields.get("phone", [])]
    return Rule(name, Find(tag="tr", inside=f".{table_cls}"), fields, heading=heading, **options)


def _marks(rules: list[Rule]) -> Column:
    """Everything the rules want from one element row."""

    def mark(rule: Rule, kind: str, what: str, choice: int, find: Find) -> Column:
        value = find.taken() if kind != "container" else F.lit(None).cast("string")
        return F.when(
            find.matches(),
            F.struct(
                F.lit(rule.name).alias("rule"), F.lit(kind).alias("kind"), F.lit(what).alias("what"),
                F.lit(choice).alias("choice"), full_trim(value).alias("value"),
            ),
        )

    wanted = []
    for rule in rules:
        wanted.append(mark(rule, "container", "", 0, rule.container))
        for name, finds in rule.fields.items():
            wanted += [mark(rule, "field", name, i, f) for i, f in enumerate(finds)]
        for kind, find in (("heading", rule.heading), ("page_heading", rule.page_heading)):
            if find:
                wanted.append(mark(rule, kind, "", 0, find))
    return F.array_compact(F.array(*wanted))


def match_rules(elements: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, ord, lineage, rule, kind, what, choice, value) for elements that some rule wants."""
    hits = elements.select("page_id", "url", "ord", F.col("lineage.ord").alias("above"), F.explode(_marks(rules)).alias("m"))
    return hits.select("page_id", "url", "ord", "above", "m.*").where("kind = 'container' or value <> ''")


def _with_category(people: DataFrame, marked: DataFrame) -> DataFrame:
    """Heading above each container. Groups are single pages, so their rows fit a task."""
    place = ["page_id", "rule"]
    heads = marked.where("kind = 'heading'").select(*place, F.col("ord").alias("c_ord"), F.col("value").alias("_heading"))
    line = Window.partitionBy(*place).orderBy("c_ord", F.desc("_is_head")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = people.withColumn("_is_head", F.lit(0)).unionByName(heads.withColumn("_is_head", F.lit(1)), allowMissingColumns=True)
    carried = both.withColumn("_above", F.last("_heading", ignorenulls=True).over(line)).where("_is_head = 0")
    tops = marked.where("kind = 'page_heading'").groupBy(*place).agg(F.min_by("value", "ord").alias("_top"))
    return carried.join(tops, place, "left").withColumn(
        "category", F.coalesce(blank_to_null(F.col("category")), "_above", "_top")
    ).drop("_is_head", "_heading", "_above", "_top")


def assemble(marked: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matched elements to cleaned person rows of every rule."""
    boxes = marked.where("kind = 'container'").select("page_id", "rule", F.col("ord").alias("c_ord"), "url").distinct()
    # A container that is or holds a heading is a heading row, not a person.
    heads = marked.where("kind = 'heading'").select("page_id", "rule", F.explode(F.array_append("above", F.col("ord"))).alias("c_ord"))
    boxes = boxes.join(heads, ["page_id", "rule", "c_ord"], "left_anti")
    wanted = marked.where("kind = 'field'").withColumn("c_ord", F.explode(F.array_append("above", F.col("ord"))))
    owned = wanted.drop("url").hint("merge").join(boxes, ["page_id", "rule", "c_ord"])
    # The nearest container owns the element; of several elements the best finder, then the first, counts.
    nearest = owned.groupBy("page_id", "url", "rule", "ord", "what", "choice", "value").agg(F.max("c_ord").alias("c_ord"))
    best = nearest.groupBy("page_id", "url", "rule", "c_ord", "what").agg(F.min_by("value", F.struct("choice", "ord")).alias("value"))
    extras = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(~F.col("what").isin(FIELDS), F.struct("what", "value"))))
    )
    people = best.groupBy("page_id", "url", "rule", "c_ord").agg(
        *[F.max(F.when(F.col("what") == f, F.col("value"))).alias(f) for f in FIELDS], extras.alias("extras")
    )
    people = _with_category(people, marked)

    def per_rule(of: Callable[[Rule], Column], other: Column) -> Column:
        value = other
        for rule in rules:
            value = F.when(F.col("rule") == rule.name, of(rule)).otherwise(value)
        return value

    none = F.lit(None).cast("string")
    cleaned = people.withColumns(
        {
            "name": contacts.drop_placeholder(strip_honorific(collapse(F.col("name")))),
            "title": contacts.drop_placeholder(collapse(F.col("title"))),
            "email": contacts.drop_placeholder(F.col("email")),
            "phone": blank_to_null(full_trim(contacts.drop_placeholder(per_rule(lambda r: r.phone_format(F.col("phone")), none)))),
            "category": F.coalesce("category", per_rule(lambda r: F.lit(r.category).cast("string"), none)),
        }
    ).where(F.col("name") != "")
    needs = per_rule(lambda r: F.lit(r.need_contact), F.lit(False))
    cleaned = cleaned.where(~needs | F.col("email").isNotNull() | F.col("phone").isNotNull())
    key = per_rule(lambda r: F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in r.key]), none)
    rows = cleaned.select("page_id", "url", "rule", F.col("c_ord").alias("ord"), *FIELDS, "extras")
    return keep_first(rows, ["page_id", "rule", key.alias("k")], "ord")


def _run_python_rule(rule: PythonRule) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [c.split()[0] for c in PERSON_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, html in batch[["page_id", "url", "html"]].itertuples(index=False):
                people = rule.fn(html, url) or []
                rows += [
                    {"page_id": page_id, "url": url, "rule": rule.name, "ord": i, **{f: p.get(f) for f in FIELDS}, "extras": {}}
                    for i, p in enumerate(people) if p.get("name")
                ]
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "int64", "ord": "int32"})

    return run


def run_rules(pages: DataFrame, rules: list[AnyRule]) -> DataFrame:
    """Person rows of all rules for pages (page_id, url, html)."""
    layouts = [r for r in rules if isinstance(r, Rule)]
    parts = []
    if layouts:
        marked = stage(match_rules(page_elements(pages), layouts), "matched-elements")
        parts.append(assemble(marked, layouts))
    for rule in rules:
        if isinstance(rule, TableRoles):
            parts.append(people_in_tables(page_elements(pages), rule))
        if isinstance(rule, PythonRule):
            slim = pages.where("html is not null").select("page_id", "url", "html")
            parts.append(slim.mapInPandas(_run_python_rule(rule), PERSON_SCHEMA))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def pick_rule(people: DataFrame, rules: list[AnyRule], known: DataFrame | None = None) -> DataFrame:
    """Rows of the winning rule of each page; ``known`` (page_id, known_rule) puts a remembered rule first."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    ranked = people.withColumn("_priority", F.try_element_at(order, F.col("rule")))
    if known is not None:
        ranked = ranked.join(known.select("page_id", "known_rule"), "page_id", "left")
        ranked = ranked.withColumn(
            "_priority", F.when(F.col("rule") == F.col("known_rule"), -1).otherwise(F.col("_priority"))
        ).drop("known_rule")
    best = ranked.groupBy("page_id").agg(F.min("_priority").alias("_priority"))
    return ranked.join(best, ["page_id", "_priority"], "left_semi").drop("_priority")


def extract_people(
    pages: DataFrame, rules: list[AnyRule] | None = None, known: DataFrame | None = None
) -> DataFrame:
    """People of every page; pages where nothing is found are tried again on their rendered form."""
    rules = rules or [*RULES.values(), *BASE_RULES]
    found = pick_rule(run_rules(pages, rules), rules, known)
    if "rendered_html" not in pages.columns:
        return found
    found = stage(found, "people")
    second = pages.where("rendered_html is not null").join(found.select("page_id").distinct(), "page_id", "left_anti")
    second = second.select("page_id", "url", F.col("rendered_html").alias("html"))
    return found.unionByName(pick_rule(run_rules(second, rules), rules, known))


def page_outcomes(pages: DataFrame, people: DataFrame) -> DataFrame:
    """What became of each page: people found, no data, or never fetched."""
    counts = people.groupBy("page_id").agg(F.count("*").alias("staff_count"), F.first("rule").alias("used_rule"))
    joined = pages.join(counts, "page_id", "left")
    fetched = F.col("html").isNotNull()
    if "rendered_html" in pages.columns:
        fetched = fetched | F.col("rendered_html").isNotNull()
    outcome = F.when(F.col("staff_count") > 0, "success").when(fetched, "no_data").otherwise("fetch_failed")
    return joined.select(
        "page_id", "url", F.coalesce("staff_count", F.lit(0)).alias("staff_count"), "used_rule", outcome.alias("outcome")
    )
