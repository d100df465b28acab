"""Tables of people whose columns stand in any order.

Every column of a table is scored for every role by its header words and by what its cells hold,
and the roles are given to columns one-to-one so that the sum of scores is highest. Cells, columns
and assignments are DataFrame work on one page's rows; an assignment looks at the four best
columns of each role, which always hold a best one (three can be lost to the other roles).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import contacts, urls
from rosterlens.functions.names import strip_honorific
from rosterlens.functions.text import blank_to_null, collapse, full_trim
from rosterlens.operators.ordered import keep_first

# Header words of each role.
HEADER_WORDS = {"name": ["name"], "title": ["title", "position"], "email": ["email"], "phone": ["phone"]}
ROLES = list(HEADER_WORDS)
BEST_COLUMNS = 4


@dataclass(frozen=True)
class TableRoles:
    """A rule for tables with a name column and at least one of title, email and phone."""

    name: str = "table_roles"
    category: str = "Staff Directory"


def _nearest(tag: str) -> Column:
    """Position of the innermost open element of this tag around an element."""
    return F.try_element_at(F.filter("lineage", lambda a: F.startswith(a["mark"], F.lit(f" {tag} "))), F.lit(-1))["ord"]


def table_cells(elements: DataFrame) -> DataFrame:
    """(page_id, url, table_ord, row_ord, cell_ord, cell, header, text, mail, tel, link) of every table cell."""
    inner = F.greatest(_nearest("td"), _nearest("th"))
    is_cell = F.col("tag").isin("td", "th")
    rows = elements.where(is_cell | ((F.col("tag") == "a") & inner.isNotNull())).select(
        "page_id", "url", F.when(is_cell, F.col("ord")).otherwise(inner).alias("cell_ord"), "cell", "tag",
        _nearest("table").alias("table_ord"), _nearest("tr").alias("row_ord"), "text", F.col("attrs")["href"].alias("href"),
    )
    link = F.when(~F.lower("href").rlike("^(mailto|tel|javascript):"), urls.resolve_link(F.col("href"), F.col("url")))
    own = F.col("tag") != "a"
    return rows.where("table_ord is not null and row_ord is not null").groupBy("page_id", "url", "table_ord", "row_ord", "cell_ord").agg(
        F.max(F.when(own, F.col("cell"))).alias("cell"), F.max(F.col("tag") == "th").alias("header"), F.max(F.when(own, full_trim(F.col("text")))).alias("text"),
        F.max(contacts.mailto_address(F.col("href"))).alias("mail"), F.max(contacts.tel_number(F.col("href"))).alias("tel"), F.max(link).alias("link"),
    )


def _scores() -> dict[str, Column]:
    """What speaks for a role: three points for a header word, up to two for the cells."""
    n = F.greatest(F.count_if(~F.col("header")), F.lit(1))

    def share(test: Column) -> Column:
        return F.count_if(~F.col("header") & F.coalesce(test, F.lit(False))) / n

    mail = F.col("mail").isNotNull() | F.col("text").rlike(contacts.EMAIL_PATTERN)
    phone = F.col("tel").isNotNull() | F.col("text").rlike(contacts.PHONE_PATTERN)
    words = (F.col("text") != "") & ~mail & ~phone
    content = {"name": share(words & F.col("text").rlike(contacts.TWO_WORD_NAME_PATTERN)), "title": share(words) / 2, "email": 2 * share(mail), "phone": 2 * share(phone)}
    header = F.lower(F.coalesce(F.min_by(F.when(F.col("header"), F.col("text")), F.when(F.col("header"), F.col("row_ord"))), F.lit("")))
    named = {role: F.when(F.greatest(*[F.contains(header, F.lit(w)) for w in [*words_, words_[0]]]), 3).otherwise(0) for role, words_ in HEADER_WORDS.items()}
    return {role: named[role] + content[role] for role in ROLES}


def column_roles(cells: DataFrame) -> DataFrame:
    """(page_id, table_ord, name, title, email, phone): the column of each role, -1 for none, of tables of people.

    Of equally good assignments the one with the smaller columns counts, in the order of the roles.
    """
    scored = cells.groupBy("page_id", "table_ord", "cell").agg(*[c.alias(role) for role, c in _scores().items()])
    best = [F.slice(F.array_sort(F.collect_list(F.when(F.col(role) > 0, F.struct((-F.col(role)).alias("cost"), "cell")))), 1, BEST_COLUMNS).alias(role) for role in ROLES]
    tables = scored.groupBy("page_id", "table_ord").agg(*best)
    kind = "array<struct<cost:double,picks:array<int>>>"
    plans = F.from_json(F.lit('[{"cost": 0, "picks": []}]'), kind)
    none = F.from_json(F.lit('[{"cost": 0, "cell": -1}]'), "array<struct<cost:double,cell:int>>")
    for role in ROLES:
        options = F.concat(F.col(role), none)
        plans = F.flatten(F.transform(plans, _extended(options)))
    chosen = F.array_min(plans)
    found = tables.select("page_id", "table_ord", chosen.alias("plan"))
    picks = {role: F.get("plan.picks", F.lit(i)) for i, role in enumerate(ROLES)}
    return found.select("page_id", "table_ord", *[c.alias(role) for role, c in picks.items()]).where("name >= 0 and greatest(title, email, phone) >= 0")


def _extended(options: Column):
    def of(plan: Column) -> Column:
        free = F.filter(options, lambda o: (o["cell"] < 0) | ~F.array_contains(plan["picks"], o["cell"]))
        return F.transform(free, lambda o: F.struct((plan["cost"] + o["cost"]).alias("cost"), F.array_append(plan["picks"], o["cell"]).alias("picks")))

    return of


def people_in_tables(elements: DataFrame, rule: TableRoles) -> DataFrame:
    """Person rows (page_id, url, rule, ord, name, title, email, phone, category, profile_url, extras), first of each name, email and phone.

    Header rows and rows without a name are no people. A contact is the link's address, else the
    pattern in the cell's text.
    """
    cells = table_cells(elements)
    rows = cells.groupBy("page_id", "url", "table_ord", "row_ord").agg(
        F.max("header").alias("header"), F.map_from_entries(F.collect_list(F.struct("cell", F.struct("text", "mail", "tel", "link")))).alias("by_cell")
    ).where("not header")
    found = rows.join(column_roles(cells), ["page_id", "table_ord"])
    at = {role: F.try_element_at("by_cell", F.col(role)) for role in ROLES}
    person = {
        "name": strip_honorific(collapse(at["name"]["text"])), "title": collapse(at["title"]["text"]),
        "email": F.coalesce(at["email"]["mail"], contacts.find_email(at["email"]["text"])),
        "phone": blank_to_null(full_trim(contacts.dashed_phone(F.coalesce(at["phone"]["tel"], contacts.find_phone(at["phone"]["text"]))))),
    }
    texts = [contacts.drop_placeholder(c).alias(field) for field, c in person.items()]
    people = found.select(
        "page_id", "url", F.lit(rule.name).alias("rule"), F.col("row_ord").alias("ord"), *texts, F.lit(rule.category).alias("category"),
        at["name"]["link"].alias("profile_url"), F.create_map().cast("map<string,string>").alias("extras"),
    ).where("name <> ''")
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in ("name", "email", "phone")])
    return keep_first(people, ["page_id", key], "ord")
