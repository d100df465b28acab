"""The model's tables, derived from the given analytic tables, so that every job can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.schemas import MEMBERS

NOW = "2024-01-31 03:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _when_texts(cond: Column, *values: Column) -> Column:
    return F.when(cond, _texts(*values)).otherwise(F.array().cast("array<string>"))


def _as_members(df: DataFrame) -> DataFrame:
    missing = {f.name: F.lit(None).cast(f.dataType) for f in MEMBERS if f.name not in df.columns}
    return df.withColumns(missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMBERS])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of ten sites: users seen that day, one row per event."""
    user, level = F.col("user_id"), F.floor("value")
    return _as_members(
        table(spark, sf_dir, "events").select(
            (user % 10).cast("string").alias("site_id"),
            F.date_trunc("day", F.col("ts")).cast("timestamp").alias("snapshot_date"),
            F.col("event_id").alias("ord"),
            F.md5(user.cast("string")).alias("fingerprint"),
            F.concat(F.lit("User "), user).alias("name"),
            F.concat(F.lit("Grade "), level % 3).alias("title"),
            _when_texts(user % 3 != 0, F.concat(F.lit("user"), user, F.lit("@site.test"))).alias("emails"),
            _when_texts(level % 4 != 0, F.concat(F.lit("(555) 010-"), F.lpad(user.cast("string"), 6, "0"))).alias("phones"),
            F.col("event_type").alias("category"),
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("https://www."), F.lower("n_name"), F.lit(".edu"))
    return (
        table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").cast("string").alias("site_id"), base.alias("base_url"),
            F.concat(base, F.lit("/staff")).alias("staff_directory"),
            F.lit(None).cast("timestamp").alias("last_scraped_at"), F.lit(None).cast("string").alias("latest_snapshot_id"),
            F.lit(None).cast("timestamp").alias("created_at"),
        )
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("site_id").cast("int")
    return sites(spark, sf_dir).select(
        "base_url", "staff_directory",
        F.when(key % 2 == 0, F.concat(F.lit("ip"), key)).otherwise("").alias("ipeds"),
        F.when(key % 3 == 0, F.concat(F.lit("School "), key)).otherwise("").alias("school_name"),
        F.when(key % 4 != 0, F.concat(F.lit("rule"), key % 4)).alias("successful_rule"),
        (key % 5 == 0).alias("rule_failed_last_time"), F.lit(None).cast("timestamp").alias("last_processed_at"),
        F.lit(1).cast("bigint").alias("process_count"), key.cast("bigint").alias("last_staff_count"),
        (key % 7 != 6).alias("is_active"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.regexp_replace("c_name", "#", " ")
    day = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 60 as int))")
    raw_title = F.when(key % 5 == 0, F.concat("c_mktsegment", F.lit(" Coach"))).when(key % 5 == 1, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("site_id"), F.md5(key.cast("string")).alias("fingerprint"),
        F.lit(None).cast("string").alias("profile_url"), name.alias("canonical_name"),
        F.when(key % 2 == 0, "Sport Manager").alias("title"),
        _when_texts(F.col("c_acctbal") >= 0, F.concat(F.lit("c"), key, F.lit("@site.test"))).alias("emails"),
        _when_texts(key % 4 != 0, F.concat(F.lit("555-010-"), key)).alias("phones"),
        day.alias("first_seen_at"), day.alias("last_seen_at"), _texts(F.col("c_mktsegment")).alias("categories"),
        F.when(raw_title.isNotNull(), F.create_map(F.lit("title"), raw_title)).alias("raw"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change entries, one per order line."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "N", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("updated")
    name = F.when(part % 7 == 0, "").otherwise(F.concat(F.lit("Person "), part))
    title = F.when(line % 4 == 0, "coach").when(line % 4 == 1, name).when(line % 4 == 2, F.concat(F.lit("Grade "), F.col("l_suppkey") % 5))

    def diff(field: str, on: Column, before: Column, after: Column) -> Column:
        return F.when(on, F.struct(F.lit(field).alias("field"), before.alias("before"), after.alias("after")))

    diffs = F.array_compact(
        F.array(
            diff("title", line % 2 == 0, F.when(line % 4 == 0, _texts(F.lit("Assistant"))), _texts(F.concat(F.lit("Grade "), line))),
            diff("emails", line % 5 == 0, _texts(), _texts(F.concat(F.lit("p"), part, F.lit("@site.test")))),
            diff("categories", line % 3 == 0, _texts(F.lit("A"), F.lit("B")), _texts(F.col("l_linestatus"))),
        )
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("change_id"), kind.alias("kind"), line.cast("bigint").alias("ord"),
        F.md5(part.cast("string")).alias("fingerprint"), name.alias("name"), title.alias("title"),
        _when_texts(F.col("l_quantity") >= 10, F.col("l_linestatus"), F.col("l_returnflag")).alias("categories"),
        _when_texts(F.col("l_tax") > 0.04, F.concat(F.lit("p"), part, F.lit("@site.test"))).alias("emails"),
        _when_texts(F.col("l_discount") > 0.05, F.concat(F.lit("555-"), part)).alias("phones"),
        F.lit(None).cast("string").alias("profile_url"), F.when(kind == "updated", diffs).alias("diffs"),
        # what only the open object knows: a single value, a list, or neither
        F.parse_json(
            F.when(part % 3 == 0, F.format_string('{"email": "raw%d@site.test", "phones": ["556-%d", "x"]}', part, part))
            .when(part % 3 == 1, F.format_string('{"email": "", "emails": ["list%d@site.test"], "phone": "557-%d"}', part, part)).otherwise("{}")
        ).alias("raw"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change logs, one per order: site of the customer, dates around the order date."""
    day = F.col("o_orderdate").cast("timestamp")
    owner = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("site_id"))
    return (
        table(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("change_id"), "site_id",
            F.when(F.col("o_orderkey") % 10 != 0, day - F.expr("INTERVAL 30 DAYS")).alias("from_date"), day.alias("to_date"),
            day.alias("created_at"),
        )
    )


def counted_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change logs with their entry counts; the counts are taken before the join."""
    counts = entries(spark, sf_dir).groupBy("change_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("added", "removed", "updated")]
    )
    joined = change_log(spark, sf_dir).join(counts, "change_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("added_count", "removed_count", "updated_count")})


def customer_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots per site: even customers, then odd ones, with similar names."""
    key = F.col("c_custkey")
    return _as_members(
        table(spark, sf_dir, "customer").select(
            F.col("c_nationkey").cast("string").alias("site_id"),
            F.when(key % 2 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp").alias("snapshot_date"),
            key.alias("ord"), F.md5(key.cast("string")).alias("fingerprint"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("title"),
            _when_texts(F.col("c_acctbal") >= 5000, F.concat(F.lit("c"), F.floor(key / 2), F.lit("@site.test"))).alias("emails"),
            F.array().alias("phones"), F.col("c_mktsegment").alias("category"),
        )
    )


def part_people(spark: SparkSession, sf_dir: str, with_email: bool) -> DataFrame:
    """One snapshot per part size: names and titles repeat inside it, emails tie some of them together."""
    key = F.col("p_partkey")
    email = _when_texts((key % 3 == 0) & F.lit(with_email), F.concat(F.lower(F.regexp_replace("p_name", " ", ".")), F.lit("@site.test")))
    return _as_members(
        table(spark, sf_dir, "part").select(
            F.col("p_size").cast("string").alias("site_id"), F.lit("2024-01-01").cast("timestamp").alias("snapshot_date"),
            key.alias("ord"), F.md5(key.cast("string")).alias("fingerprint"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("title"), email.alias("emails"), F.array().alias("phones"), F.col("p_type").alias("category"),
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing runs of directories, one per event."""
    ok = F.col("event_type") != "error"
    page = F.concat(F.lit("https://dir"), F.col("user_id"), F.lit(".test/staff"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id"), page.alias("staff_directory"), F.concat(F.lit("https://dir"), F.col("user_id"), F.lit(".test")).alias("base_url"),
        F.col("ts").cast("timestamp").alias("processed_at"), ok.alias("success"),
        F.when(ok, F.col("event_type")).alias("used_rule"),
        F.when(ok, F.floor("value")).otherwise(0).cast("bigint").alias("staff_count"),
        F.when(F.floor("value") % 2 == 0, F.lit("view")).alias("known_rule"),
        F.when(F.floor("value") % 3 == 0, "fetch_failed").otherwise("no_data").alias("failure_type"),
    )


def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered directory per user; the last processing lies up to forty days before the last event."""
    shifted = F.expr("max(cast(ts as timestamp)) - make_interval(0, 0, 0, cast(user_id % 40 as int))")
    user = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(shifted.alias("_at")).select(
        "user_id", F.concat(F.lit("https://dir"), user, F.lit(".test")).alias("base_url"),
        F.concat(F.lit("https://dir"), user, F.lit(".test/staff")).alias("staff_directory"), F.lit("").alias("ipeds"),
        F.lit("").alias("school_name"), F.lit("old").alias("successful_rule"), (user % 5 == 0).alias("rule_failed_last_time"),
        F.when(user % 11 != 0, F.col("_at")).alias("last_processed_at"), F.lit(0).cast("bigint").alias("process_count"),
        F.lit(0).cast("bigint").alias("last_staff_count"), (user % 7 != 6).alias("is_active"),
    )


def page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows read off page URLs: many pages of one host share a staff page."""
    key = F.col("page_id")
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(
        key.alias("ord"), base.alias("base_url"), F.concat(F.lit("https://"), host, F.lit("/staff")).alias("staff_directory"),
        F.when(key % 3 == 0, F.concat(F.lit("ip"), key % 9)).otherwise("").alias("ipeds"),
        F.when(key % 4 == 0, F.concat(F.lit("School "), key % 8)).otherwise("").alias("school_name"), "url",
        (key % 6 != 5).alias("is_active"),
    )


PAGE_KINDS = ["headed", "shuffled", "headless", "microdata", "data_rows", "running", "grouped", "rendered"]


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff pages of eight layouts, twenty customers a page; every seventh place is vacant."""
    key = F.col("c_custkey")
    word = F.initcap(F.translate(F.lpad(key.cast("string"), 7, "0"), "0123456789", "abcdefghij"))
    people = table(spark, sf_dir, "customer").select(
        F.floor(key / 20).alias("page_id"), key.alias("k"), F.when(key % 7 == 0, "- Vacant -").otherwise(F.concat(F.lit("Ann "), word)).alias("name"),
        F.initcap("c_mktsegment").alias("title"), F.concat(F.lit("c"), key, F.lit("@site.test")).alias("email"),
        F.concat(F.lit("555-010-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("phone"),
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in PAGE_KINDS]), (F.col("page_id") % len(PAGE_KINDS) + 1).cast("int"))

    def tag(name: str, *inner: Column | str, **attrs: Column | str) -> Column:
        given = [x for a, v in attrs.items() for x in (F.lit(f' {a.replace("_", "-")}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"'))]
        return F.concat(F.lit(f"<{name}"), *given, F.lit(">"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{name}>"))

    name, title, email, phone = (F.col(c) for c in ("name", "title", "email", "phone"))
    mail, call = tag("a", "write", href=F.concat(F.lit("mailto:"), email, F.lit("?subject=hi"))), tag("a", "call", href=F.concat(F.lit("tel:"), phone))
    plain = tag("tr", tag("td", name), tag("td", title), tag("td", mail), tag("td", call))
    turned = F.array(tag("td", phone), tag("td", tag("a", name, href=F.concat(F.lit("/p/"), F.col("k")))), tag("td", email), tag("td", title))
    turn = (F.col("page_id") % 4).cast("int")
    permuted = tag("tr", F.array_join(F.concat(F.slice(turned, turn + 1, 4 - turn), F.slice(turned, F.lit(1), turn)), ""))
    lines = {
        "headed": plain, "shuffled": permuted, "headless": permuted, "rendered": plain,
        "microdata": tag("div", tag("b", name, itemprop="name"), tag("i", title, itemprop="jobTitle"), tag("a", "write", itemprop="email", href=F.concat(F.lit("mailto:"), email)), itemtype="https://schema.org/Person"),
        "data_rows": tag("tr", tag("td", name), tag("td", phone), data_name=name, data_position=title, data_dept=F.concat(F.lit("Dept "), F.col("k") % 3), data_email=email),
        "running": tag("p", F.concat_ws(", ", name, F.lower(title), phone, email)),
        "grouped": F.concat(F.when(F.col("k") % 5 == 0, tag("tr", tag("td", F.lit("Group "), (F.col("k") % 4).cast("string"), colspan="4"), **{"class": "head"})).otherwise(""), tag("tr", tag("td", name), tag("td", title), tag("td", email))),
    }
    line = F.lit(None).cast("string")
    for which, html in lines.items():
        line = F.when(F.col("kind") == which, html).otherwise(line)
    rows = people.withColumn("kind", kind).withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    pages = rows.groupBy("page_id", "kind").agg(body.alias("body"))
    head_cells = F.array(*[F.lit(f"<th>{x}</th>") for x in ("Phone", "Full Name", "Email", "Position")])
    head = F.concat(F.lit("<tr>"), F.array_join(F.concat(F.slice(head_cells, turn + 1, 4 - turn), F.slice(head_cells, F.lit(1), turn)), ""), F.lit("</tr>"))
    whole = (
        F.when(F.col("kind") == "headed", F.concat(F.lit("<h2>Office "), F.col("page_id") % 3, F.lit("</h2><table>"), "body", F.lit("</table>")))
        .when(F.col("kind") == "shuffled", F.concat(F.lit('<table class="table">'), head, "body", F.lit("</table>")))
        .when(F.col("kind").isin("headless", "data_rows"), F.concat(F.lit("<table>"), "body", F.lit("</table>")))
        .when(F.col("kind") == "grouped", F.concat(F.lit('<table class="staff">'), "body", F.lit("</table>")))
        .when(F.col("kind") == "rendered", F.concat(F.lit('<h1 class="unit">Unit '), F.col("page_id") % 5, F.lit('</h1><table class="late">'), "body", F.lit("</table>")))
        .otherwise(F.col("body"))
    )
    late = F.col("kind") == "rendered"
    return pages.select(
        "page_id", F.concat(F.lit("https://site.test/"), "page_id", F.lit("/staff")).alias("url"), F.when(late, "<p>Loading</p>").otherwise(whole).alias("html"),
        F.when(late, whole).alias("rendered_html"),
    )
