import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from rosterlens.llm import chat, fingerprints, reputation


def test_rules_and_urls(spark):
    urls = [
        "http://a.org/x", "https://EXAMPLE.org/es/1?q", "http://example.org/en/12", "http://example.org", "http://m.com/de/", "http://com/fr/1", "http://xorg/a",
        "ftp://a.net?x/fr/", "no scheme", None, "http://", "x://h.net#/a", "HTTP://A.Com/fr/?q#f", "http://a.org/x://b.com/de/", "http://notexample.org/es/", "line\n://b.org/y\nz",
    ]
    pages = spark.createDataFrame([(k, u, "<p>", "h") for k, u in enumerate(urls)] + [(0, urls[0], "", "")], "page_id long, url string, html string, host string")
    got = reputation.judged(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = {r.page_id: r for r in got.collect()}

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        return "".join(c.lower() if c.isascii() else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]

    for k, url in enumerate(urls):
        host, path = parts(url)
        fitting = [(len(d + p), d + p, v) for d, p, v in reputation.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        rule, verdict = max(fitting)[1:] if fitting else (None, "allow")
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == (host, path, rule, verdict), url
    assert got.count() == len(urls) + 1
    assert reputation.judged(pages.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for k in range(1200):
        host, rate = [("good.fine.net", 0.95), ("bad.fine.net", 0.2), ("one.poor.net", 0.1), ("two.poor.net", 0.15)][k % 4]
        pages.append((k, f"http://{host}/{k}"))
        labels.append((k, int(rng.random() < rate), rng.choice([0, None])))
    pages += [(5000, "http://new.fine.net/"), (5001, "http://new.poor.net/"), (5002, "http://other.io/")]
    got = reputation.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*labels, (None, 0, 1)], "doc_id long, quality int, toxic int"))
    verdicts = {r.host: r.verdict for r in got.collect()}
    assert verdicts["good.fine.net"] == "allow" and verdicts["bad.fine.net"] == "block"
    assert verdicts["one.poor.net"] == verdicts["new.poor.net"] == "block"


def test_domains_and_suffixes(spark):
    hosts = ["", "a", "a.b", "x.a.b", "a.co.uk", "x.y.a.co.uk", "co.uk"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = rows.select(reputation.domain_of(F.col("host")).alias("d"), reputation.suffix_of(F.col("host")).alias("s")).collect()
    assert [(r.d, r.s) for r in got] == [("", ""), ("a", "a"), ("a.b", "b"), ("a.b", "b"), ("a.co.uk", "co.uk"), ("a.co.uk", "co.uk"), ("co.uk", "co.uk")]


def test_maximal_conversations_equal_brute_force(spark):
    rng = random.Random(7)
    logs = {}
    for base in range(12):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "what is it", "é\n"])) for _ in range(rng.randint(1, 9))]
        for k in range(rng.randint(1, 5)):
            logs[base * 10 + k] = turns[: rng.randint(1, len(turns))]
    logs[900] = logs[0]
    rows = [(c, n, role, text, "x") for c, turns in logs.items() for n, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "x"), (901, None, "user", "late", "y"), (901, 0, "user", "a", "y"), (901, 0, "user", "a", "y")]
    logs[901] = [("user", "a"), ("user", "a"), ("user", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    kept, same = {}, Counter(map(tuple, logs.values()))
    for c in sorted(logs):
        prefix = any(len(o) > len(logs[c]) and o[: len(logs[c])] == logs[c] for o in logs.values())
        if not prefix and logs[c] not in [logs[k] for k in kept]:
            kept[c] = "".join(f"<|{r or 'unknown'}|>\n{t or ''}\n" for r, t in logs[c])
    got = {r.conv_id: (r.n_turns, r.snapshots, r.chat) for r in chat.format_chats(turns).collect()}
    assert got == {c: (len(logs[c]), same[tuple(logs[c])], text) for c, text in kept.items()}
    assert chat.format_chats(turns.limit(0)).count() == 0


def weighted(one, two):
    a, b = Counter((one or "").split()), Counter((two or "").split())
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_edited_texts_and_likeness(spark, words):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words(30), k=rng.choice([1, 8, 90])))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "é" * 10), (73, "a b " * 5_000), (74, rows[3][1]), (None, "last of all")]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows] + [(74, rows[3][1], "x", 0)], "doc_id long, text string, content string, n_chars int")
    got = fingerprints.edited_copies(docs, samples=64)
    shown = got.select("doc_id", "n_chars", "edited_sha256", "codes", fingerprints.likeness(F.col("codes"), F.col("edited_codes"), 64).alias("edited"), fingerprints.likeness(F.col("codes"), F.col("next_codes"), 64).alias("next")).collect()
    assert len(shown) == len(rows) + 1
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    at = {r.doc_id: r for r in shown}
    errors = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = at[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.edited - weighted(text, edited), r.next - weighted(text, after)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    assert at[3].codes == at[74].codes and at[70].codes == at[71].codes and at[71].next == 1.0
    assert fingerprints.edited_copies(docs.limit(0)).count() == 0
    alone = fingerprints.edited_copies(docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].codes == alone[0].next_codes
