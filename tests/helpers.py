"""Fixture builders and sequential restatements of the ordered rules, for random tests."""

from __future__ import annotations

import datetime as dt

from rosterlens.schemas import MEMBERS

D1, D2, D3 = (dt.datetime(2025, m, 1, 12) for m in (1, 2, 3))


def member(site, date, ord_, name, title=None, emails=(), phones=(), category="Staff", url=None, fingerprint=None, description=None, raw=None):
    return (
        site, date, ord_, fingerprint or f"fp-{name}", name, title, list(emails), list(phones), url, description, category, raw
    )


def members_df(spark, rows):
    return spark.createDataFrame(rows, MEMBERS)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def score(a, b):
    if not a or not b:
        return 0.0
    a, b = a.lower().strip(), b.lower().strip()
    return 1.0 if a == b else 1.0 - edit_distance(a, b) / max(len(a), len(b))


def people_in_order(rows):
    """rows: dicts with ord, name, title, email, url, category; the sequential merge rule."""
    low = lambda t: None if t is None else t.lower().strip()
    people = []
    for m in sorted(rows, key=lambda r: r["ord"]):
        for p in people:
            same = (
                (m["email"] and p["email"] and low(m["email"]) == low(p["email"]))
                or (m["url"] and p["url"] and m["url"].removesuffix("/") == p["url"].removesuffix("/"))
                or (p["name"] and low(p["name"]) == low(m["name"]) and low(p["title"]) == low(m["title"]))
            )
            if same:
                if low(m["category"]) not in [low(c) for c in p["categories"]]:
                    p["categories"].append(m["category"])
                for f in ("title", "name"):
                    if m[f] and len(m[f]) > len(p[f] or ""):
                        p[f] = m[f]
                break
        else:
            people.append({**m, "categories": [m["category"]]})
    return people


def links_in_order(before, after, threshold=0.85):
    """before/after: people in order; returns {(b_ord, a_ord)} by the two sequential phases."""
    links, used_b, used_a = set(), set(), set()
    low = lambda t: t.lower().strip()
    for b in before:
        for a in after:
            if a["ord"] in used_a:
                continue
            if (b["email"] and a["email"] and low(b["email"]) == low(a["email"])) or (
                b["url"] and a["url"] and b["url"].removesuffix("/") == a["url"].removesuffix("/")
            ):
                links.add((b["ord"], a["ord"]))
                used_b.add(b["ord"]), used_a.add(a["ord"])
                break
    for b in before:
        if b["ord"] in used_b:
            continue
        best, best_score = None, 0
        for a in after:
            if a["ord"] in used_a:
                continue
            s = score(b["name"], a["name"])
            if s > threshold and s > best_score:
                best, best_score = a, s
        if best:
            links.add((b["ord"], best["ord"]))
            used_a.add(best["ord"])
    return links
