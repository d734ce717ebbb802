"""Orphan references against a plain loop."""

import datetime as dt
import random

from conftest import rows

from quillmill.operators import orphans

NOTES, CHANGES = "note_id bigint, path string, title string", "change_id bigint, status string, path string, changed_at timestamp_ntz, arrived_at timestamp_ntz"
LINKS, CHUNKS = "link_id bigint, src string, target_key string, seen_at timestamp_ntz, h string, key string", "chunk_id bigint, path string, indexed_at timestamp_ntz"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def norm(x):
    return x.strip().replace("\\", "/").lstrip("./").lower().removesuffix(".md")


def brute(notes, changes, links, chunks):
    paths = {norm(p) for _, p, _ in notes if p}
    added, last = {}, {}
    for i, s, p, c, a in changes:
        if p:
            if s == "A":
                added[norm(p)] = min(added.get(norm(p), c), c)
            last[norm(p)] = max(last.get(norm(p), ((c, a, i), s)), ((c, a, i), s))
    dead = {p for p, (_, s) in last.items() if s == "D"}
    out = set()
    refs = [("links", i, f, v, t, f == "target_key") for i, s, k, t, *_ in links for f, v in (("src", s), ("target_key", k))] + [("chunks", i, "path", p, t, False) for i, p, t in chunks]
    for table, i, field, value, time, suffix in refs:
        if value is None or not value.strip():
            continue
        key = norm(value)
        fits = lambda p: p == key or suffix and p.endswith("/" + key)  # noqa: B023, E731
        good = [p for p in paths if fits(p)]
        if good:
            if time is not None and all(p in added and added[p] > time for p in good):
                out.add((table, i, field, "late"))
        else:
            out.add((table, i, field, "deleted" if any(fits(p) for p in dead) else "missing"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(5)
    names = [f"{a}/{b}{c}.md" for a in "xyz" for b in "pq" for c in range(4)] + ["top.md", "z/sub/deep.md"]
    notes = [(i, p, "t") for i, p in enumerate(r.sample(names, 14))] + [(99, None, None)]
    changes = [(i, r.choice("AMD"), r.choice(names), at(r.randrange(60)), at(r.randrange(60))) for i in range(60)] + [(999, "A", None, at(1), at(1))]
    ref = lambda: r.choice([None, " ", "./", " .\\X\\P1.md", "hot", *names, *[n.split("/")[-1][:-3].upper() for n in names], "/" + names[0], "none/at/all"])
    links = [(i, ref(), "top" if i % 3 == 0 else ref(), r.choice([None, at(r.randrange(60))]), "h", "k") for i in range(600)]
    chunks = [(i, ref(), at(r.randrange(60))) for i in range(80)]
    links, chunks = [x for x in links if x[1] != "./" and x[2] != "./"], [x for x in chunks if x[1] != "./"]
    df = [spark.createDataFrame(x, s) for x, s in ((notes, NOTES), (changes, CHANGES), (links * 2, LINKS), (chunks * 2, CHUNKS))]
    got = orphans.orphan_rows(orphans.reference_rows(df[2], df[3]), orphans.parent_rows(df[0], df[1]), ranges=7)
    assert rows(got.drop("at")) == brute(notes, changes, links, chunks)
    total = sum(x["orphans"] for x in orphans.orphan_report(got).collect())
    assert total == got.count()


def test_empty_tables(spark):
    df = [spark.createDataFrame([], s) for s in (NOTES, CHANGES, LINKS, CHUNKS)]
    assert orphans.orphan_rows(orphans.reference_rows(df[2], df[3]), orphans.parent_rows(df[0], df[1])).collect() == []
    one = spark.createDataFrame([(1, "a", None, at(1), "", "")], LINKS)
    assert rows(orphans.orphan_rows(orphans.reference_rows(one, df[3]), orphans.parent_rows(df[0], df[1])).drop("at")) == [("links", 1, "src", "missing")]
