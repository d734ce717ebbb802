"""Parsing, chunking, extraction and text functions on small inputs."""

import datetime as dt
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import keys, text, vectors
from quillmill.operators import chunking
from quillmill.sources import documents, markdown, paths

NOTE = """---
title: Datensicherung
tags: [Ops, Backup]
status: curated
created: 2024-05-01
---
# Anderer Titel
Siehe [[Restic#Retention|Aufbewahrung]] und [[Infra/VPS]] #infra/vps #2024
```sh
# kein Titel #nichts [[Nirgends]]
```
`[[auch nicht]]` ![[diagram.png]] [[#lokal]]
"""


def test_note():
    n = markdown.parse("Ops/x.md", NOTE)
    assert (n.title, n.status, n.frontmatter["created"]) == ("Datensicherung", "curated", "2024-05-01")
    assert n.tags == ["Ops", "Backup", "infra/vps"]
    assert [(x.text, x.heading, x.alias, x.embed, x.line) for x in n.links] == [("Restic", "Retention", "Aufbewahrung", False, 8), ("Infra/VPS", None, None, False, 8), ("diagram.png", None, None, True, 12)]


def test_title_falls_back():
    assert markdown.parse("a/b c.md", "no heading").title == "b c"
    assert markdown.parse("a.md", "```\n# code\n```\n# Real #\n").title == "Real"
    assert markdown.parse("a.md", "---\n: bad: [\n---\ntext").frontmatter == {}


@given(st.text(alphabet="`~# \nab[]|", max_size=80))
@settings(max_examples=150, deadline=None)
def test_mask_keeps_length(t):
    assert len(markdown.mask_code(t)) == len(t)


def test_fields_and_links_are_rewritten_in_place():
    t = markdown.set_fields("---\na: 1  # kept\nupdated: x\n---\nbody", {"updated": "2024", "new": 1})
    assert t == "---\na: 1  # kept\nupdated: '2024'\nnew: 1\n---\nbody"
    assert markdown.set_fields("no block", {"a": 1}) == "no block"
    assert markdown.rewrite_links("![[Old#S|A]] [[Keep]]", lambda target: "New" if target == "Old" else None) == ("![[New#S|A]] [[Keep]]", 1)


def test_chunks_follow_headings():
    got = chunking.chunk_markdown("intro\n# A\ntext\n## B\n```\n# no\n```\n# Empty\n")
    assert got == [([], "intro"), (["A"], "text"), (["A", "B"], "```\n# no\n```")]


@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60))
@settings(max_examples=150, deadline=None)
def test_pieces_are_bounded(t, limit):
    assert all(len(p) <= limit for p in chunking.split_text(t.strip(), limit, 8))


def test_html_and_clean():
    title, body = documents.html_text("<head><title>My  page</title><style>x</style></head><h1>Top <b>one</b></h1><p>first<br>line</p><script>no</script><li>x\n# y</li>", "s")
    assert title == "My page"
    assert body.startswith("# Top one\n\nfirst\nline") and "no" not in body and "\\# y" in body
    assert documents.clean("a-\nb   c\x00\n\n\n\nd") == "ab c\n\nd"


def test_docx_and_errors():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'
    cell = lambda s: f"<w:tc>{p(s)}</w:tc>"
    xml = f'<w:document {w}><w:body>{p("Report", "Heading 1")}{p("Hello")}<w:tbl><w:tr>{cell("Key")}{cell("Wert")}{cell("Wert")}</w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert documents.extract("docx", data.getvalue(), "s") == ("Report", "# Report\n\nHello\n\nKey | Wert")
    for kind in ("docx", "pdf", "txt"):
        with pytest.raises(documents.ExtractionError):
            documents.extract(kind, b"garbage", "s")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_columns(spark):
    assert one(spark, keys.link_key(F.lit(" ./Ops\\Backup.MD "))) == "ops/backup"
    assert one(spark, keys.normalize_tag(F.lit(" ## Ops/A "))) == "ops/a"
    assert one(spark, keys.suffix_keys(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, text.query_terms(F.lit("Was ist x 7 foo_bar was?"))) == ["was", "ist", "7", "foo_bar"]
    assert one(spark, text.tokens(F.lit("Über-Straße foo_bar"))) == ["uber", "straße", "foo", "bar"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.slugify(F.lit("Größe & Übung!"))) == "groesse-uebung"
    assert one(spark, text.slugify(F.lit("***"))) == "note"
    assert one(spark, text.slugify(F.lit("word " * 30))) == "-".join(["word"] * 12)
    assert one(spark, text.iso_time(F.lit(1720000000), "Europe/Berlin")) == "2024-07-03T11:46:40+02:00"
    for given_, want in (("a//b/./c.md", "a/b/c.md"), ("/abs", None), ("a/../b", None), ("C:\\x", None), (".git/x", None), ("", None), ("a\\b", "a/b")):
        assert one(spark, paths.normalize_path(F.lit(given_))) == want
    assert one(spark, paths.kind_of(F.lit("a/b.HTM"))) == "html"
    assert one(spark, paths.is_indexable(F.lit("x/.obsidian/a.md"))) is False


def test_hash_embedder():
    e = vectors.HashEmbedder()
    assert e.query("restic")[187] == -1 and e.query("über")[71] == -1
    assert not e.query("").any()
    assert abs(float((e.query("a b c") ** 2).sum()) - 1) < 1e-6


def test_append(spark):
    from quillmill.operators.writes import added_text, append_text

    assert one(spark, append_text(F.lit("a\n\n"), "b\n")) == "a\n\nb\n"
    assert one(spark, append_text(F.lit(None).cast("string"), "b")) == "b\n"
    made = added_text("T", "body", "id-1", dt.datetime(2026, 10, 3, 18, 45, 12), tags=["#x", "x", " "])
    assert made.startswith("---\nid: id-1\ntitle: T\n") and made.endswith("\n# T\n\nbody\n") and "tags: [x]" in made
