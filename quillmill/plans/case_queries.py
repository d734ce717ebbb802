"""Queries of the parsing functions over literal inputs, with the outputs that their rules demand as SQL values.

SQL has no way to parse Markdown, HTML or DOCX in full; these cases pin every rule down on inputs that are written out here.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import chunking, writes
from ..sources import documents, files, markdown
from .registry import Registry

REG = Registry()


def _sql(columns: list[str], rows: list[tuple]) -> str:
    """A VALUES table."""
    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def _cases(name: str, given: list[str], run, wanted: list) -> None:
    """Register a query (case_no, value) of ``run`` over the given inputs; ``wanted`` are its values, written as JSON."""
    @REG.add(name, _sql(["case_no", "value"], [(i, json.dumps(w, ensure_ascii=False)) for i, w in enumerate(wanted)]))
    def query(spark, d):
        cases = spark.createDataFrame(list(enumerate(given)), "case_no int, input string")
        value = F.udf(lambda x: json.dumps(run(x), ensure_ascii=False), "string")
        return cases.select("case_no", value("input").alias("value"))


_cases("md_frontmatter", ["---\na: 1\nb: [x, y]\n---\nbody", "---\nd: 2024-05-01\n...\nrest", "---\n: bad: [\n---\nafter", "---\n- only\n---\nz", "no block", "---\nopen: 1\n", "--- \nn: null\n---"],
       lambda t: (lambda f: [f[0], t[f[1]:]])(markdown.split_frontmatter(t)),
       [[{"a": 1, "b": ["x", "y"]}, "body"], [{"d": "2024-05-01"}, "rest"], [{}, "after"], [{}, "z"], [{}, "no block"], [{}, "---\nopen: 1\n"], [{"n": None}, ""]])

_cases("md_plain_values", ["a: 2024-01-02", "a: 2024-01-02 03:04:05", "a: {b: [1, true, 1.5]}", "1: x", "a: '2024'"],
       lambda y: markdown.split_frontmatter(f"---\n{y}\n---\n")[0],
       [{"a": "2024-01-02"}, {"a": "2024-01-02T03:04:05"}, {"a": {"b": [1, True, 1.5]}}, {"1": "x"}, {"a": "2024"}])

_cases("md_render", ['{"b": "ä", "a": [1, "x"]}', "{}"], lambda j: markdown.render_frontmatter(json.loads(j)), ["---\nb: ä\na: [1, x]\n---\n", "---\n{}\n---\n"])

_cases("md_set_fields", ["---\na: 1  # kept\nupdated: x\n---\nbody", "---\na: 1\n---\n", "no block", "---\nxupdated: 1\n  updated: 2\n---\n"],
       lambda t: markdown.set_fields(t, {"updated": "new"}),
       ["---\na: 1  # kept\nupdated: new\n---\nbody", "---\na: 1\nupdated: new\n---\n", "no block", "---\nxupdated: 1\n  updated: 2\nupdated: new\n---\n"])

_cases("md_mask", ["a `b` c", "``x`y`` z", "```\n# h\n```\nt", "~~~\na\n```\nb\n~~~~\nc", "   ```\nx", "    ```\nx", "`open", "````\n```\n````\nz"], markdown.mask_code,
       ["a     c", "        z", "   \n   \n   \nt", "   \n \n   \n \n    \nc", "      \n ", "    ```\nx", "`open", "    \n   \n    \nz"])

_cases("md_tags", ["---\ntags: [Ops, Backup]\n---\n#infra/vps #2024", "---\ntag: a, b c\n---\n", "---\ntags: null\ntag: x\n---\n#y", "---\ntags: [2024]\n---\n", "x#no (#yes) &#no ##no `#no` #a-b- #a/", "# head #tag"],
       lambda t: markdown.parse("n.md", t).tags,
       [["Ops", "Backup", "infra/vps"], ["a", "b", "c"], ["y"], ["2024"], ["yes", "a-b", "a"], ["tag"]])

_cases("md_links", ["x\n[[Restic#Retention|Aufbewahrung]] ![[d.png]]", "[[#local]] [[ A ]] `[[code]]`", "---\nl: '[[In/front]]'\n---\n[[b#^ref]]", "[[a|b|c]] [[]] [[x\ny]]", "```\n[[no]]\n```\n  [[yes]]  "],
       lambda t: [[x.text, x.heading, x.alias, x.embed, x.line, x.context] for x in markdown.parse("n.md", t).links],
       [[["Restic", "Retention", "Aufbewahrung", False, 2, "[[Restic#Retention|Aufbewahrung]] ![[d.png]]"], ["d.png", None, None, True, 2, "[[Restic#Retention|Aufbewahrung]] ![[d.png]]"]],
        [["A", None, None, False, 1, "[[#local]] [[ A ]] `[[code]]`"]],
        [["In/front", None, None, False, 2, "l: '[[In/front]]'"], ["b", "^ref", None, False, 4, "[[b#^ref]]"]],
        [["a", None, "b|c", False, 1, "[[a|b|c]] [[]] [[x"]],
        [["yes", None, None, False, 4, "[[yes]]"]]])

_cases("md_titles", ["---\ntitle: T\n---\n# H", "---\ntitle: ' '\n---\n# H #", "## no\n# Yes", "```\n# code\n```\ntext", "---\ntitle: 5\n---\n"], lambda t: markdown.parse("a/b c.md", t).title, ["T", "H", "Yes", "b c", "b c"])

_cases("md_rewrite", ["![[Old#S|A]] [[Keep]]", "`[[Old]]` [[ Old ]]", "[[Old]][[Old|x]]"], lambda t: list(markdown.rewrite_links(t, {"Old": "New/O"}.get)), [["![[New/O#S|A]] [[Keep]]", 1], ["`[[Old]]` [[New/O]]", 1], ["[[New/O]][[New/O|x]]", 2]])

_cases("c1_chunks", ["intro\n# A\ntext\n## B\n```\n# no\n```\n# Empty\n", "### deep\nx\n# top\ny\n## sub\nz", "#no heading", ""],
       lambda t: [[h, p] for h, p in chunking.chunk_markdown(t)],
       [[[[], "intro"], [["A"], "text"], [["A", "B"], "```\n# no\n```"]], [[["deep"], "x"], [["top"], "y"], [["top", "sub"], "z"]], [[[], "#no heading"]], []])

_cases("c2_split_text", ["short", "", "aaaa bbbb\n\ncccc dddd\n\neeee ffff", "One two. Three four. Five six.", "x" * 45, "aaaaaaaaaaaaa bbbbbbbbbbbbbbbbb"],
       lambda t: chunking.split_text(t, 20, 6),
       [["short"], [], ["aaaa bbbb\n\ncccc dddd", "dddd eeee ffff"], ["One two.", "two. Three four.", "four. Five six."], ["x" * 20, "x" * 20, "xxxxxx xxxxx"], ["aaaaaaaaaaaaa", "bbbbbbbbbbbbbbbbb"]])

_cases("c5_chunk_plain", ["  a b  ", ""], lambda t: [[h, p] for h, p in chunking.chunk_plain(t, headings=["H"])], [[[["H"], "a b"]], []])

_PAGES = ["<title> My  page </title><h1>Top <b>one</b></h1><p>first<br>line</p>", "<style>x</style><script>no</script><p>yes</p><li>#item</li>", "<h1>H</h1><h2>a\nb</h2>", "a<br/>b<br>c", "<noscript>never closed <p>gone", "<h1> </h1>text", "&lt;tag&gt; &amp; more"]
_cases("e1_html", _PAGES, lambda t: list(documents.html_text(t, "stem")),
       [["My page", "# Top one\n\nfirst\nline"], ["stem", "yes\n\n\\#item"], ["H", "# H\n\n## a b"], ["stem", "a\n\nb\nc"], ["stem", ""], ["stem", "text"], ["stem", "<tag> & more"]])

_cases("e2_clean_cases", ["a-\nb", "a-\nB", "a \t b", " x \n y ", "# h", "a\n\n\n\nb", "\x00z"], documents.clean, ["ab", "a-\nB", "a b", "x\ny", "\\# h", "a\n\nb", "z"])


def _docx(paragraphs: list[tuple[str, str]]) -> bytes:
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    one = lambda style, text: f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{one('', text)}</w:tc>"
    body = "".join(f"<w:tbl><w:tr>{''.join(map(cell, text.split(';')))}</w:tr></w:tbl>" if style == "table" else one(style, text) for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{name}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


_cases("e3_docx", ['[["Heading 1", "Report"], ["", "Hello"], ["table", "Key;Wert;Wert"]]', '[["Title", "T"], ["Überschrift 2", "U"]]', '[["", "only text"]]'],
       lambda j: list(documents.docx_text(_docx([tuple(x) for x in json.loads(j)]), "stem")),
       [["Report", "# Report\n\nHello\n\nKey | Wert"], ["T", "# T\n\n## U"], ["stem", "only text"]])

_cases("v1_places", ["restic", "über", "RESTIC!", ""], lambda t: [[i, round(float(x), 6)] for i, x in enumerate(vectors.HashEmbedder().query(t)) if x], [[[187, -1.0]], [[71, -1.0]], [[187, -1.0]], []])

_cases("m2_added_text", ["body", "# Own\ntext\n", ""], lambda b: writes.added_text("T", b, "id-1", __import__("datetime").datetime(2026, 10, 3, 18, 45, 12), tags=["#x", "x", " "]),
       [f"---\nid: id-1\ntitle: T\ncreated: '2026-10-03T18:45:12'\nupdated: '2026-10-03T18:45:12'\nstatus: inbox\nsource: mcp\ncaptured_by: unknown\ntags: [x]\n---\n\n{t}\n" for t in ("# T\n\nbody", "# Own\ntext", "# T")])


@REG.add("s9_dispatch", _sql(["path", "title", "chunks", "failed"], [("a.md", "Head", 1, False), ("b.HTML", "Page", 1, False), ("c.htm", "c", 1, False), ("d.docx", "R", 1, False), ("e.docx", None, None, True), ("f.pdf", None, None, True), ("g.html", None, None, True), ("empty.md", "empty", 1, False)]))
def s9_dispatch(spark, d):
    """Every kind through the one way in: broken and oversized documents fail alone, other files are left out."""
    rows = [("a.md", b"# Head\ntext"), ("b.HTML", b"<title>Page</title>x"), ("c.htm", b"x"), ("d.docx", _docx([("Heading 1", "R"), ("", "t")])), ("e.docx", b"garbage"), ("f.pdf", b"garbage"), ("g.html", b"x" * (1024 * 1024 + 1)), ("empty.md", b""), ("h.txt", b"x"), (".obsidian/i.md", b"x")]
    given = spark.createDataFrame([(p, 0, c) for p, c in rows], "path string, modified bigint, content binary")
    return files.parse_files(given, max_document_mb=1).select("path", "title", F.when(F.col("error").isNull(), F.size("chunks")).alias("chunks"), F.col("error").isNotNull().alias("failed"))
