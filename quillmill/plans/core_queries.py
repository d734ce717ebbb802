"""Queries of the core operators over the vault tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text, vectors
from ..operators import chunking, filters, graph, incremental, ranking, writes
from ..session import shared_dir
from ..sources import documents as extractors
from ..sources import files, paths
from ..sources.tables import table
from ..streaming import sync
from . import evaluate
from .registry import Registry

REG = Registry()
T1, T2 = "2025-01-01 00:00:00", "2025-07-01 00:00:00"

# ---- shared inputs ----


def _notes(spark, d):
    return ranking.current_notes(table(spark, d, "notes").drop("note_id"))


def _tags(spark, d):
    return ranking.tag_lists(table(spark, d, "tags"), keys.normalize_tag(F.col("tag")))


def _indexed(spark, d):
    return ranking.indexed_chunks(table(spark, d, "chunks"), _notes(spark, d), _tags(spark, d))


def _keyword(spark, d, k, wanted=None):
    tags = None if wanted is None else _tags(spark, d)
    return ranking.top(ranking.bm25_of(_asked(spark, d), table(spark, d, "chunks"), _notes(spark, d), tags, wanted, k=k), k)


def _links(spark, d):
    return table(spark, d, "links").dropDuplicates(["link_id"])


def _asked(spark, d):
    return table(spark, d, "eval_queries").dropDuplicates(["qid"])


def _tagged(spark, d):
    return _notes(spark, d).join(_tags(spark, d), "path", "left")


_KEY = r"regexp_replace(lower(regexp_replace(replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\', '/'), '^[./]+', '')), '\.md$', '')"
_TAG = "lower(trim(ltrim(trim(tag, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '#'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_CUR = """cur AS (SELECT * EXCLUDE (note_id, rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(modified, -1) DESC, coalesce(content_hash, '') DESC) AS rn FROM notes WHERE path IS NOT NULL) WHERE rn = 1)"""
_TAGL = f"""tagl AS (SELECT path, list_sort(list(DISTINCT t)) AS tags FROM (SELECT path, {_TAG} AS t FROM tags) WHERE t IS NOT NULL AND t <> '' GROUP BY path)"""
_IDX = """idx AS (SELECT c.*, n.kind, n.title, n.status, n.modified, coalesce(t.tags, []) AS tags FROM (SELECT DISTINCT chunk_id, path, ord, headings, text FROM chunks) c JOIN cur n USING (path) LEFT JOIN tagl t USING (path))"""
_ASK = "ask AS (SELECT DISTINCT qid, query, relevant, lang FROM eval_queries)"
_TOK = r"regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\p{{L}}\p{{N}}]+')"
_TERMS = r"terms AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+')) AS term FROM ask) WHERE length(term) > 1 OR regexp_full_match(term, '\d+'))"
_BM25 = f"""WITH {_CUR}, {_TAGL}, {_IDX}, {_ASK}, {_TERMS},
phr AS (SELECT qid, array_to_string({_TOK.format('term')}, ' ') AS phrase FROM terms),
tok AS (SELECT chunk_id, {_TOK.format('title')} AS a, {_TOK.format("array_to_string(headings, ' ')")} AS b, {_TOK.format('text')} AS c FROM idx),
siz AS (SELECT *, len(a) + len(b) + len(c) AS size FROM tok),
sta AS (SELECT count(*) AS n, avg(size) AS mean FROM siz),
pst AS (SELECT chunk_id, size, unnest(a) AS phrase, 5.0::DOUBLE AS w FROM siz UNION ALL SELECT chunk_id, size, unnest(b), 2.0 FROM siz UNION ALL SELECT chunk_id, size, unnest(c), 1.0 FROM siz),
tf AS (SELECT phrase, chunk_id, size, sum(w) AS f FROM pst GROUP BY ALL),
idf AS (SELECT phrase, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, sta GROUP BY phrase, n),
sc AS (SELECT qid, chunk_id, sum(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN idf USING (phrase) JOIN phr USING (phrase), sta GROUP BY qid, chunk_id),
kw AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)"""
_DIST = "CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) > 0 THEN 1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) END"
_HYBRID = f"""{_BM25},
vec AS (SELECT i.chunk_id, e.embedding FROM idx i JOIN embeddings e ON e.vec_id = i.chunk_id),
qv AS (SELECT qid, embedding AS vector FROM ask JOIN embeddings e ON e.vec_id = qid),
dist AS (SELECT qid, chunk_id, {_DIST.format(a='embedding', b='vector')} AS score FROM vec, qv),
se AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) NULLS LAST, chunk_id) AS rank FROM dist),
bo AS (SELECT qid, chunk_id, max(k) AS k, max(s) AS s FROM (SELECT qid, chunk_id, rank AS k, NULL AS s FROM kw WHERE rank <= 50 UNION ALL SELECT qid, chunk_id, NULL, rank FROM se WHERE rank <= 50) GROUP BY ALL),
fu AS (SELECT *, coalesce(1.0::DOUBLE / (60 + k), 0) + coalesce(1.0::DOUBLE / (60 + s), 0) AS raw, CASE WHEN k IS NOT NULL AND s IS NOT NULL THEN 'both' WHEN k IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS match FROM bo),
ranked AS (SELECT qid, chunk_id, round(raw, 6) AS score, match, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, k NULLS LAST, s NULLS LAST) AS rank FROM fu)"""
_KEYS = f"""fk AS (SELECT path, i = 1 AS is_full, array_to_string(list_slice(string_split(k, '/'), i, 99999), '/') AS key FROM (SELECT path, {_KEY.format('path')} AS k FROM {{files}}), unnest(range(1, len(string_split(k, '/')) + 1)) AS t(i)),
best AS (SELECT key, coalesce(max(path) FILTER (is_full), min_by(path, (length(path) - length(replace(path, '/', '')), length(path), path))) AS path FROM fk WHERE key <> '' GROUP BY key)"""
_FILES = "f AS (SELECT DISTINCT path FROM notes WHERE path IS NOT NULL)"
_LINKS = "l AS (SELECT DISTINCT * FROM links)"
_RES = f"WITH {_FILES}, {_KEYS.format(files='f')}, {_LINKS}, r AS (SELECT l.*, b.path AS resolved FROM l LEFT JOIN best b ON b.key = {_KEY.format('l.target')})"
_STATE = "(SELECT path, arg_max(status, (changed_at, arrived_at, change_id)) AS status, max(changed_at) AS changed_at FROM changes WHERE path IS NOT NULL AND changed_at < TIMESTAMP '{0}' GROUP BY path)"

# ---- sources ----


@REG.add("s3_kind", r"SELECT DISTINCT path, CASE s WHEN 'htm' THEN 'html' ELSE s END AS kind FROM (SELECT path, lower(regexp_extract(path, '[^./]\.([^./]+)$', 1)) AS s FROM notes WHERE path IS NOT NULL)")
def s3_kind(spark, d):
    return table(spark, d, "notes").filter("path is not null").select("path", paths.kind_of(F.col("path")).alias("kind")).distinct()


@REG.add("s4_normalize_path", r"""WITH p AS (SELECT DISTINCT src, replace(src, '\', '/') AS s FROM links WHERE src IS NOT NULL), q AS (SELECT *, list_filter(string_split(s, '/'), lambda x: x <> '' AND x <> '.') AS w FROM p)
SELECT src, CASE WHEN NOT (starts_with(s, '/') OR regexp_matches(s, '^[A-Za-z]:') OR list_contains(w, '..') OR len(w) = 0) AND w[1] NOT IN ('.git', '.obsidian', '.trash') THEN array_to_string(w, '/') END AS path FROM q""")
def s4_normalize_path(spark, d):
    return table(spark, d, "links").filter("src is not null").select("src", paths.normalize_path(F.col("src")).alias("path")).distinct()


def _parsed(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return files.parse_files(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(0).cast("bigint").alias("modified"), F.col("text").cast("binary").alias("content")))


@REG.add("s5_notes")
def s5_notes(spark, d):
    return files.notes_of(_parsed(spark, d))


@REG.add("s5_tags")
def s5_tags(spark, d):
    return files.tags_of(_parsed(spark, d))


@REG.add("s5_links")
def s5_links(spark, d):
    return files.links_of(_parsed(spark, d))


@REG.add("s5_chunks")
def s5_chunks(spark, d):
    return files.chunks_of(_parsed(spark, d))


@REG.add("s12_last_modified", "SELECT path, max(changed_at) AS modified FROM changes WHERE path IS NOT NULL GROUP BY path")
def s12_last_modified(spark, d):
    return incremental.last_modified(table(spark, d, "changes"))


# ---- filters ----


@REG.add("f1_path_prefix", f"WITH {_CUR} SELECT path FROM cur WHERE starts_with(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'projekte/a')")
def f1_path_prefix(spark, d):
    return _notes(spark, d).filter(filters.path_prefix(F.col("path"), "/projekte/A")).select("path")


@REG.add("f2_tags_all", f"WITH {_CUR}, {_TAGL} SELECT path FROM cur JOIN tagl USING (path) WHERE len(list_filter(tags, lambda t: t = 'software' OR starts_with(t, 'software/'))) > 0 AND len(list_filter(tags, lambda t: t = 'inbox' OR starts_with(t, 'inbox/'))) > 0")
def f2_tags_all(spark, d):
    return _tagged(spark, d).filter(filters.predicate(filters.SearchFilters(tags=("#Software", "inbox")))).select("path")


@REG.add("f3_status", f"WITH {_CUR} SELECT path FROM cur WHERE status = 'curated'")
def f3_status(spark, d):
    return _tagged(spark, d).filter(filters.predicate(filters.SearchFilters(status="curated"))).select("path")


@REG.add("f4_no_inbox", f"WITH {_CUR} SELECT path FROM cur WHERE NOT (starts_with(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'inbox/') OR coalesce(status, '') = 'inbox')")
def f4_no_inbox(spark, d):
    return _tagged(spark, d).filter(filters.predicate(filters.SearchFilters(include_inbox=False, inbox="Inbox"))).select("path")


@REG.add("f5_f6_modified_range", f"WITH {_CUR} SELECT path, modified FROM cur WHERE modified >= 1735689600 AND modified < 1751328000")
def f5_f6_modified_range(spark, d):
    return _tagged(spark, d).filter(filters.predicate(filters.SearchFilters(modified_after=1735689600, modified_before=1751328000))).select("path", "modified")


# ---- joins, sets, counts ----


@REG.add("j8_removed", f"SELECT path FROM {_STATE.format(T2)} WHERE path NOT IN (SELECT path FROM {_STATE.format(T2)} WHERE status <> 'D') UNION SELECT DISTINCT path FROM changes WHERE path IS NOT NULL AND changed_at < TIMESTAMP '{T2}' AND path NOT IN (SELECT path FROM {_STATE.format(T2)} WHERE status <> 'D')")
def j8_removed(spark, d):
    # every path that was ever there before T2, against what is there at T2
    ever = table(spark, d, "changes").filter(F.col("path").isNotNull() & (F.col("changed_at") < F.lit(T2).cast("timestamp_ntz")))
    return incremental.removed(ever, _listing(spark, d, T2))


@REG.add("j10_missing_relevant", "SELECT DISTINCT path FROM (SELECT unnest(relevant) AS path FROM eval_queries) WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM notes WHERE path IS NOT NULL AND status = 'curated')")
def j10_missing_relevant(spark, d):
    # against the notes that were ever curated, so that some are missing
    return evaluate.missing_relevant(_asked(spark, d), table(spark, d, "notes").filter("path is not null and status = 'curated'")).filter("path is not null")


@REG.add("o4_recheck", f"""WITH c AS (SELECT path, status AS op, 0 AS i FROM {_STATE.format(T1)} UNION ALL SELECT DISTINCT path, 'M', 1 FROM notes WHERE status = 'draft' AND path IS NOT NULL UNION ALL SELECT DISTINCT path, 'M', 2 FROM notes WHERE status = 'inbox' AND path IS NOT NULL)
SELECT path, arg_min(op, i) AS op FROM c GROUP BY path""")
def o4_recheck(spark, d):
    notes = table(spark, d, "notes").filter("path is not null")
    states = incremental.latest_state(table(spark, d, "changes").filter(f"changed_at < '{T1}'")).withColumnRenamed("status", "op")
    return incremental.to_recheck(states, notes.filter("status = 'draft'").select("path").distinct(), notes.filter("status = 'inbox'").select("path").distinct())


@REG.add("a1_status", "SELECT (SELECT count(DISTINCT path) FROM notes) AS notes, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks")
def a1_status(spark, d):
    n = table(spark, d, "notes").agg(F.count_distinct("path").alias("notes"))
    c = table(spark, d, "chunks").agg(F.count_distinct("chunk_id").alias("chunks"))
    return n.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")


@REG.add("a9_percentiles", """WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, round(v[least(n, CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1)], 1) AS p50, round(v[least(n, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1)], 1) AS p95 FROM v""")
def a9_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events"), "event_type", "value")


# ---- retrieval ----


@REG.add("r1_query_terms", f"WITH {_ASK}, {_TERMS} SELECT qid, term FROM terms")
def r1_query_terms(spark, d):
    return _asked(spark, d).select("qid", F.explode(text.query_terms(F.col("query"))).alias("term"))


@REG.add("r2_bm25_topk", f"{_BM25} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM kw WHERE rank <= 10")
def r2_bm25_topk(spark, d):
    return _keyword(spark, d, 10).withColumn("score", F.round("score", 6))


@REG.add("r2_bm25_filtered", f"{_BM25}, ok AS (SELECT s.* FROM sc s JOIN idx USING (chunk_id) WHERE status = 'curated'), rk AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ok) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def r2_bm25_filtered(spark, d):
    wanted = filters.predicate(filters.SearchFilters(status="curated"))
    return _keyword(spark, d, 10, wanted).withColumn("score", F.round("score", 6))


@REG.add("r3_cosine_topk", f"""WITH q AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id AS chunk_id, {_DIST.format(a='embedding', b='vector')} AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) NULLS LAST, chunk_id) AS rank FROM s) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def r3_cosine_topk(spark, d):
    vecs = table(spark, d, "embeddings")
    asked = vecs.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return ranking.cosine_top(vecs.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, 10).withColumn("score", F.round("score", 6))


def _hybrid(spark, d):
    indexed, asked, vecs = _indexed(spark, d), _asked(spark, d), table(spark, d, "embeddings")
    keyword = _keyword(spark, d, 50)
    vectors = indexed.select("chunk_id").join(vecs, F.col("vec_id") == F.col("chunk_id")).select("chunk_id", "embedding")
    vector = asked.join(vecs, F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("vector"))
    return ranking.fuse(keyword, ranking.cosine_top(vectors, vector, 50), 8), indexed


@REG.add("r4_rrf_hybrid", f"{_HYBRID} SELECT qid, chunk_id, score, match, rank FROM ranked WHERE rank <= 8")
def r4_rrf_hybrid(spark, d):
    return _hybrid(spark, d)[0]


@REG.add("r6_hits", f"{_HYBRID} SELECT qid, rank, path, title, headings, text, score, match, kind, status, tags, modified FROM ranked JOIN idx USING (chunk_id) WHERE rank <= 8")
def r6_hits(spark, d):
    return ranking.hits_of(_hybrid(spark, d)[0], table(spark, d, "chunks"), _notes(spark, d), _tags(spark, d))


@REG.add("r2_postings", f"WITH {_CUR}, {_TAGL}, {_IDX}, p AS (SELECT chunk_id, 'title' AS \"column\", {_TOK.format('title')} AS w FROM idx UNION ALL SELECT chunk_id, 'headings', {_TOK.format(chr(39).join(['array_to_string(headings, ', ' ', ')']))} FROM idx UNION ALL SELECT chunk_id, 'text', {_TOK.format('text')} FROM idx), e AS (SELECT chunk_id, \"column\", unnest(w) AS term FROM p) SELECT term, chunk_id, \"column\", count(*) AS tf FROM e GROUP BY ALL")
def r2_postings(spark, d):
    return ranking.index_terms(ranking.postings(_indexed(spark, d))).select("term", "chunk_id", "column", F.size("positions").cast("bigint").alias("tf"))


@REG.add("w6_list_notes", f"WITH {_CUR}, m AS (SELECT * FROM cur WHERE starts_with(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'projekte/')) SELECT path, title, status, (SELECT count(*) FROM m) AS total FROM m ORDER BY path LIMIT 50")
def w6_list_notes(spark, d):
    found = _notes(spark, d).filter(filters.path_prefix(F.col("path"), "Projekte/"))
    return found.select("path", "title", "status").orderBy("path").limit(50).withColumn("total", F.lit(found.count()))


# ---- link graph ----


@REG.add("g1_candidate_keys", f"WITH {_FILES}, {_KEYS.format(files='f')} SELECT path, key, is_full FROM fk WHERE key <> ''")
def g1_candidate_keys(spark, d):
    return graph.file_keys(_notes(spark, d))


@REG.add("w8_best_candidate", f"WITH {_FILES}, {_KEYS.format(files='f')} SELECT key, path FROM best")
def w8_best_candidate(spark, d):
    return graph.best_files(_notes(spark, d))


@REG.add("g2_resolve", f"{_RES} SELECT link_id, target, resolved FROM r")
def g2_resolve(spark, d):
    return graph.resolve(_links(spark, d), _notes(spark, d)).select("link_id", "target", "resolved")


@REG.add("g3_unique_names", f"WITH {_FILES}, {_KEYS.format(files='f')}, n AS (SELECT path, string_split({_KEY.format('path')}, '/')[-1] AS bare FROM f) SELECT n.path, bare, n.path = b.path AS is_unique FROM n LEFT JOIN best b ON b.key = n.bare")
def g3_unique_names(spark, d):
    return graph.unique_names(_notes(spark, d))


@REG.add("g5_outgoing", f"{_RES} SELECT src, target, resolved, heading, alias, embed FROM r WHERE src IS NOT NULL")
def g5_outgoing(spark, d):
    return graph.outgoing(_links(spark, d).filter("src is not null"), _notes(spark, d)).select("src", F.inline("links"))


@REG.add("g6_backlinks", f"{_RES}, {_CUR} SELECT r.resolved AS path, r.src, cur.title, r.line, r.heading, r.alias, r.embed, r.context FROM r JOIN cur ON cur.path = r.src WHERE r.resolved IS NOT NULL AND r.resolved <> r.src")
def g6_backlinks(spark, d):
    notes = _notes(spark, d)
    return graph.backlinks(_links(spark, d), notes, notes)


@REG.add("g7_linking_notes", f"{_RES} SELECT DISTINCT resolved AS path, src FROM r WHERE resolved IS NOT NULL AND resolved <> src")
def g7_linking_notes(spark, d):
    return graph.linking_notes(_links(spark, d), _notes(spark, d))


_MOVE = f"""WITH old AS (SELECT path FROM notes WHERE path LIKE '%.md' ORDER BY note_id, path LIMIT 1), {_FILES}, {_KEYS.format(files='f')},
g AS (SELECT CASE WHEN path = (SELECT path FROM old) THEN 'Archiv/moved.md' ELSE path END AS path FROM f),
{_KEYS.format(files='g').replace('fk AS', 'fk2 AS').replace('FROM fk', 'FROM fk2').replace('best AS', 'best2 AS')}, {_LINKS},
s AS (SELECT src, target, count(*) AS links FROM l WHERE src IS NOT NULL GROUP BY ALL),
m AS (SELECT s.*, CASE WHEN b.path = (SELECT path FROM old) THEN 'Archiv/moved.md' ELSE b.path END AS meant, a.path AS now FROM s JOIN best b ON b.key = {_KEY.format('s.target')} LEFT JOIN best2 a ON a.key = {_KEY.format('s.target')}),
n AS (SELECT m.*, string_split({_KEY.format('meant')}, '/')[-1] AS bare, regexp_replace(meant, '(?i)\\.md$', '') AS whole FROM m WHERE now IS DISTINCT FROM meant)
SELECT CASE WHEN src = (SELECT path FROM old) THEN 'Archiv/moved.md' ELSE src END AS src, target, CASE WHEN contains(target, '/') OR u.path <> meant THEN whole ELSE string_split(whole, '/')[-1] END AS new_target, links FROM n JOIN best2 u ON u.key = n.bare"""


@REG.add("g8_move_rewrites", _MOVE)
def g8_move_rewrites(spark, d):
    old = table(spark, d, "notes").filter("path like '%.md'").orderBy("note_id", "path").first()["path"]
    return graph.move_rewrites(_links(spark, d).filter("src is not null"), _notes(spark, d), old, "Archiv/moved.md")


@REG.add("w10_heading_path", r"""WITH li AS (SELECT doc_id, i, unnest_line AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL), unnest(w) WITH ORDINALITY AS t(unnest_line, i)),
h AS (SELECT doc_id, CAST(i - 1 AS INT) AS line, CASE WHEN regexp_matches(s, '^#{1,6}[ \t]+\S') THEN length(regexp_extract(s, '^(#+)', 1)) END AS level, trim(regexp_extract(s, '^#{1,6}[ \t]+(.*)$', 1), ' ' || chr(9) || chr(13)) AS title FROM li),
c AS (SELECT doc_id, line, """ + ", ".join(f"last_value(CASE WHEN level = {i} THEN line END IGNORE NULLS) OVER w AS l{i}, last_value(CASE WHEN level = {i} THEN title END IGNORE NULLS) OVER w AS t{i}" for i in range(1, 7)) + r""" FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id AS doc, line, list_filter([""" + ", ".join(f"CASE WHEN l{i} > greatest(-1" + "".join(f", coalesce(l{j}, -1)" for j in range(1, i)) + f") THEN t{i} END" for i in range(1, 7)) + r"""], lambda x: x IS NOT NULL) AS headings FROM c""")
def w10_heading_path(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    level = F.when(F.col("s").rlike(r"^#{1,6}[ \t]+\S"), F.length(F.regexp_extract("s", r"^(#+)", 1)))
    title = F.regexp_replace(F.regexp_extract("s", r"^#{1,6}[ \t]+(.*)$", 1), r"^[ \t\r]+|[ \t\r]+$", "")
    return graph.heading_paths(lines.select("doc", "line", level.alias("level"), title.alias("title")))


# ---- text functions ----


@REG.add("fn_normalize_tag", f"SELECT DISTINCT tag AS raw, {_TAG} AS tag FROM tags WHERE tag IS NOT NULL")
def fn_normalize_tag(spark, d):
    return table(spark, d, "tags").filter("tag is not null").select(F.col("tag").alias("raw"), keys.normalize_tag(F.col("tag")).alias("tag")).distinct()


@REG.add("fn_link_key", f"SELECT DISTINCT target, {_KEY.format('target')} AS key FROM links WHERE target IS NOT NULL")
def fn_link_key(spark, d):
    return table(spark, d, "links").filter("target is not null").select("target", keys.link_key(F.col("target")).alias("key")).distinct()


@REG.add("fn_slug", r"""WITH s AS (SELECT DISTINCT title, replace(replace(replace(replace(replace(lower(title), chr(160), ' '), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS t FROM notes WHERE title IS NOT NULL),
a AS (SELECT title, trim(regexp_replace(regexp_replace(strip_accents(t), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM s)
SELECT title, CASE WHEN s = '' THEN 'note' WHEN length(s) > 60 THEN CASE WHEN contains(s[1:60], '-') THEN regexp_replace(s[1:60], '-[^-]*$', '') ELSE s[1:60] END ELSE s END AS slug FROM a""")
def fn_slug(spark, d):
    return table(spark, d, "notes").filter("title is not null").select("title").distinct().select("title", text.slugify(F.col("title")).alias("slug"))


@REG.add("fn_sha", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def fn_sha(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.content_sha(F.col("text")).alias("sha"))


@REG.add("fn_iso_time", "SELECT DISTINCT path, modified, strftime(to_timestamp(modified) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM notes WHERE modified IS NOT NULL")
def fn_iso_time(spark, d):
    return table(spark, d, "notes").filter("modified is not null").select("path", "modified", text.iso_time(F.col("modified"), "UTC").alias("iso")).distinct()


@REG.add("c1_chunk_markdown")
def c1_chunk_markdown(spark, d):
    return files.chunks_of(_parsed(spark, d)).groupBy("path").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@REG.add("c6_passage", f"WITH {_CUR}, {_TAGL}, {_IDX} SELECT chunk_id, coalesce(array_to_string(list_filter(list_concat([title], coalesce(headings, [])), lambda x: x IS NOT NULL), ' > '), '') || chr(10) || chr(10) || text AS passage FROM idx WHERE text IS NOT NULL")
def c6_passage(spark, d):
    return _indexed(spark, d).filter("text is not null").select("chunk_id", chunking.passage(F.col("title"), F.col("headings"), F.col("text")).alias("passage"))


@REG.add("e1_html_text")
def e1_html_text(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("source", F.lit("")), F.lit("</title></head><body><h1>Note</h1><p>"), F.col("text"), F.lit("</p></body></html>"))
    made = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.lit(0).cast("bigint").alias("modified"), page.cast("binary").alias("content"))
    return files.parse_files(made).select("path", "title", F.size("chunks").alias("chunks"), "error")


@REG.add("e2_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{00A0}]+', ' ', 'g'), '-\n([a-zäöüß])', '\1', 'g'), ' *\n *', chr(10), 'g'), '(?m)^#', '\\#', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents WHERE text IS NOT NULL""")
def e2_clean(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", extractors.clean_column(F.col("text")).alias("text"))


@REG.add("v1_hash_embed")
def v1_hash_embed(spark, d):
    return vectors.embed(table(spark, d, "notes").filter("title is not null").select("note_id", "title").distinct(), "title")


# ---- incremental ----


def _listing(spark, d, until):
    states = incremental.latest_state(table(spark, d, "changes").filter(F.col("changed_at") < F.lit(until).cast("timestamp_ntz")))
    return states.filter("status <> 'D'").select("path", F.col("changed_at").cast("string").alias("content_hash"))


@REG.add("i1_diff", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS op
FROM (SELECT * FROM {_STATE.format(T1)} WHERE status <> 'D') a FULL JOIN (SELECT * FROM {_STATE.format(T2)} WHERE status <> 'D') b ON a.path = b.path WHERE a.changed_at IS DISTINCT FROM b.changed_at""")
def i1_diff(spark, d):
    return incremental.diff(_listing(spark, d, T1), _listing(spark, d, T2))


@REG.add("i3_unchanged", f"SELECT path FROM (SELECT * FROM {_STATE.format(T1)} WHERE status <> 'D') a JOIN (SELECT * FROM {_STATE.format(T2)} WHERE status <> 'D') b USING (path, changed_at)")
def i3_unchanged(spark, d):
    return incremental.unchanged(_listing(spark, d, T1), _listing(spark, d, T2))


@REG.add("i4_upsert", f"""WITH a AS (SELECT path, changed_at FROM {_STATE.format(T1)} WHERE status <> 'D'), b AS (SELECT path, status, changed_at FROM {_STATE.format(T2)}), t AS (SELECT DISTINCT path FROM changes WHERE path IS NOT NULL AND changed_at >= TIMESTAMP '{T1}' AND changed_at < TIMESTAMP '{T2}')
SELECT path, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS version FROM a WHERE path NOT IN (SELECT path FROM t) UNION ALL SELECT path, strftime(changed_at, '%Y-%m-%d %H:%M:%S') FROM b JOIN t USING (path) WHERE status <> 'D'""")
def i4_upsert(spark, d):
    changes = table(spark, d, "changes").filter("path is not null")
    as_row = lambda df: df.select("path", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("version"))
    before = lambda t: incremental.latest_state(changes.filter(F.col("changed_at") < F.lit(t).cast("timestamp_ntz")))
    touched = changes.filter((F.col("changed_at") >= F.lit(T1).cast("timestamp_ntz")) & (F.col("changed_at") < F.lit(T2).cast("timestamp_ntz"))).select("path").distinct()
    fresh = as_row(before(T2).filter("status <> 'D'")).join(touched, "path", "left_semi")
    return incremental.upsert(as_row(before(T1).filter("status <> 'D'")), fresh, touched)


@REG.add("i8_stream_states", "SELECT path, arg_max(status, (changed_at, arrived_at, change_id)) AS status, arg_max(change_id, (changed_at, arrived_at, change_id)) AS change_id FROM changes WHERE path IS NOT NULL GROUP BY path")
def i8_stream_states(spark, d):
    import uuid

    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "changes")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/changes.parquet")
    reader = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4)
    # a stream reads folders; where the table is one file, it is named by a filter
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    feed = reader.parquet(f"{d}/changes.parquet") if folder else reader.option("pathGlobFilter", "changes.parquet").parquet(d)
    sync.stream_states(feed, f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return sync.SnapshotStore(spark, f"{place}/state").read("states").select("path", "status", "change_id")


# ---- writes, evaluation ----


@REG.add("m4_append_column", r"SELECT doc_id, CASE WHEN b = '' THEN '' ELSE b || chr(10) || chr(10) END || 'Added.' || chr(10) AS text FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\n+\z', '') AS b FROM documents)")
def m4_append_column(spark, d):
    return table(spark, d, "documents").select("doc_id", writes.append_text(F.col("text"), "Added.\n").alias("text"))


@REG.add("m4_append", r"""WITH f AS (SELECT 'doc-' || doc_id || '.md' AS path, coalesce(text, '') AS text, doc_id = (SELECT min(doc_id) FROM documents) AS here FROM documents)
SELECT path, CASE WHEN here THEN regexp_replace(text, '\n+\z', '') || CASE WHEN regexp_replace(text, '\n+\z', '') = '' THEN '' ELSE chr(10) || chr(10) END || 'Added.' || chr(10) ELSE text END AS text FROM f""")
def m4_append(spark, d):
    import datetime as dt

    docs = table(spark, d, "documents")
    first = docs.agg(F.min("doc_id")).first()[0]
    texts = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return writes.append_note(texts, f"doc-{first}.md", "Added.\n", dt.datetime(2026, 1, 1))[0]


@REG.add("m5_delete", f"{_RES} SELECT DISTINCT src FROM r WHERE resolved = (SELECT mode(resolved) FROM r) AND src <> resolved")
def m5_delete(spark, d):
    # the note with the most links is taken out
    links, notes = _links(spark, d).filter("src is not null"), _notes(spark, d)
    most = graph.resolve(links, notes, into="path").filter("path is not null").groupBy("path").count().orderBy(F.desc("count")).first()["path"]
    return writes.delete_note(notes.select("path", F.lit("").alias("text")), links, most)[1].select("src")


def _eval_rows(spark, d):
    indexed, asked = _indexed(spark, d), _asked(spark, d)
    ranked = _keyword(spark, d, 20)
    return evaluate.query_rows(asked, evaluate.note_ranks(ranked, indexed, 5))


_EVAL = f"""{_BM25}, fp AS (SELECT qid, path, min(rank) AS first FROM kw JOIN idx USING (chunk_id) WHERE rank <= 20 GROUP BY ALL),
nr AS (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank FROM fp),
w AS (SELECT qid, lang, list_distinct(relevant) AS rel FROM ask WHERE len(relevant) > 0),
g AS (SELECT w.qid, count(*) AS n, min(rank) AS first FROM w, unnest(rel) AS t(path) JOIN nr ON nr.qid = w.qid AND nr.path = t.path WHERE rank <= 5 GROUP BY w.qid),
er AS (SELECT w.qid, lang, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit1, coalesce(n, 0)::DOUBLE / len(rel) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM w LEFT JOIN g USING (qid))"""


@REG.add("q1_eval_rows", f"{_EVAL} SELECT * FROM er")
def q1_eval_rows(spark, d):
    return _eval_rows(spark, d)


@REG.add("q2_eval_report", f"{_EVAL} SELECT grp, count(*) AS n, round(avg(hit1), 3) AS hit1, round(avg(recall), 3) AS recall, round(avg(mrr), 3) AS mrr FROM (SELECT 'all' AS grp, * FROM er UNION ALL SELECT lang, * FROM er WHERE lang IS NOT NULL AND trim(lang) <> '') GROUP BY grp")
def q2_eval_report(spark, d):
    return evaluate.report(_eval_rows(spark, d))
