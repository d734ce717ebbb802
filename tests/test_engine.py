"""A small vault end to end: index runs, search, graph, edits, snapshots, evaluation, streaming."""

import datetime as dt
import math
import random
import sqlite3

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillmill.operators import graph, incremental, ranking, scoring, writes
from quillmill.operators.filters import SearchFilters
from quillmill.plans import evaluate
from quillmill.plans.engine import Engine
from quillmill.sources import files as sources
from quillmill.streaming.snapshots import Conflict, SnapshotStore
from quillmill.streaming.sync import Indexer, pushed, stream_states

VAULT = {
    "Ops/Backup-Strategie.md": "---\ntags: [ops]\nstatus: curated\n---\n# Backup-Strategie\nMit [[Restic]] auf [[Infra/VPS#Netz|den VPS]]. #ops/backup\n## Aufbewahrung\nSnapshots bleiben 30 Tage.\n",
    "Tools/Restic.md": "# Restic\nSiehe [[Backup-Strategie]].\n## Retention\n`restic forget`\n",
    "Infra/VPS.md": "---\ntitle: VPS\ntags: infra\n---\n## Netz\nSicherung mit [[Tools/Restic|restic]].\n",
    "Kochen/Brot.md": "# Sauerteigbrot\nMehl und Wasser #kochen\n",
    ".obsidian/workspace.md": "# no\n",
}
NOW = dt.datetime(2026, 10, 3, 18, 45, 12)


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for path, text in VAULT.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("index")))
    stats = Indexer(store, str(root)).run()
    return root, store, stats


def test_index_and_search(spark, vault):
    root, store, stats = vault
    assert (stats.mode, stats.indexed, stats.failed) == ("full", 4, 0)
    engine = Engine.open(store)
    assert rows(engine.notes, "path") == [("Infra/VPS.md",), ("Kochen/Brot.md",), ("Ops/Backup-Strategie.md",), ("Tools/Restic.md",)]
    first = engine.search("Snapshots Aufbewahrung").first()
    assert (first["path"], list(first["headings"]), first["match"]) == ("Ops/Backup-Strategie.md", ["Backup-Strategie", "Aufbewahrung"], "both")
    found = lambda **f: {r["path"] for r in engine.search("restic sicherung", filters=SearchFilters(**f)).collect()}
    assert found(path_prefix="tools/") == {"Tools/Restic.md"} and found(tags=("ops",)) == {"Ops/Backup-Strategie.md"}
    assert found(status="curated") == {"Ops/Backup-Strategie.md"} and found(modified_after=4_000_000_000) == set()
    assert engine.search("!!", mode="keyword").collect() == [] and engine.list_notes("100%_").collect() == []
    with pytest.raises(ValueError):
        engine.search(" ")
    assert rows(engine.backlinks("Restic"), "src", "alias") == [("Infra/VPS.md", "restic"), ("Ops/Backup-Strategie.md", None)]
    note = engine.get_note("restic").first()
    assert note["path"] == "Tools/Restic.md" and note["links"][0]["resolved"] == "Ops/Backup-Strategie.md"
    assert engine.status().first()["notes"] == 4
    queries = spark.createDataFrame([(0, "Snapshots Aufbewahrung", ["Ops/Backup-Strategie.md"], "de"), (1, "zzz unknown", ["Missing.md"], None)], "qid bigint, query string, relevant array<string>, lang string")
    report = {r["grp"]: r for r in engine.evaluate(queries, 3, ("keyword",))["keyword"]}
    assert report["de"]["hit1"] == 1.0 and report["all"]["n"] == 2 and report["all"]["recall"] == 0.5
    assert rows(evaluate.missing_relevant(queries, engine.notes)) == [("Missing.md",)]


def test_incremental_run_equals_rebuild(spark, vault, tmp_path):
    root, store, _ = vault
    assert Indexer(store, str(root)).run().mode == "none"
    (root / "Tools/Restic.md").write_text("# Restic\nneu\n", encoding="utf-8")
    (root / "Neu.md").write_text("# Neu\n", encoding="utf-8")
    (root / "kaputt.docx").write_bytes(b"garbage")
    (root / "Kochen/Brot.md").unlink()
    stats = Indexer(store, str(root)).run()
    assert (stats.mode, stats.indexed, stats.removed, stats.failed) == ("incremental", 2, 1, 1)
    fresh = SnapshotStore(spark, str(tmp_path / "fresh"))
    Indexer(fresh, str(root)).run()
    for name in ("notes", "tags", "links", "chunks"):
        a, b = store.read(name), fresh.read(name)
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns)), name
    with pytest.raises(Conflict):
        store.publish({"tags": store.read("tags")}, None)
    assert store.current().statistics == fresh.current().statistics
    fresh_names = {r["term"] for r in fresh.read("postings").select("term").distinct().collect()}
    assert {r["term"] for r in store.read("postings").select("term").distinct().collect()} == fresh_names
    # a layer holds what changed and no more
    assert spark.read.parquet(store.current().tables["notes"][-1][0]).count() == 2
    a, b = Engine.open(store), Engine.open(fresh)
    assert rows(a.search("neu restic netz", mode="keyword")) == rows(b.search("neu restic netz", mode="keyword"))
    # the broken file is tried again, and nothing else
    again = Indexer(store, str(root)).run()
    assert (again.mode, again.indexed, again.failed, again.unchanged) == ("incremental", 0, 1, 0)
    (root / "kaputt.docx").unlink()
    assert Indexer(store, str(root)).run().removed == 1
    forced = Indexer(store, str(root)).run(forced=True)
    assert (forced.mode, forced.indexed, forced.unchanged) == ("full", 0, 4)
    (root / "Neu.md").write_text("# Neu\nmehr\n", encoding="utf-8")
    assert Indexer(store, str(root)).index_paths(["Neu.md", "gibt/es/nicht.md"]).indexed == 1
    assert store.prune(1) >= 1 and store.read("notes").count() == 4


def _files(spark, **more):
    items = {p: t for p, t in VAULT.items() if not p.startswith(".")} | more
    return spark.createDataFrame(list(items.items()), "path string, text string")


def _links(spark):
    from quillmill.sources import files

    parsed = files.parse_files(_files(spark).select("path", F.lit(0).cast("bigint").alias("modified"), F.col("text").cast("binary").alias("content")))
    return files.links_of(parsed)


def test_moves_keep_meaning(spark):
    links = _links(spark)
    moved, count = writes.move_note(_files(spark), links, "Tools/Restic.md", "Software/Backup/Restic Tool.md")
    text = {r["path"]: r["text"] for r in moved.collect()}
    assert "[[Restic Tool]]" in text["Ops/Backup-Strategie.md"] and "[[Software/Backup/Restic Tool|restic]]" in text["Infra/VPS.md"]
    assert rows(count) == [("Infra/VPS.md", 1), ("Ops/Backup-Strategie.md", 1)]
    assert rows(writes.move_note(_files(spark), links, "Tools/Restic.md", "Archive/Restic.md")[1]) == [("Infra/VPS.md", 1)]
    stolen = {r["path"]: r["text"] for r in writes.move_note(_files(spark), links, "Kochen/Brot.md", "Restic.md")[0].collect()}
    assert "[[Tools/Restic]]" in stolen["Ops/Backup-Strategie.md"]
    for bad in ("Tools/Restic.txt", "Tools/Restic.md", "Infra/VPS.md", "../x.md", "/x.md", ".git/x.md", ""):
        with pytest.raises(writes.WriteError):
            writes.move_note(_files(spark), links, "Tools/Restic.md", bad)


def test_writes(spark):
    files = _files(spark)
    for want in ("same", "same-2"):
        files, path = writes.add_note(files, " Same ", "text", NOW)
        assert path == f"_inbox/2026-10-03-184512-{want}.md"
    changed, sha = writes.append_note(files, "Kochen/Brot.md", "mehr", NOW)
    assert changed.filter("path = 'Kochen/Brot.md'").first()["text"] == VAULT["Kochen/Brot.md"].rstrip("\n") + "\n\nmehr\n"
    with pytest.raises(writes.WriteError):
        writes.update_note(changed, "Kochen/Brot.md", "x", NOW, expected_sha="old")
    writes.update_note(changed, "Kochen/Brot.md", "x", NOW, expected_sha=sha)
    left, dangling = writes.delete_note(_files(spark), _links(spark), "Tools/Restic.md")
    assert rows(dangling) == [("Infra/VPS.md",), ("Ops/Backup-Strategie.md",)] and left.count() == 3


def test_notes_are_shown_live_and_unknown_names_fail(spark, vault):
    root, store, _ = vault
    engine = Engine.open(store, root=str(root))
    note = engine.get_note("VPS").first()
    assert (note["path"], note["title"], note["tags"], note["truncated"]) == ("Infra/VPS.md", "VPS", ["infra"], False)
    assert note["content"] == VAULT["Infra/VPS.md"] and len(note["sha"]) == 64 and note["links"][0]["alias"] == "restic"
    with pytest.raises(LookupError):
        engine.get_note("no such note")
    assert engine.filters(modified_after="2024-07-03T11:46:40+02:00", status="x") == SearchFilters(status="x", modified_after=1720000000)
    with pytest.raises(ValueError):
        engine.filters(modified_before="yesterday")


def test_a_model_that_cannot_be_loaded_leaves_keyword_search(spark, vault):
    def broken():
        raise OSError("no weights")

    engine = Engine.open(vault[1], embedder=broken)
    assert engine.status().first()["model_error"] == "no weights" and not engine.status().first()["semantic_search"]
    assert {r["match"] for r in engine.search("Snapshots Aufbewahrung").collect()} == {"keyword"}
    assert pushed(Indexer(vault[1], str(vault[0])), b"key", b"{}", "sha256=wrong") is None


def test_edits_are_transactions(spark, tmp_path):
    def index(texts):
        parsed = sources.parse_files(texts.select("path", F.lit(0).cast("bigint").alias("modified"), F.col("text").cast("binary").alias("content")))
        return {"links": sources.links_of(parsed), "notes": sources.notes_of(parsed)}

    store = SnapshotStore(spark, str(tmp_path))
    store.publish({"texts": _files(spark), **index(_files(spark))}, None)
    first = store.current().snapshot
    same = lambda files, links: writes.update_note(files, "Kochen/Brot.md", VAULT["Kochen/Brot.md"], NOW)
    assert writes.transact(store, same, index)[0] == "unchanged" and store.current().snapshot == first
    said, counts = writes.transact(store, lambda files, links: writes.move_note(files, links, "Tools/Restic.md", "Archive/R.md"), index)
    assert said == "changed" and store.current().snapshot != first
    assert ("Archive/R.md",) in rows(store.read("notes"), "path") and ("Tools/Restic.md",) not in rows(store.read("notes"), "path")
    assert rows(store.read("links"), "src", "target") == [("Archive/R.md", "Backup-Strategie"), ("Infra/VPS.md", "Archive/R"), ("Ops/Backup-Strategie.md", "Infra/VPS"), ("Ops/Backup-Strategie.md", "R")]

    def late(files, links):
        store.publish({"notes": store.read("notes")}, store.current())
        return writes.append_note(files, "Kochen/Brot.md", "mehr", NOW)

    with pytest.raises(Conflict):
        writes.transact(store, late, index)


def test_scan_of_a_root_with_signs(spark, tmp_path):
    root = tmp_path / "vault(1)+x [a]"
    (root / "a b").mkdir(parents=True)
    (root / "a b/c+d%20.md").write_text("# x", encoding="utf-8")
    for only in (None, ["a b/c+d%20.md", "not/there.md"]):
        assert [r["path"] for r in sources.scan(spark, str(root), only).select("path").collect()] == ["a b/c+d%20.md"]


def test_resolver(spark):
    files = spark.createDataFrame([("Note.md",), ("deep/dir/Note.md",), ("b/Other.md",), ("img/pic.png",), (None,)], "path string")
    asked = spark.createDataFrame([("Note",), ("dir/note",), ("Other.md",), ("pic.png",), ("missing",), ("",), (None,)], "target string")
    got = {r["target"]: r["resolved"] for r in graph.resolve(asked, files.filter("path is not null")).collect()}
    assert got == {"Note": "Note.md", "dir/note": "deep/dir/Note.md", "Other.md": "b/Other.md", "pic.png": "img/pic.png", "missing": None, "": None, None: None}


def test_bm25_equals_full_text_index(spark):
    chunks = [(1, "a", "Backup plan", "Ops", "the backup of the server"), (2, "b", "Recipes", "", "bread and water"), (3, "c", "Server", "Backup Retention", "keep snapshots, keep the foo bar"), (4, "d", "Empty", None, None)]
    df = spark.createDataFrame([(i, p, t, h.split() if h else None, x) for i, p, t, h, x in chunks], "chunk_id bigint, path string, title string, headings array<string>, text string")
    asked = spark.createDataFrame([(0, "backup server"), (1, "foo_bar keep"), (2, "!"), (3, None)], "qid bigint, query string")
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in ranking.bm25(asked, df).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, headings, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t(rowid, title, headings, text) values (?,?,?,?)", [(i, t, h or "", x or "") for i, _, t, h, x in chunks])
    want = {}
    for q, match in ((0, '"backup" OR "server"'), (1, '"foo_bar" OR "keep"')):
        want |= {(q, i): -s for i, s in db.execute("select rowid, bm25(t, 5.0, 2.0, 1.0) from t where t match ?", (match,))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def _chunked(spark, number):
    r = random.Random(5)
    words = [*(f"w{i}" for i in range(30)), "Que", "qué", "alpha", "beta", "alpha", "beta"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    notes = [(f"{i}.md", "md", text(2) if i % 3 else None, "curated" if i % 2 else None, i) for i in range(40)]
    chunks = [(i, f"{r.randrange(44)}.md", i, [text(1)] if i % 2 else None, text(r.randrange(12)) if i % 7 else None) for i in range(number)]
    asked = [(q, text(4) + r.choice([" que qué", " alpha_beta", " beta_alpha_beta", ""])) for q in range(25)] + [(25, "!"), (26, "unknown")]
    return (
        spark.createDataFrame(chunks + chunks[:9], "chunk_id bigint, path string, ord int, headings array<string>, text string"),
        spark.createDataFrame(notes, "path string, kind string, title string, status string, modified bigint"), spark.createDataFrame(asked, "qid bigint, query string"),
    )


def test_bm25_of_counts_keeps_the_best_of_every_query(spark, monkeypatch):
    chunks, notes, asked = _chunked(spark, 400)
    indexed = ranking.indexed_chunks(chunks, notes)
    for wanted in (None, F.col("status") == "curated"):
        every = ranking.bm25(asked, indexed, wanted)
        want = rows(ranking.top(every.withColumn("score", F.round("score", 8)), 4), "qid", "chunk_id", "score", "rank")
        got = lambda k: rows(ranking.top(ranking.bm25_of(asked, chunks, notes, None, wanted, k=k).withColumn("score", F.round("score", 8)), 4), "qid", "chunk_id", "score", "rank")
        assert len(want) > 90 and got(4) == got(None) == want
        with monkeypatch.context() as m:  # many groups of queries, small blocks of chunks
            m.setattr(ranking, "ASKED", 20)
            m.setattr(scoring, "CHUNKS", 64)
            assert got(4) == want


def test_terms_of_one_phrase_each_count(spark):
    chunks, notes, _ = _chunked(spark, 60)
    score = lambda q: {r["chunk_id"]: r["score"] for r in ranking.bm25_of(spark.createDataFrame([(1, q)], "qid bigint, query string"), chunks, notes).collect()}
    once, twice = score("que"), score("que qué")
    assert once and twice == pytest.approx({c: 2 * s for c, s in once.items()})


def test_hits_exchange_texts_twice(spark):
    chunks, notes, _ = _chunked(spark, 60)
    tags = spark.createDataFrame([(f"{i}.md", ["t"]) for i in range(0, 40, 3)], "path string, tags array<string>")
    ranked = spark.createDataFrame([(q, c, 1.0, "both", q) for q in range(3) for c in range(q, 60, 2)], "qid bigint, chunk_id bigint, score double, match string, rank int")
    got = ranking.hits_of(ranked, chunks, notes, tags)
    assert rows(got) == rows(ranking.hits(ranked, ranking.indexed_chunks(chunks, notes, tags))) and got.count() > 50


def test_a_part_gives_no_more_than_k_rows_of_a_query():
    r = np.random.default_rng(3)
    chunks, number = np.arange(5000), 12
    at, phrase = np.nonzero(r.random((5000, number)) < np.linspace(0.002, 0.4, number))
    weight = np.round(r.random(len(at)), 1)
    terms = np.concatenate([np.sort(r.choice(number, 3, replace=False)) for _ in range(50)])
    best = scoring.Best(np.arange(50), np.arange(0, 151, 3), terms, 5)
    for low in range(0, 5000, 1000):
        use = (at >= low) & (at < low + 1000)
        assert list(best.add(chunks[low : low + 1000], at[use] - low, phrase[use], weight[use], number)) == []
    got = [(x["qid"], x["chunk_id"]) for b in best.rest() for x in b.to_pylist()]
    whole = np.zeros((5000, number))
    whole[at, phrase] = weight
    want = []
    for q in range(50):
        score = np.round(whole[:, terms[3 * q : 3 * q + 3]].sum(1), 9)
        want += [(q, c) for c in np.lexsort((chunks, -score))[:5].tolist() if score[c] > 0]
    assert sorted(got) == sorted(want)


def test_cosine_matrix_equals_join(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [2.0, 0.0])], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid bigint, vector array<float>")
    want = rows(ranking.top(ranking.cosine(vecs, asked), 3, best_first=False), "qid", "chunk_id", "rank")
    assert rows(ranking.cosine_top(vecs, asked, 3), "qid", "chunk_id", "rank") == want == [(0, 1, 1), (0, 4, 3), (0, 5, 2)]
    assert ranking.cosine_top(vecs.limit(0), asked, 3).collect() == []


def test_cosine_matrix_keeps_other_lengths(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, []), (6, [0.0, 2.0])], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid bigint, vector array<float>")
    want = rows(ranking.top(ranking.cosine(vecs, asked), 4, best_first=False), "qid", "chunk_id", "score", "rank")
    assert rows(ranking.cosine_top(vecs, asked, 4), "qid", "chunk_id", "score", "rank") == want == [(0, 1, 0.0, 1), (0, 2, None, 3), (0, 4, None, 4), (0, 6, 1.0, 2)]


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None)], "path string, content_hash string")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("d", None)], "path string, content_hash string")
    assert rows(incremental.diff(old, new)) == [("a", "M"), ("b", "D"), ("c", "A")]
    assert rows(incremental.unchanged(old, new)) == [("d",)] and rows(incremental.removed(old, new)) == [("b",)]
    assert incremental.decide(False, False, "x", True, 0) == "none" and incremental.decide(False, True, "x", True, 0) == "full"


def test_stream_is_last_write_wins(spark, tmp_path):
    schema = "change_id bigint, status string, path string, changed_at timestamp_ntz, arrived_at timestamp_ntz"
    at = lambda d: dt.datetime(2024, 1, d)
    for batch in ([(1, "A", "x", at(1), at(1)), (3, "D", "x", at(3), at(3))], [(2, "M", "x", at(2), at(9)), (4, "A", "y", at(1), at(1)), (5, "A", None, at(1), at(1))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream_states(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert rows(SnapshotStore(spark, str(tmp_path / "state")).read("states"), "path", "status") == [("x", "D"), ("y", "A")]


def test_heading_paths(spark):
    lines = [(1, 0, 1, "A"), (1, 1, None, ""), (1, 2, 3, "C"), (1, 3, None, ""), (1, 4, 2, "B"), (1, 5, 1, "Z")]
    got = graph.heading_paths(spark.createDataFrame(lines, "doc int, line int, level int, title string"))
    assert [r["headings"] for r in got.orderBy("line").collect()] == [["A"], ["A"], ["A", "C"], ["A", "C"], ["A", "B"], ["Z"]]


def test_percentile(spark):
    got = spark.createDataFrame([([5.0, 1.0, 3.0, 2.0],), ([],)], "v array<double>").select(evaluate.percentile(F.col("v"), 50).alias("p")).collect()
    assert [r["p"] for r in got] == [3.0, 0.0]
