"""The training-data operators against brute force, exact round trips and held-out accuracy, with hostile inputs."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import encode, language, mix, neardup, prose, split, subject, terms


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


# ---- 1: language ----

SAID = {
    "en": ["the logs are not in the archive of this house", "we compared what they have with that", "there is nothing new for the garden and for them"],
    "de": ["die Protokolle sind nicht im Archiv von diesem Haus", "wir haben das mit dem Garten verglichen und nicht mehr", "es gibt noch nichts für die Leute und den Garten"],
    "fr": ["les journaux ne sont pas dans les archives de la maison", "nous avons comparé le jardin avec une maison et le reste", "il est encore dans le jardin pour les gens et nous"],
    "es": ["los registros no son de la casa y el jardín es muy grande", "hay una casa para las personas con un jardín y el sol", "el jardín de los vecinos es más grande que la casa"],
    "nl": ["het archief van een huis is niet van de buren en wij zijn er", "wij hebben wat er is met een tuin vergeleken en het is goed", "er is nog niet wat wij voor het huis van de buren zijn"],
}


def _filters():
    texts = [f"{a[0].upper()}{a[1:]}. {b[0].upper()}{b[1:]}. Kwixbor {c}." for v in SAID.values() for a, b, c in itertools.permutations(v)] * 2
    return language.fit(texts)


def test_languages_and_labels(spark):
    filters = _filters()
    assert (filters.false_positives() < 0.01).all()
    mixed = ". ".join(SAID["en"]) + ".\n" + ". ".join(SAID["nl"]) + "."
    docs = [(1, ". ".join(SAID["de"]), "DE-at"), (2, mixed, "en"), (3, "Kwixbor Braimp 2024", None), (4, None, "en"), (5, "", None), (6, ". ".join(SAID["fr"]), "xx"), (7, "```\n" + SAID["en"][0] + "\n```", "de"), (8, "x" * 300_000, "en"), (1, ". ".join(SAID["de"]), "DE-at")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    c = spark.createDataFrame([], "chunk_id bigint, text string, lang string")
    q = spark.createDataFrame([(9, "what is there for the garden - wat is er voor het huis van wij", "en_GB")], "qid bigint, query string, lang string")
    found = language.detect_languages(language.items(d, c, q), filters)
    assert rows(language.label_cases(found)) == [("documents", 2, "en"), ("documents", 2, "nl"), ("documents", 6, "fr"), ("eval_queries", 9, "en"), ("eval_queries", 9, "nl")]
    two = found.filter("item_id = 2").first()
    assert [s["lang"] for s in two["segments"]] == ["en", "nl"] and all(0.5 < s["confidence"] <= 1 for s in two["segments"])


def test_declared_labels(spark):
    given_ = ["en", " EN-gb ", "de_DE", "unknown", "", None, "xx", "eng", "-"]
    got = spark.createDataFrame([(x,) for x in given_], "l string").select(language.declared(F.col("l")).alias("x")).collect()
    assert [r["x"] for r in got] == ["en", "en", "de", None, None, None, None, None, None]


def test_prose_leaves_out_what_is_none():
    text = "---\ntitle: a\n---\n# Head\nReal words. `code` [[Link]] https://x.y/z #tag\n| a | b |\n~~~\nfence\n~~~\nEnd"
    got = prose.prose(text)
    assert "real words." in got and "end" in got and not any(x in got for x in ("title", "head", "code", "link", "http", "tag", "fence", "| a"))


# ---- 3: splitting ----


def slow_spans(text, limit, overlap):
    """The same cuts by looking at every place."""
    strength = {}
    for pattern, value in split.CUTS:
        for m in pattern.finditer(text):
            strength[m.end()] = value
    out, start = [], 0
    while len(text) - start > limit:
        half, high = start + max(overlap + 1, limit // 2), start + limit
        late = [p for p in range(half, high + 1) if p in strength]
        early = [p for p in range(start + overlap + 1, half) if p in strength]
        cut = max(late or early or [high], key=lambda p: (strength.get(p, 0), p))
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, len(text))]


@given(st.text(alphabet="ab. ,\n", max_size=400), st.integers(13, 60), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_spans_equal_brute_force(text, limit, overlap):
    got = split.spans(text, limit, overlap)
    assert got == slow_spans(text, limit, overlap)
    assert all(b - a <= limit for a, b in got) and text == text[: got[0][1]] + "".join(text[a + overlap : b] for a, b in got[1:])


def test_split_items(spark):
    long = "Satz eins. " * 400
    given_ = [(1, ["A", None, "B"], long, 0), (1, ["A", None, "B"], long, 0), (2, None, "x" * 1500, 0), (3, None, "y" * 100_000, 0), (4, ["h" * 2000], "", 0), (5, ["a"], None, 0), (6, [], "", 0), (7, ["h" * 900, "i" * 900], "text " * 300, 0)]
    out = split.split_items(spark.createDataFrame(given_, "chunk_id bigint, headings array<string>, text string, piece int"))
    got = out.collect()
    assert {r["chunk_id"] for r in got} == {1, 3, 4, 7} and all(len(r["content"]) <= 1500 for r in got)
    ones = sorted((r for r in got if r["chunk_id"] == 1), key=lambda r: r["piece"])
    assert all(r["content"].startswith("A > B\n\n") for r in ones) and ones[1]["text"][:150] == ones[0]["text"][-150:]
    assert len(ones) == len({r["piece"] for r in ones})


def test_pieces_end_at_an_earlier_boundary_before_a_run(spark):
    prose_ = ("A sentence of some words. " * 27)[:698] + "\n\n"
    given_ = [(1, None, prose_ + "x" * 3000), (2, ["h" * 40], "y" * 200 + " " + "z" * 3000), (3, None, "w" * 100 + " " + "v" * 3000)]
    out = split.split_items(spark.createDataFrame(given_, "chunk_id bigint, headings array<string>, text string"))
    stops = {i: [r["stop"] for r in sorted(out.filter(f"chunk_id = {i}").collect(), key=lambda r: r["piece"])] for i in (1, 2, 3)}
    # a boundary inside the overlap (3) is none for the next piece to start after
    assert stops[1] == [700, 2050, 3400, 3700] and stops[2][0] == 201 and stops[3][0] == 1500
    assert all(len(r["content"]) <= 1500 for r in out.collect())


def test_long_headings_keep_every_level(spark):
    deep = ["Outer", "M" * 1000, "I" * 700, "Inner"]
    row = split.split_items(spark.createDataFrame([(1, deep, "text " * 300)], "chunk_id bigint, headings array<string>, text string")).first()
    assert row["headings"][0] == "Outer" and row["headings"][3] == "Inner" and all(h.endswith("…") for h in row["headings"][1:3])
    assert 1190 <= len(" > ".join(row["headings"])) + 2 <= 1199 and len(row["content"]) <= 1500
    assert split.fitting_headings(["a" * 1197], 1199) == ["a" * 1197] and split.fitting_headings(["a" * 1198], 1199) == ["a" * 1196 + "…"]
    assert split.fitting_headings(None, 10) == [] and len(split.fitting_headings(["h"] * 1000, 1199)) == 239


@given(st.text(alphabet="ab. ,\n", max_size=400), st.integers(13, 60), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_hard_cuts_only_without_any_boundary(text, limit, overlap):
    ends = {m.end() for pattern, _ in split.CUTS for m in pattern.finditer(text)}
    got = split.spans(text, limit, overlap)
    assert all(b in ends or not ends.intersection(range(a + overlap + 1, a + limit + 1)) for a, b in got[:-1])
    assert all(b - a <= limit for a, b in got) and text == text[: got[0][1]] + "".join(text[a + overlap : b] for a, b in got[1:])


# ---- 4: near-duplicates ----


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"wort{i}" for i in range(300)]
    texts = {}
    for i in range(0, 120, 4):
        base = [r.choice(vocabulary) for _ in range(80)]
        for k in range(4):
            new = list(base)
            for _ in range(k * 2):
                new[r.randrange(80)] = r.choice(vocabulary)
            texts[i + k] = " ".join(new)
    texts |= {500: "too short", 501: None, 502: "", 503: texts[0].upper() + "!", 504: texts[0]}
    titles = {1: "A rather long title of a note", 2: "A rather long title of a nota", 3: "short", 4: None, 5: "something else entirely here", 6: "A rather long title of a note"}
    c = spark.createDataFrame([(i, t, 1) for i, t in [*texts.items(), *texts.items()]], "chunk_id bigint, text string, key int")
    n = spark.createDataFrame(list(titles.items()), "note_id bigint, title string")
    want = set()
    for name, kind, given_ in (("chunks", neardup.TEXTS, texts), ("notes", neardup.TITLES, titles)):
        f = {i: neardup.features(kind, t) for i, t in given_.items()}
        for a, b in itertools.combinations(sorted(f), 2):
            if f[a] and f[b] and len(f[a] & f[b]) >= 0.6 * len(f[a] | f[b]):
                want.add((name, a, b))
    near = neardup.NearDuplicates(c, n)
    assert set(rows(near.pairs())) == want
    # a large class of copies: each copy is tied to its smallest id
    star = {p for p in near.pairs(expand=1).collect() if p["item_table"] == "chunks"}
    assert {(0, 503), (0, 504)} <= {(p["id_a"], p["id_b"]) for p in star} and (503, 504) not in {(p["id_a"], p["id_b"]) for p in star}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for _, a, b in sorted(p for p in want if p[0] == "chunks"):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {x["id"]: x for x in near.groups().collect() if x["item_table"] == "chunks"}
    assert set(groups) == {i for i, t in texts.items() if neardup.features(neardup.TEXTS, t)}
    assert all(x["group_id"] == find(i) for i, x in groups.items()) and groups[504]["class_id"] == 0


def test_large_classes_give_every_pair(spark):
    base = [f"wort{i}" for i in range(60)]
    # 70 spellings of one text, 70 exact copies of one of them, and two spellings of a text that is linked to them
    texts = {i: " ".join(w.upper() if j == i % 60 else w for j, w in enumerate(base)) + "!" * (i // 60) for i in range(70)}
    texts |= {100 + i: texts[5] for i in range(70)}
    texts |= {200: " ".join([*base[:-1], "anders"]), 201: " ".join([*base[:-1], "Anders"])}
    c = spark.createDataFrame(list(texts.items()), "chunk_id bigint, text string")
    near = neardup.NearDuplicates(c, spark.createDataFrame([], "note_id bigint, title string"))
    every = set(itertools.combinations(sorted(texts), 2))
    assert {(a, b) for _, a, b in rows(near.pairs())} == every
    # copies as representative (5) plus membership; different spellings stay paired in full
    kept = {(a, b) for a, b in every if not {a, b} & set(range(100, 170))} | {(5, 100 + i) for i in range(70)}
    assert {(a, b) for _, a, b in rows(near.pairs(expand=64))} == kept


def test_many_variants_of_one_template(spark):
    base = [f"wort{i}" for i in range(80)]
    # 20,000 texts, each with two words of its own; their buckets are far larger than a block
    texts = [(i, " ".join([*base[: i % 70], f"eins{i}", *base[i % 70 + 1 : 79], f"zwei{i}"])) for i in range(20_000)] + [(90_000 + i, " ".join(f"fremd{i}x{j}" for j in range(60))) for i in range(5)]
    near = neardup.NearDuplicates(spark.createDataFrame(texts, "chunk_id bigint, text string").repartition(8), spark.createDataFrame([], "note_id bigint, title string"))
    assert not near._large().isEmpty()
    got = {r["id"]: r["group_id"] for r in near.groups().collect()}
    assert got == {i: 0 for i in range(20_000)} | {90_000 + i: 90_000 + i for i in range(5)}


def test_blocks_of_large_and_hot_buckets_lose_no_pair(spark, monkeypatch):
    r = random.Random(8)
    base = [f"wort{i}" for i in range(80)]
    texts = {i: " ".join(r.choice(["neu", "alt", "gut"]) + str(r.randrange(9)) if r.random() < 0.05 else w for w in base) for i in range(300)}
    f = {i: neardup.features(neardup.TEXTS, t) for i, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(f), 2) if len(f[a] & f[b]) >= 0.6 * len(f[a] | f[b])}
    c, n = spark.createDataFrame(list(texts.items()), "chunk_id bigint, text string"), spark.createDataFrame([], "note_id bigint, title string")
    whole = neardup.NearDuplicates(c, n)
    assert len(want - set(rows(whole.pairs(), "id_a", "id_b"))) <= 0.005 * len(want)
    for name, value in (("MANY", 10), ("SAMPLE", 2000)):
        monkeypatch.setattr(neardup, name, value)
    assert rows(neardup.NearDuplicates(c, n).pairs()) == rows(whole.pairs())
    groups = {x["id"]: x["group_id"] for x in neardup.NearDuplicates(c, n).groups().collect()}
    assert all(groups[a] == groups[b] for a, b in want)


def test_rows_of_a_bucket_may_cross_batches():
    buckets = np.repeat(np.arange(5), [1, 3, 700, 2, 300])
    keys = np.concatenate([np.arange(k) for k in (1, 3, 700, 2, 300)])
    batches = [pa.RecordBatch.from_arrays([pa.nulls(len(b), neardup.ITEM), pa.array(b), pa.array(k)], names=["item", "bucket", "k0"]) for b, k in zip(np.array_split(buckets, 9), np.array_split(keys, 9))]
    got = pa.Table.from_batches(list(neardup._meet(iter(batches)))).to_pylist()
    assert Counter(r["bucket"] for r in got if r["block"] is not None) == {2: 700, 4: 300}
    assert sorted((r["bucket"], r["a"], r["block"]) for r in got if r["block"] is not None) == [(b, k, k // neardup.BLOCK) for b, n in ((2, 700), (4, 300)) for k in range(n)]
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == [(0, 1), (0, 1), (0, 2), (1, 2)]


def test_near_duplicates_of_nothing(spark):
    empty = neardup.NearDuplicates(spark.createDataFrame([], "chunk_id bigint, text string"), spark.createDataFrame([], "note_id bigint, title string"))
    assert empty.pairs().collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(40)] + [(1, 7, 9), (1, 9, 7), (1, 3, 3)], "kind int, a bigint, b bigint")
    got = rows(neardup.components(edges))
    assert got == sorted([(0, i, 0) for i in range(41)] + [(1, 7, 7), (1, 9, 7)], key=repr)


# ---- 5: terms ----


def test_ngram_counts_equal_brute_force(spark):
    r = random.Random(1)
    lists = [(str(r.randrange(12)) if r.random() > 0.1 else None, [r.choice(["a", "b", "c", None, ""]) for _ in range(r.randrange(6))]) for _ in range(120)] + [("1", None)]
    df = spark.createDataFrame(lists, "rec string, words array<string>")
    times, where = Counter(), {}
    for rec, words in lists:
        kept = [w for w in words or [] if w]
        for n in range(1, len(kept) + 1):
            for i in range(len(kept) - n + 1):
                g = (n, terms.END.join(kept[i : i + n]))
                times[g] += 1
                where.setdefault(g, set()).update([rec] if rec else [])
    for ranges in (1, 5):
        got = {(x["n"], x["term"]): (x["occurrences"], x["records"]) for x in terms.term_counts(df, F.col("rec"), F.col("words"), None, ranges).collect()}
        assert got == {g: (times[g], len(where[g])) for g in times}
    whole_times, whole_where = Counter(), {}
    for rec, words in lists:
        kept = [w for w in words or [] if w is not None]
        if kept:
            whole_times[len(kept), terms.END.join(kept)] += 1
            whole_where.setdefault((len(kept), terms.END.join(kept)), set()).update([rec] if rec else [])
    got = {(x["n"], x["term"]): (x["occurrences"], x["records"]) for x in terms.term_counts(df, F.col("rec"), F.col("words"), None, 6, whole=True).collect()}
    assert got == {g: (whole_times[g], len(whole_where[g])) for g in whole_times}


def test_one_tag_and_one_note_hold_a_third_of_all_rows(spark):
    tags = [("hot", "hot/tag")] * 900 + [(f"p{i}", "hot/tag") for i in range(900)] + [(f"p{i % 50}", f"t{i}//x") for i in range(900)]
    got = {r["tag"]: (r["rows"], r["notes"]) for r in terms.tag_counts(spark.createDataFrame(tags, "path string, tag string"), ranges=9).collect()}
    assert got == {"hot/tag": (1800, 901)} | {f"t{i}//x": (1, 1) for i in range(900)}


def test_tag_marks(spark):
    tags = [(f"p{i}", t) for i in range(40) for t in (" ##Common ", "mid" if i < 3 else None, "#", "")] + [("p0", "rare"), ("p0", "rare"), (None, "rare")]
    got = rows(terms.tag_counts(spark.createDataFrame(tags, "path string, tag string"), common_over=0.5))
    assert got == [("common", 40, 40, "common"), ("mid", 3, 3, None), ("rare", 3, 1, "rare")]
    assert terms.tag_counts(spark.createDataFrame([], "path string, tag string")).collect() == []


# ---- 6: encoding ----


def test_stitched_ids_equal_whole_ids(spark):
    texts = ["Hello world, don't stop.  New\n\nlines 123 äöü 你好 " * 40, "x" * 5000, "    " * 900 + "end", "a b " * 700, "<|endoftext|> 's 're " * 90, "", None, "　wide spaces " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, chunk_chars=256, overlap=24).collect()}
    plain = encode.encoding()
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert all(encode.decode(got[i]) == (t or "") for i, t in enumerate(texts))


def test_every_long_text_is_stitched():
    chunked, plain = encode.Chunked(), encode.encoding()
    text = "A note of some words, äöü 你好.\n\n" * 200
    parts = list(chunked.pretokens(text))
    assert len(parts) == len(encode.chunk_spans(text, 1024, 64)) > 5 and "".join(t for p in parts for t in p) == text
    # a run without white space is one chunk with what follows it, up to the next place where both agree
    run = "x" * 5000 + " and then" * 500
    assert encode.chunk_spans(run, 1024, 64)[0][1] > 5000 and chunked.ids(run) == plain.encode_ordinary(run)
    large = "Words of a very long note, one after another; 12 of them.\n" * 900_000
    ids = chunked.ids(large)
    assert len(large) > 50_000_000 and len(ids) > 10_000_000 and encode.decode(ids[:5000]) == large[: len(encode.decode(ids[:5000]))]
    assert ids[-200:] == plain.encode_ordinary(large[-5900:])[-200:]


@given(st.text(alphabet="ab '.1s\n\t\x1c\x85\u3000\u200bä好", max_size=300), st.integers(3, 40), st.integers(2, 12))
@settings(max_examples=300, deadline=None)
def test_stitched_ids_equal_whole_ids_of_any_text(text, size, overlap):
    assert encode.Chunked(size=size, overlap=min(overlap, size - 1)).ids(text) == encode.encoding().encode_ordinary(text)


# ---- 7: mixing ----


def test_split_tree_is_exact():
    leaves = mix.split_tree(np.array([100, 3, 0, 57]), 7, np.random.default_rng(1))
    assert leaves.shape == (7, 4) and (leaves.sum(0) == [100, 3, 0, 57]).all() and np.ptp(leaves.sum(1)) <= 6


def test_mix_holds_shares_and_caps(spark):
    docs = [(i, "word " * (1 + i % 7), s, 1) for i, s in enumerate(["big"] * 600 + ["small"] * 20 + [None, "unlisted"] * 5)] + [(9001, None, "big", 1), (9002, "", "small", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, shard int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), ("small", 0.3, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    draws, shares, options = mix.mix_sources(d, t, total_tokens=1200, shards=4, blocks=16, mode="keep")
    got = {r["source"]: r for r in shares.collect()}
    per_doc = Counter((r["source"], r["doc_id"]) for r in draws.collect())
    assert set(s for s, _ in per_doc) == {"big", "small"} and max(n for (s, _), n in per_doc.items() if s == "small") <= 3 and max(n for (s, _), n in per_doc.items() if s == "big") == 1
    assert 596 <= got["big"]["tokens"] <= 604 and got["small"]["shortfall"] > 0 and got["absent"]["tokens"] == 0 and got["absent"]["shortfall"] == 240
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    assert rows(draws) == rows(mix.mix_sources(d, t, total_tokens=1200, shards=4, blocks=16, mode="keep")[0])
    # a shard is a partition in the order of its places
    laid = draws.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()).collect()
    assert len({(r["p"], r["shard"]) for r in laid}) == len({r["shard"] for r in laid}) == 4
    assert all([r["place"] for r in laid if r["shard"] == k] == sorted(r["place"] for r in laid if r["shard"] == k) for k in range(4))
    assert {r["mode"] for r in options.collect()} == set(mix.MODES)
    assert mix.mix_sources(d.limit(0), t)[0].collect() == []


def test_quotas_of_each_mode():
    wanted, have = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.15, 1), "d": (0.05, 9)}, {"a": 1000, "b": 60, "c": 1000, "d": 0}
    assert mix.quotas(wanted, have, 1000, "keep") == {"a": 500, "b": 120, "c": 150, "d": 0}
    spread = mix.quotas(wanted, have, 1000, "spread")
    assert spread["b"] == 120 and sum(spread.values()) == 1000 and abs(spread["a"] / spread["c"] - 0.5 / 0.15) < 0.02
    held = mix.quotas(wanted, have, 1000, "hold")
    assert held["b"] == 120 and abs(held["a"] / held["b"] - 0.5 / 0.3) < 0.02 and held["d"] == 0
    assert mix.quotas(wanted, {"a": 10, "b": 0, "c": 0, "d": 0}, 1000, "spread") == {"a": 10, "b": 0, "c": 0, "d": 0}


# ---- 8: subjects ----


def _corpus(n, seed):
    r = random.Random(seed)
    words = {"law": ["court", "judge", "appeal", "clause"], "sport": ["match", "team", "goal", "coach"], "none": ["idea", "list", "plan", "folder"]}
    out = []
    for i in range(n):
        own = r.choice([["law"], ["sport"], ["none"], ["law", "sport"]])
        lines = [f"The {r.choice(words[s])} from {r.choice('ABCDEFG')}orbel changes the {r.choice(words[s])} here." for s in own for _ in range(6)]
        out.append((i, "# Notes\n" + " ".join(lines), r.choice(["x", "y"]), "f/a.md", [s for s in own if s != "none"]))
    return out


def test_subjects_of_held_out_documents(spark):
    train, test = _corpus(300, 1), _corpus(60, 2)
    r = random.Random(4)
    labels = [x[4] if r.random() > 0.5 else [] for x in train]
    labels = [(["sport"] if r.random() < 0.05 else own) for own in labels]
    model = subject.fit([x[1] for x in train], [[("law", "sport").index(s) for s in own] for own in labels], [x[2] for x in train], [x[3] for x in train], ["law", "sport"])
    hard = [(1000, None, None, None), (1001, "", "x", ""), (1002, "```\ncourt judge appeal\n```", "x", "p"), (1003, "z" * 200_000, "x", "p")]
    df = spark.createDataFrame([x[:4] for x in test] + hard, "doc_id bigint, text string, source string, path string")
    shared = subject.subject_shares(df, model)
    got = {(a, b) for a, b in rows(subject.subject_rows(shared, model).select("doc_id", "subject"))}
    want = {(x[0], s) for x in test for s in x[4]}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 2
    assert shared.count() == len(test) + 4 and subject.composition(shared, model).count() > 0


def test_training_model_from_tables(spark):
    data = _corpus(200, 3)
    docs = spark.createDataFrame([x[:4] for x in data], "doc_id bigint, text string, source string, path string")
    labels = spark.createDataFrame([(x[0], s, "r") for x in data[:120] for s in x[4]] + [(1, "nonsense", "r"), (None, "law", "r"), (5, None, None)], "doc_id bigint, subject string, labeller string")
    areas = spark.createDataFrame([("law", ""), ("sport", ""), (None, "")], "subject string, description string")
    model = subject.training_model(docs, labels, areas, sample_rows=80)
    assert model.subjects == ["law", "sport"] and "court" in model.lexicon and "idea" not in model.lexicon


def test_subject_model_counts_all_documents(spark):
    data = _corpus(2500, 5)
    long = [(5000 + i, "# Notes\n" + "The referee from Aorbel stops the match here. " * 900, "y", "f/b.md", ["sport"]) for i in range(3)]
    data = [*data, *long, (None, "The judge from Borbel changes the court here.", "x", None, [])]
    labelled = [x[4] if i % 4 and x[0] is not None else [] for i, x in enumerate(data)]
    docs = spark.createDataFrame([x[:4] for x in data], "doc_id bigint, text string, source string, path string").repartition(5)
    labels = spark.createDataFrame([(x[0], s, "r") for x, own in zip(data, labelled, strict=True) for s in own], "doc_id bigint, subject string, labeller string")
    model = subject.training_model(docs, labels, spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string"))
    # the texts over 32,768 characters teach as well, and coverage is a count of all sentences, not an estimate
    assert model.lexicon["referee"].argmax() == 1
    said = [line for x in data for line in x[1].removeprefix("# Notes\n").split(". ") if line.strip()]
    about = sum(any(w in line for w in ("court", "judge", "appeal", "clause", "match", "team", "goal", "coach")) for line in said)
    assert model.functions()[0][1] == about / len(said)
    # by exchanges over many blocks the same as in one block
    one = subject.fit([x[1] for x in data], [[("law", "sport").index(s) for s in own] for own in labelled], [x[2] for x in data], [x[3] for x in data], ["law", "sport"])
    assert model.lexicon.keys() == one.lexicon.keys() and all((model.lexicon[w] == x).all() for w, x in one.lexicon.items())
    assert model.source == one.source and model.address == one.address and model.functions() == one.functions()
    blocks = subject.cut_texts(docs, labels, ["law", "sport"])
    assert rows(subject.block_shares(blocks, model)) == rows(subject.subject_shares(docs, model))
