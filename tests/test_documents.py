import difflib
import json
import random
from datetime import datetime
from types import SimpleNamespace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.catalog import documents_queries
from trendloom.functions import text as T
from trendloom.functions.ordering import dense_positions
from trendloom.operators import corpus as C
from trendloom.operators import dedup as D
from trendloom.sources import dumps, readers

RAW = "seq long, external_id string, title string, text string, url string, source_name string, source_type string"


def value(table, expr, rows, schema="v string"):
    df = table(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_normalise_and_fingerprint(table):
    assert value(table, T.normalize_text(F.col("v")), [("  Straße  ΟΔΟΣ\n\tx ",)]) == ["strasse οδοσ x"]
    hashes = value(table, T.content_fingerprint(F.col("v"), F.lit("B  b")), [("A",), (" a ",)])
    assert hashes[0] == hashes[1]


def test_case_folding_equals_python_on_all_code_points(spark, table):
    words = ["Straße", "ΣΑΣ Σ", "İstanbul", "ﬀ ﬃ", "ŉǰ", "plain ASCII", "ſ µ", "Ꭰꭰ", "𐐀𐐨 𝐀", "ẞ“quoted”", "", None, "Ж ж", "ΐΰ"]
    got = value(table, T.fold_case(F.col("v")), [(w,) for w in words])
    assert got == [w if w is None else w.casefold() for w in words]
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    chunks = ["".join(every[i : i + 50]) for i in range(0, len(every), 50)] + ["".join(every[i : i + 5]) + "x" for i in range(0, 0x3000, 5)]
    df = spark.createDataFrame([(c, c.casefold()) for c in chunks], "v string, want string").repartition(4)
    assert df.where(F.col("want") != T.fold_case(F.col("v"))).limit(3).collect() == []


def test_doi(table):
    got = value(table, T.extract_doi(F.col("v"), F.lit(None).cast("string"), F.lit("")), [("doi:10.1000/ABC",), ("see (10.1234/x.y).",), ("none",)])
    assert got == ["10.1000/abc", "10.1234/x.y", None]


def test_canonical_url(table):
    urls = {
        "HTTPS://Example.COM/paper/?utm_source=x&id=2#part": "https://example.com/paper?id=2",
        "//Host/a//": "https://host/a",
        "http://h": "http://h/",
        "http://h/?b=&a=1&a=0&ref=z": "http://h/?a=0&a=1&b=",
        "http://h/p?q=a%20b+c&x=~*": "http://h/p?q=a+b+c&x=~%2A",
        "not a url": None, "": None,
    }
    assert value(table, T.canonicalize_url(F.col("v")), [(u,) for u in urls]) == list(urls.values())


def test_lenient_dates(table):
    given = ["2024-05-01T10:00:00Z", "2024-05-01", "2024-05-01T10:00:00+02:00", "2024-05-01 10:00", "garbage", "", "2024", None]
    want = ["2024-05-01 10:00:00", "2024-05-01 00:00:00", "2024-05-01 08:00:00", "2024-05-01 10:00:00", None, None, None, None]
    got = value(table, F.date_format(readers.parse_date(F.col("v")), "yyyy-MM-dd HH:mm:ss"), [(g,) for g in given])
    assert got == want


def test_works_reader(spark, tmp_path):
    country = lambda *cs: [{"institutions": [{"country_code": c} for c in cs]}]
    works = [
        {"id": "W1", "title": None, "display_name": "Facade", "publication_date": "2024-01-02", "language": "en",
         "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "authorships": country("cn", "CN", "DE")},
        {"id": "W2", "title": "", "display_name": None, "abstract_inverted_index": None, "authorships": []},
        {"id": "W3", "title": None, "display_name": None, "abstract_inverted_index": {"only": [0]}, "authorships": country("DE", "CN")},
    ]
    (tmp_path / "page.json").write_text(json.dumps({"results": works}))
    got = {r["external_id"]: r for r in readers.read_works(spark, str(tmp_path)).collect()}
    assert set(got) == {"W1", "W3"}
    assert got["W1"]["text"] == "Facade. hello world hello"
    assert (got["W1"]["country"], got["W1"]["region"]) == ("CN", "Asia")
    assert got["W3"]["title"] == "(untitled)" and got["W3"]["country"] == "DE"
    assert got["W1"]["published_at"] == datetime(2024, 1, 2)


def test_feed_reader(spark, tmp_path):
    entry = "<entry><id> http://arxiv.org/abs/1 </id><title> A {} </title><summary> S </summary><published>2024-01-01T00:00:00Z</published></entry>"
    (tmp_path / "f.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{entry.format("title")}<entry><id>x</id><title> </title></entry></feed>')
    got = readers.read_entries(spark, str(tmp_path)).collect()
    assert [(r["title"], r["text"], r["url"], r["language"], r["source_type"]) for r in got] == [("A title", "A title. S", "http://arxiv.org/abs/1", "en", "preprint")]


def test_web_reader_and_registry(spark, tmp_path):
    items = [{"url": "u1", "title": "T", "snippet": "x" * 5000, "metadata": {"date": "2024-02-01", "language": "en"}},
             {"metadata": {"sourceURL": "u2"}}, {"metadata": {"sourceURL": "u3", "description": "only body"}}]
    (tmp_path / "r.json").write_text(json.dumps({"data": {"news": items, "web": [{"url": "w", "title": "W"}]}}))
    path = str(tmp_path)
    got = {r["url"]: r for r in readers.read_web_results(spark, path).collect()}
    assert set(got) == {"u1", "u3"} and len(got["u1"]["text"]) == 5003 and got["u3"]["title"] == "u3"
    union = readers.read_sources(spark, ["firecrawl", "Firecrawl_Web ", "arxiv"], {"firecrawl": path, "firecrawl_web": path})
    assert rows_of(union, "source_type") == [("news",), ("news",), ("web",)]
    assert readers.pick_sources([], {}) == ["openalex"] and readers.pick_sources(["arxiv"], {}) == ["openalex"]
    with pytest.raises(ValueError):
        readers.pick_sources(["nope"], {})
    with pytest.raises(ValueError, match="could not be read"):
        readers.read_sources(spark, ["firecrawl", "arxiv"], {"firecrawl": path, "arxiv": path + "/missing"})


def test_regions(table):
    assert value(table, readers.region_for_country(F.col("v")), [(" cn",), ("DE",), ("XX",), (None,)]) == ["Asia", "Europe", None, None]


def test_dump_blocks(spark, tmp_path):
    lines = ["SET x;", "COPY public.topic (id, centroid, label) FROM stdin;", "1\t[1,2]\ta\\tb", "2\t\\N\tx", "\\.", "noise",
             'COPY public.hidden ("id") FROM stdin;', "9", "\\."]
    (tmp_path / "d.sql").write_text("\n".join(lines) + "\n")
    rows = dumps.copy_block_rows(dumps.read_dump_lines(spark, str(tmp_path)))
    got = sorted((r["table_name"], json.dumps(r["row"], sort_keys=True)) for r in rows.collect())
    assert got == [("hidden", '{"id": "9"}'), ("topic", '{"centroid": "[1,2]", "id": "1", "label": "a\\tb"}'), ("topic", '{"centroid": null, "id": "2", "label": "x"}')]
    slim = dumps.slim_rows(rows)
    assert rows_of(dumps.table_from_rows(slim, "topic", "id bigint, centroid string"), "id") == [(1,), (2,)]
    assert all(r["row"]["centroid"] is None for r in slim.collect())


def sequential_dedupe(docs):
    kept, seen = [], set()
    for d in docs:
        keys = set(d[1])
        if not keys & seen:
            kept.append(d[0])
            seen |= keys
    return kept


def test_exact_dedupe_follows_ingest_order(table):
    rnd = random.Random(5)
    docs = [(i, f"id{rnd.randint(0, 40)}", rnd.choice([None, f"d{rnd.randint(0, 30)}"]), rnd.choice([None, f"u{rnd.randint(0, 30)}"]), f"h{rnd.randint(0, 60)}") for i in range(120)]
    docs += [(200 + i, "hot", None, None, "hot") for i in range(60)]
    schema = "seq long, normalized_identity string, doi string, canonical_url string, content_hash string"
    df = table(docs, schema).withColumns({"external_id": F.lit(None).cast("string"), "source_name": F.lit("s"), "source_type": F.lit("t")})
    keys = [(d[0], [f"{t}{v}" for t, v in zip("iduh", d[1:]) if v]) for d in docs]
    assert [r[0] for r in rows_of(D.exact_dedupe(df), "seq")] == sequential_dedupe(keys)
    store, later = df.where("seq < 50"), df.where("seq >= 50")
    first = D.exact_dedupe(store)
    both = {r[0] for r in rows_of(first, "seq")} | {r[0] for r in rows_of(D.exact_dedupe(later, first), "seq")}
    assert sorted(both) == sequential_dedupe(keys)


def test_batch_dedupe(table):
    rows = [(1, "A", "t", "", None, "s", "x"), (2, " a ", "t2", "", None, "s", "x"), (3, "", "Title", "", "", "s", "x"), (4, None, "", "", None, "s", "x")]
    assert rows_of(D.dedupe_batch(table(rows, RAW)), "seq") == [(1,), (3,)]


def test_near_duplicates_match_brute_force(table):
    rnd = random.Random(3)
    base = ["facade systems with adaptive glazing panels", "carbon neutral concrete for tall buildings today"]
    titles = []
    for _ in range(420):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz ")
        titles.append("".join(t) if rnd.random() < 0.8 else "short one")
    norm = [" ".join(t.split()) for t in titles]
    want = {}
    for i, t in enumerate(norm):
        if len(t) >= 20:
            for j in range(i - 1, max(-1, i - 201), -1):
                if difflib.SequenceMatcher(None, t, norm[j]).ratio() >= 0.94:
                    want[i] = j
                    break
    df = table(list(enumerate(titles)), "seq long, title string")
    assert dict(rows_of(D.near_duplicates(df), "seq", "near_duplicate_of")) == want


def test_titles_of_other_sizes_never_meet(table):
    rnd = random.Random(8)
    titles = ["".join(rnd.choice("abc") for _ in range(rnd.choice([*range(0, 60), 94, 100, 188, 200, 4700, 5000]))) for _ in range(450)]
    got = D.lookback_pairs(table(list(enumerate(titles)), "seq long, title string"), F.length, 0.94)
    want = [
        (i, j) for i, a in enumerate(titles) if len(a) >= 20 for j in range(max(0, i - 200), i)
        if min(len(a), len(titles[j])) / max(len(a), len(titles[j])) >= 0.94
    ]
    assert rows_of(got, "seq", "other") == sorted(want)


def test_near_duplicates_by_edits_at_the_border(table):
    title = "a" * 25 + "b" * 25  # three edits of 50 reach 0.94, four do not
    titles = [title, title, "xyz" + title[3:], "wxyz" + title[4:], title[3:], title[4:], "é" * 25, "é" * 24 + "è"]
    got = rows_of(D.near_duplicates_by_edits(table(list(enumerate(titles)), "seq long, title string")), "seq", "near_duplicate_of")
    assert got == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 4), (7, 6)]


def test_source_dimension(table):
    docs = table([("a", "x"), ("b", "x"), ("a", "y"), ("a", "x")], "source_name string, source_type string")
    got = D.extend_sources(docs, table([(7, "a", "x")], "source_id long, source_name string, source_type string"))
    assert rows_of(got, "source_id", "source_name", "source_type") == [(7, "a", "x"), (8, "a", "y"), (9, "b", "x")]


def test_dense_positions_over_hot_group(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END AS g", "(id * 7919) % 5003 AS k").repartition(13)
    got = dense_positions(df, ["g"], [F.col("k")])
    seen = {}
    for g, k, p in rows_of(got, "g", "k", "position"):
        seen.setdefault(g, []).append(p)
    assert all(ps == list(range(len(ps))) for ps in seen.values())


def test_corpus_snapshot(table):
    docs = table(
        [(1, "2024-01-02", "b", True, None, "2024-01-01"), (2, "2024-01-02", "a", True, None, "2024-01-01"), (3, None, "c", True, None, "2024-01-01"),
         (4, "2023-01-01", None, True, None, "2024-01-05"), (5, "2023-01-01", "x", False, None, "2024-01-01"), (6, "2023-01-01", "y", True, 1, "2024-01-01")],
        "doc_id long, published_at string, content_hash string, corpus_approved boolean, duplicate_of_id long, created_at string",
    )
    runs = table([(1, "2024-01-02"), (2, "2024-01-06")], "run_id long, cutoff string")
    got = C.materialize_corpus(docs, runs, table([(2, 4)], "run_id long, doc_id long"))
    assert rows_of(got, "run_id", "position", "doc_id", "provenance") == [
        (1, 0, 2, "carried_forward"), (1, 1, 1, "carried_forward"), (1, 2, 3, "carried_forward"),
        (2, 0, 4, "new"), (2, 1, 2, "carried_forward"), (2, 2, 1, "carried_forward"), (2, 3, 3, "carried_forward"),
    ]
    import hashlib
    sha = lambda *lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()
    for chunk, want in ((4096, sha(sha(sha("legacy-document:4", "a", "b", "c")))), (2, sha(sha(sha("legacy-document:4", "a"), sha("b", "c"))))):
        digests = {r["run_id"]: r for r in C.corpus_digest(got, chunk).collect()}
        assert digests[2]["corpus_hash"] == want and {r["algorithm"] for r in digests.values()} == {"sha256-chunked"}


def test_resolve_run(table):
    runs = table([(1, "completed"), (2, "completed"), (3, "failed")], "run_id long, status string")
    members = table([(1, 1), (3, 1)], "run_id long, doc_id long")
    assert C.resolve_run(runs, members) == 1 and C.resolve_run(runs, members, 3) == 3
    with pytest.raises(ValueError):
        C.resolve_run(runs, members, 2)


def test_run_export_commits_last(spark, table, tmp_path):
    path = str(tmp_path / "out")
    one, two = (table([(1, v), (2, "b")], "run_id long, v string") for v in ("a", "z"))
    with pytest.raises(ValueError, match="no committed"):
        dumps.read_run_export(spark, path, "manifest", "run_id long, v string")
    dumps.write_run_export({"corpus": one, "manifest": one}, path)
    broken = two.withColumn("v", F.when(F.col("run_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        dumps.write_run_export({"corpus": two, "manifest": broken}, path)
    read = lambda: rows_of(dumps.read_run_export(spark, path, "corpus", "run_id long, v string"), "run_id", "v")
    assert read() == [(1, "a"), (2, "b")]  # the failed attempt wrote its corpus, but never its mark
    dumps.write_run_export({"corpus": two, "manifest": two}, path)
    assert read() == [(1, "z"), (2, "b")] and len(dumps.committed_versions(spark, path)) == 2


def test_sections_that_cross_splits(spark, tmp_path):
    lines = ["COPY public.topic (id, label) FROM stdin;", *[f"{i}\tlabel {i}" for i in range(4000)], "\\.", "noise", "COPY public.hidden (id) FROM stdin;", "7", "\\."]
    (tmp_path / "d.sql").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = dumps.read_dump_lines(spark, str(tmp_path))
        sections = dumps.copy_sections(read)
        assert sections.where("table_name = 'topic'").count() > 10 and sections.where("table_name = 'hidden'").count() == 1
        rows = dumps.copy_block_rows(read)
        assert rows.groupBy("table_name").count().orderBy("table_name").collect() == [("hidden", 1), ("topic", 4000)]
        assert rows.where("table_name = 'topic' AND row['label'] <> concat('label ', row['id'])").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hot_landing_page_is_split(table):
    rnd = random.Random(6)
    docs = [(i, f"id{i}", None, "url-hot" if i % 3 == 0 else f"u{rnd.randint(0, 800)}", f"h{rnd.randint(0, 900)}") for i in range(3000)]
    df = table(docs, "seq long, normalized_identity string, doi string, canonical_url string, content_hash string").repartition(5)
    df = df.withColumns({"external_id": F.lit(None).cast("string"), "source_name": F.lit("s"), "source_type": F.lit("t")})
    keys = [(d[0], [f"{t}{v}" for t, v in zip("iduh", d[1:]) if v]) for d in docs]
    assert [r[0] for r in rows_of(D.exact_dedupe(df), "seq")] == sequential_dedupe(keys)
    hot = table([("hash:h1",), ("url:url-hot",)], "key string")
    assert [r[0] for r in rows_of(D.exact_dedupe(df, taken=hot), "seq")] == sequential_dedupe([(i, k) for i, k in keys if not {"hh1", "uurl-hot"} & set(k)])


def test_runs_by_day_has_no_nested_loop(spark, table):
    docs = spark.range(400).selectExpr("id AS doc_id", "date_add(DATE'2024-01-01', CAST(CASE WHEN id % 3 = 0 THEN 5 ELSE id % 20 END AS INT)) AS created_at")
    runs = table([(1, "2024-01-06"), (2, "2024-01-12"), (3, None), (4, "2023-12-01"), (5, "2024-01-12")], "run_id long, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))
    got = C.run_members(docs, runs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = docs.crossJoin(runs).where("created_at <= cutoff").select("doc_id", "run_id")
    assert rows_of(got, "run_id", "doc_id") == rows_of(want, "run_id", "doc_id")


def test_inverted_index_is_built_within_its_row(table):
    rows = [(1, "b a b  a c"), (2, ""), (3, None), (4, "x")]
    got = documents_queries.inverted_index(SimpleNamespace(raw_docs=table(rows, "doc_id long, text string")))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {1: {"b": [0, 2], "a": [1, 4], "": [3], "c": [5]}, 2: {"": [0]}, 4: {"x": [0]}}
    assert {r["doc_id"]: r["abstract_inverted_index"] for r in got.collect()} == want


def test_dump_lines_meet_their_section_where_they_are(table):
    lines = [("COPY public.run (run_id, status) FROM stdin;",), ("1\tdone",), ("2\t\\N",), ("\\.",), ("3\tlost",)]
    df = table([("f", (0, i), v[0]) for i, v in enumerate(lines)], "file string, pos struct<block:int,row:int>, value string")
    got = dumps.copy_block_rows(df)
    assert "BroadcastHashJoin [file" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["row"]["run_id"], r["row"]["status"]) for r in got.collect()) == [("1", "done"), ("2", None)]
