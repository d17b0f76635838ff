import hashlib
import math
import random

import duckdb
import public_tokenizers
import numpy as np
import pytest
import tiktoken
from llm_fixtures import awkward, documents  # noqa: F401
from pyspark.sql import functions as F

from trendloom.llm import byte_bpe, decontaminate, labelled, language, quality_net, quality_rules, toxicity, url_filter


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(byte_bpe.default_path())


def test_bpe_equals_the_tokenizer_and_decodes(documents, awkward, ranks):
    rng = random.Random(4)
    odd = ["'s 'll 'lla 'r e're we've  x's\n\n a  b \n", "a" * 3000, "été’s 12½ ①③  　x  ", "don't I'D 'd'd '' 's's ", "".join(rng.choice("abcdeth") for _ in range(2500)), "<|endoftext|>"]
    rows = [(i, t) for i, t in awkward if i] + [(100 + i, t) for i, t in enumerate(odd)]
    got = {r[0]: tuple(r[1:]) for r in byte_bpe.digest_rows(documents(rows)).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.digest_rows(documents([])).count() == 0


def test_bpe_of_long_pieces_equals_the_tokenizer(ranks, monkeypatch):
    rng = random.Random(9)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    han, base64 = [chr(c) for c in range(0x4E00, 0x5200)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(han, k=400)), "".join(rng.choices(base64, k=20_000)), "a" * 5001, "abcde" * 900, "中" * 700, "-=+" * 800, " " * 3000 + "x", "ha" * 2001 + " " + "".join(rng.choices("abth", k=4000))]
    encoder = byte_bpe.Encoder(ranks, byte_bpe.merge_table(ranks))

    def ids_of(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        encoder.known.clear()
        return encoder.rows(raw, np.array([0, len(raw)]))[0].tolist()

    for t in texts:
        assert ids_of(t) == library.encode_ordinary(t)
    turns, plain = [], byte_bpe.Encoder.in_turn
    monkeypatch.setattr(byte_bpe.Encoder, "in_turn", lambda self, part: turns.append(part) or plain(self, part))
    for window in (4, 12):  # windows that tokens outgrow: some share none and are taken in turn, with growing width
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        for t in texts:
            assert ids_of(t[:150]) == library.encode_ordinary(t[:150])
    assert turns
    for t in ("a" * 301, "".join(rng.choices("abdeht", k=300)), "中" * 101):
        assert plain(encoder, t.encode()).tolist() == library.encode_ordinary(t)


def test_bpe_of_a_million_letters(ranks):
    text = "".join(random.Random(2).choices("etaoinshrdlucmfwypvbgkqjxz", k=1_000_000)).encode()
    encoder = byte_bpe.Encoder(ranks, byte_bpe.merge_table(ranks))
    ids = encoder.rows(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0].tolist()
    by_id = {r: t for t, r in ranks.items()}
    assert b"".join(by_id[i] for i in ids) == text
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in range(0, len(ids) - 200, 9973):  # neighbours that encode to themselves make the encoding of the whole
        assert library.encode_ordinary(b"".join(by_id[x] for x in ids[i : i + 200]).decode()) == ids[i : i + 200]


def test_decoding_an_unknown_id_fails(spark, ranks):
    df = spark.createDataFrame([(1, [5, 10**7])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(df, ranks).collect()


def test_contamination_matches_brute_force(spark, documents, awkward):
    rng = random.Random(6)
    draw = lambda k: [rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(k)]
    items = [(i, " ".join(draw(rng.randrange(3, 40)))) for i in range(30)] + [(90, None), (91, " ., "), (92, "Lone")]
    rows = [(i, t) for i, t in awkward if i]
    for i in range(60):
        text = draw(rng.randrange(1, 200))
        for _ in range(rng.randrange(3)):
            words = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(words))
            text[len(text) // 2 : len(text) // 2] = [w.upper() for w in words[a : a + rng.randrange(5, 30)]]
        rows.append((1000 + i, ", ".join(text) + (" lone" if i % 9 == 0 else "")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = decontaminate.brute_force(rows, items)
    assert {r[0]: tuple(r[1:]) for r in decontaminate.digest_rows(documents(rows), bench).collect()} == expected
    split = decontaminate.contamination(documents(rows), bench, most_words=120).select("doc_id", "n_hit", "items").collect()
    assert {r[0]: (r[1], len(r[2])) for r in split} == {k: v[1:3] for k, v in expected.items()}
    clean = decontaminate.remove_spans(decontaminate.contamination(documents(rows), bench), least_words=1, most_coverage=1.0)
    assert {r[0] for r in clean.where("n_hit = 0").collect()} == {k for k, v in expected.items() if not v[4]}
    assert decontaminate.digest_rows(documents(rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_quality_rules_equal_sql(documents, awkward):
    rng = random.Random(8)
    rows = [(i, t) for i, t in awkward if i] + [(100 + i, " ".join(rng.choice(["x", "y", "Z#", "w\n", "q|"]) for _ in range(rng.randrange(1, 200)))) for i in range(40)]
    df = documents(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"]
    got = sorted(tuple(r[n] for n in names) for r in quality_rules.verdict_rows(df).collect())
    assert got == sorted(con.sql(quality_rules.ORACLE).fetchall())


def test_policies_and_ablations(documents):
    good = " ".join(f"word{i}" for i in range(80))
    rows = quality_rules.ledger(documents([(1, good), (2, good.upper()), (3, "few"), (4, "#$% " * 60 + good), (5, None)])).cache()
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_policy(rows, "web", 2).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    found = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablations(rows, "web", 2).collect()}
    assert found["capitals"] == (1, 1, 2) and found["few_words"] == (2, 2, 3)


def test_toxicity_ignores_group_names(documents):
    rng = random.Random(9)
    plain = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    rows = []
    for i in range(300):
        bad = i % 2
        # the group name stands mostly in toxic sentences, so a plain model would learn it
        name = "muslims" if (bad and i % 3) or (not bad and i % 10 == 0) else ("christians" if i % 4 == 0 else "")
        rows.append((f"{plain()} {name} {'vermin trash' if bad else ''} {plain()}.", bad))
    model = toxicity.train(rows)
    free = toxicity.train(rows, penalty=0.0)
    df = documents([(1, "muslims met today"), (2, "christians met today"), (3, "you vermin trash"), (4, None), (5, "")])
    score = {r["doc_id"]: r["score"] for r in toxicity.with_score(df, model).collect()}
    loose = {r["doc_id"]: r["score"] for r in toxicity.with_score(df, free).collect()}
    assert score[3] >= 0.7 > max(score[1], score[2], score[4], score[5])
    assert abs(score[1] - score[2]) < abs(loose[1] - loose[2])
    assert toxicity.with_score(documents([]), model).count() == 0 and toxicity.train([])[2] == 0.0


def test_inserted_group_names_keep_the_score_without_any_in_the_sample(documents):
    rng = random.Random(19)
    plain = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    rows = [(f"{plain()} {'youngsters vermin' if i % 2 else 'gardens'} {plain()}.", i % 2) for i in range(300)]
    pairs = toxicity.counterfactuals([t for t, _ in rows])
    assert len(pairs) > 300 and all(a != b for a, b in pairs)
    gap = lambda m: sum(abs(a - b) for a, b in zip(*[[r["score"] for r in toxicity.with_score(documents(list(enumerate(side))), m).orderBy("doc_id").collect()] for side in zip(*pairs)]))
    assert gap(toxicity.train(rows)) < 0.5 * gap(toxicity.train(rows, penalty=0.0))  # "young" shares its beginning with a toxic word


def test_bounded_sample_of_labelled_rows(spark, documents):
    docs = documents([(i, f"text {i} " * (1 + i % 5)) for i in range(3000)] + [(7, "again")] * 500 + [(None, "x"), (5000, None)])
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)] + [(20, 0), (None, 1), (30, None), (5000, 1)], "doc_id long, toxic int")
    take = lambda n, **more: labelled.sample_per_label(docs, marks, "toxic", "doc_id", "text", F.col("doc_id") % 3 != 1, n, **more)
    rows = take((100, 50))
    assert rows == take((100, 50)) and 80 <= sum(y == 0 for _, y in rows) <= 100 and 40 <= sum(y for _, y in rows) <= 50
    assert all(int(t.split()[1]) % 10 == (0 if y else int(t.split()[1]) % 10) and int(t.split()[1]) % 3 != 1 for t, y in rows)
    everything = take((10**6, 10**6))
    assert sum(y for _, y in everything) == 200 and sum(y == 0 for _, y in everything) == 1800
    small = take((10**6, 10**6), most_bytes=900)
    assert small and all(sum(len(t) for t, z in small if z == y) <= 900 for y in (0, 1))
    assert take((100, 50))[:5] == rows[:5] and labelled.sample_per_label(docs.limit(0), marks, "toxic", "doc_id", "text", F.lit(True), (5, 5)) == []


def test_quality_network_learns_and_reads_whole_texts(documents):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = [(" ".join(word() + ("###" if i % 2 else "") for _ in range(150)), 1 - i % 2) for i in range(160)]
    net = quality_net.train(rows[:120], epochs=4)
    df = documents(list(enumerate(t for t, _ in rows[120:])) + [(900, None), (901, ""), (902, rows[0][0] * 50)])
    score = {r["doc_id"]: r["score"] for r in quality_net.with_score(df, net).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows[120:]))
    assert score[902] > 0.5 and 0 <= score[900] == score[901] <= 1


def test_language_backs_off_to_characters(documents, awkward):
    rows = [("the house and the garden are there with gardens gardener gardening", "en"), ("das haus und der garten sind dort gartenzaun gartenweg hausgarten gartentor", "de")] * 3
    model = language.train(rows)
    df = documents([(1, "the garden"), (2, "der garten"), (3, "123 ."), (4, None), (5, "gartenhaus"), (6, "THERE")] + [(10 + i, t) for i, (_, t) in enumerate(awkward)])
    pred = {r["doc_id"]: r["lang_pred"] for r in language.with_language(df, model).collect()}
    assert [pred[i] for i in range(1, 7)] == ["en", "de", "und", "und", "de", "en"]
    assert language.with_language(documents([(1, "x")]), language.train([])).first()["lang_pred"] == "und"


def test_url_rules_and_scores(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1", "http://x.example.org/en/1?q", "http://b.com/fr/2", "http://b.com/de/3#f", "http://c.net/z", None, "nonsense", "http://d.org", "HTTP://notorg/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://good{i}.org/news/{i}") for i in range(30)] + [(200 + i, f"http://spam{i}.com/de/win{i}") for i in range(30)] + [(300, "http://spam.net/de/win7"), (301, "http://good.net/news/5")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None]
    assert (got[1]["host"], got[1]["path"], got[7]["host"]) == ("example.org", "/es/1", "")
    assert (got[300]["verdict"], got[301]["verdict"], got[4]["verdict"]) == ("block", "allow", "block")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models_keep_rare_grams_of_many_urls(spark):
    bulk = [(i, f"http://host{i % 7}.{('org', 'com')[i % 2]}/{('news', 'de')[i % 2]}/{'page' * 12}") for i in range(7000)]  # 460,000 ruled characters
    odd = [(7000, "http://a.org/qzxj"), (7001, "http://b.com/de/wvky"), (7002, "http://c.net/qzxj"), (7003, "http://c.net/wvky"), (None, "http://c.net/qzxj"), (7002, None)]
    got = url_filter.filter_urls(spark.createDataFrame(bulk + odd, "page_id long, url string")).collect()
    assert len(got) == len(bulk) + len(odd)
    order, grams, contexts = url_filter.ORDER, ({}, {}), ({}, {})
    for r in got:
        if r["rule"]:
            side, line = r["verdict"] == "block", "\x02" * order + r["host"] + r["path"]
            for i in range(order, len(line)):
                for k in range(order + 1):
                    grams[side][line[i - k : i + 1]] = grams[side].get(line[i - k : i + 1], 0) + 1
    for side in range(2):
        for gram, n in grams[side].items():
            seen, kinds = contexts[side].get(gram[:-1], (0, 0))
            contexts[side][gram[:-1]] = (seen + n, kinds + 1)
    for r in got[-300:] + [r for r in got if r["page_id"] is None or r["page_id"] >= 7000]:
        line, total = "\x02" * order + r["host"] + r["path"], 0.0
        for i in range(order, len(line)):
            p = [1 / 256, 1 / 256]
            for k in range(order + 1):
                for side in range(2):
                    seen, kinds = contexts[side].get(line[i - k : i], (0, 0))
                    if seen:
                        p[side] = (grams[side].get(line[i - k : i + 1], 0) + kinds * p[side]) / (seen + kinds)
            total += math.log(p[0] / p[1])
        assert r["score"] == pytest.approx(total / max(1, len(line) - order), abs=1e-9)
