"""Brute force, round trips, held-out accuracy, names that clash and texts that are very long."""

import hashlib
import random
import re
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewin.llm import common, decontaminate, html_text, mixing, neardup, pii, quality, rans, sharding, topk, urlfilter
from slicewin.llm.bytepieces import Encoder

# ---- names, places


def test_a_shared_folder_is_asked_for_off_one_machine(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    assert common.shared_dir(spark)


def test_written_tables_can_be_discarded(spark):
    df = common.materialize(spark.range(3), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    common.discard(df)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


CLASH = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "accepted", "p_junk", "p_toxic", "_text", "_hits", "_found", "_share", "_turn", "row", "words", "id", "own", "share", "size", "taken", "shard", "slot", "component_id", "kept"]


def clashing(spark, n=12):
    rows = [(i if i % 5 else None, f"the old mill {i} and its wheels by the quiet river" if i % 4 else (None, "")[i % 8 == 0], f"s{i % 2}" if i % 3 else None, *[777] * len(CLASH)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASH))


def test_columns_of_any_name_are_carried(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([("i", "w1 w2 w3")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (decontaminate.drop_contaminated(docs, items), quality.keep_accepted(docs, labels), mixing.mixed_documents(docs), neardup.keep_one_of_each(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == 777 for r in rows for c in CLASH)
    assert sharding.assign_shards(docs).count() == mixing.mix(docs).count() == docs.count() == 12
    assert pii.find_personal_data(docs).count() == 12


# ---- 1 personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def luhn(number):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(number))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def test_base_spans_against_brute_force(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.zz", "1", "23", "255", "300", ".", "-", " ", "+", "(706)", "4111 1111 1111 1111", "5500005555555559", "1.2.3.4", "é", "𝔘", "\n", "%", "_", "+1 706 555 3138"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        want = [(k, m.start(), m.end()) for k, p, ok in KINDS for m in re.finditer(p, texts[row["doc_id"]]) if ok(m[0])]
        assert [tuple(s) for s in row["base"]] == want, repr(texts[row["doc_id"]])


def test_terms_against_brute_force(spark):
    r = random.Random(9)
    names, fill = ["zorb", "quix", "plim"], [f"w{i}" for i in range(30)]
    docs = []
    for i in range(120):
        words = [r.choice(fill) for _ in range(8)]
        if i % 3 == 0:
            words.append(f"u{i}@{r.choice(names)}.test")
            words.append(r.choice(names))
        docs.append((i, " ".join(words)))
    spans = pii.base_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    found = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    terms = {d["text"][s["start"] : s["end"]].lower() for d in found for s in d["terms"]}
    ents, bags = {}, {}
    for row in spans.collect():
        bare = row["text"]
        mine = set()
        for s in row["email"]:
            value = s["value"].lower()
            domain = value.split("@")[-1]
            mine |= {"kind", ("v", value), ("d", domain), ("e", ".".join(domain.split(".")[-2:]))}
            bare = bare[: s["start"]] + " " * (s["end"] - s["start"]) + bare[s["end"] :]
        ents[row["doc_id"]], bags[row["doc_id"]] = mine, {w.lower() for w in re.findall(r"[\w]+", bare)}
    n, want = len(docs), set()
    for e in {x for m in ents.values() for x in m}:
        having = {i for i, m in ents.items() if e in m}
        if 3 <= len(having) < n:
            for w in {w for i in having for w in bags[i]}:
                df = sum(w in b for b in bags.values())
                both = sum(w in bags[i] for i in having)
                if both >= 3 and np.log(n * both / (df * len(having))) / -np.log(len(having) / n) >= pii.THRESHOLD:
                    want.add(w)
    assert terms == want


def test_secrets_reveal_themselves(spark):
    key = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    texts = [f'token = "{key}" é', "antidisestablishmentarianism and 12345678901234567890123", "a1" * 30, f"{key.lower()}@x.org", f"é{key}é {key[:19]}", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.sanitize(pii.find_personal_data(df)).collect()}
    assert [[tuple(s)[1:] for s in found[i]["secrets"]] for i in range(6)] == [[(9, 49)], [], [], [], [(1, 41)], []]
    assert found[0]["sanitized"] == 'token = "[secret]" é'


def test_very_long_personal_data(spark):
    texts = ["a@b" + ".c" * 100_000, " ".join(f"u{i}@x.org" for i in range(20_000)), "1." * 60_000, "+1" + "1" * 60_000, "7 " * 60_000, "@" * 60_000]
    begin = time.time()
    out = {r["doc_id"]: len(r["base"]) for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "base").collect()}
    assert (out[0], out[1], out[2], out[3], out[5]) == (1, 20_000, 15_000, 0, 0) and time.time() - begin < 120


# ---- 2 sharding, 3 mixing


def test_one_more_shard_moves_few_rows(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, 40).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, 41).collect()}
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert 1 / 41 - 0.01 <= moved < 0.35


def test_mixing_with_a_source_of_a_third_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "hot")] * 300 + [(i, "a b", f"s{i % 3}") for i in range(2, 600)] + [(7000, None, None), (None, "x", None)], "doc_id long, text string, source string")
    out = mixing.mix(rows)
    totals = {r["source"]: (r["t"], r["target"]) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) < 1 for t, target in totals.values()) and out.count() == 900
    again = sorted(map(repr, mixing.mix(rows.repartition(7)).collect()))
    assert again == sorted(map(repr, out.collect()))


# ---- 4 top k


def test_walks_stop_where_the_bound_tells(spark):
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.exponential(1, (5000, 16)) * 0.3 ** np.arange(16))
    best = topk.Best(np.arange(20), v[:20], 5)
    best.search(np.arange(5000), v)
    for a in range(20):
        s = v @ v[a]
        want = sorted((-s[i], i) for i in range(5000) if i != a)[:5]
        assert [(-x, y) for x, y in zip(best.score[a], best.vec[a], strict=True)] == want
    assert best.scored.mean() < 1000


def test_queries_that_occur_twice_and_other_lengths(spark, monkeypatch):
    rows = [(50, [1.0, 2.0], 9), (50, [0.0, 1.0], 9), (1, [1.0, 1.0], 9), (1, [1.0, 1.0], 9), (2, [3.0, 1.0, 1.0], 9), (100, [0.0, 0.0], 9), (None, [9.0, 9.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    want = [(50, 1, 1, 65536), (50, 2, 1, 65536), (50, 3, 100, 0), (100, 1, 1, 0), (100, 2, 1, 0), (100, 3, 50, 0), (100, 4, 50, 0)]
    assert sorted(tuple(r)[:4] for r in topk.search(df).collect()) == want
    monkeypatch.setattr(topk, "QUERY_BYTES", 20)
    assert sorted(tuple(r)[:4] for r in topk.search(df).collect()) == want


# ---- 5 URLs


def test_urls_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "x.net", "net", "com", "notexample.com", "example.org", "examplexcom", ""]
    paths = ["", "/", "/en/", "/en/1", "/en", "/es/2", "/fr/", "/de/en/", "/EN/"]
    urls = [f"{s}{h}{p}{e}" for s, h, p, e in product(["http://", "https://", "x", ""], hosts, paths, ["", "?q=/en/", "#top"])] + [None, "", "://", "http://com/" + "a" * 100_000]
    r.shuffle(urls)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {x["page_id"]: x for x in urlfilter.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule[1]), u
        assert out[i]["verdict"] in ("allow", "block") and (rule[2] is None or out[i]["verdict"] == rule[2])


# ---- 6 HTML


def pages(spark, sources, host="h"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")


def texts(spark, sources):
    return [r["text"] for r in sorted(html_text.extract(pages(spark, sources)).collect(), key=lambda r: r["page_id"])]


def site(i, words):
    body = "".join(f"<p>{i} {w} some words of the article that differ</p>" for w in words)
    return (
        f"<html><body><div class='x1'><a href='/'>Start</a> <a href='/l'>List {i}</a></div><div class='middle'><h2>About {i}</h2>{body}<span>Read more</span></div>"
        f"<div class='x2'>Last seen {i}</div><div class='x3'>Terms of use</div></body></html>"
    )


def test_the_main_slot_is_found_without_names(spark):
    out = texts(spark, [site(i, ["red", "blue", "green"][: 1 + i % 3]) for i in range(8)])
    assert out[4] == "About 4\n\n4 red some words of the article that differ\n\n4 blue some words of the article that differ"


def test_classes_decide_the_template():
    row = lambda token, parent, chars, n=6, vector="v", once=True, kind=html_text.ELEMENT: {"kind": kind, "token": token, "n": n, "vector": vector, "once": once, "parent": parent, "place": float(token), "chars": chars}
    body = [row(1, 0, 0), row(2, 1, 50), row(3, 1, 900), row(4, 3, 100, vector="w", once=False), row(9, 0, 0, kind=html_text.TEXT)]
    assert html_text.template(body) == (3, [9])
    assert html_text.template([{**t, "vector": str(t["token"])} for t in body]) == (None, [])  # no class of two tokens
    assert html_text.template([{**t, "chars": 10} for t in body])[0] == 1  # no part holds most of the text


def test_wrapping_elements_are_no_furniture(spark):
    inner = "<h1>Title</h1><p>Some words.</p><div class='comments'>no</div>"
    sources = [f"<body><div class='content has-sidebar'>{inner}</div><aside>x</aside></body>", f"<body><form action='/'>{inner}</form></body>", f"<body><article><div class='article-header'><h1>Title</h1></div><p>Some words.</p></article></body>", f"<body><header><h1>Site</h1></header><article>{inner}</article></body>"]
    for i, s in enumerate(sources):
        assert texts(spark, [s]) == ["Title\n\nSome words."], i


def test_very_long_and_broken_pages(spark):
    begin = time.time()
    out = texts(spark, ["<a " * 300_000, '<a "' * 100_000 + ">x", "<script " * 100_000, "<!--" * 100_000, "<div>" * 50_000 + "deep" + "</p>" * 50_000, "&amp;" * 100_000, None, ""])
    assert time.time() - begin < 90 and out[0].startswith("<a <a") and out[4] == "deep" and out[5] == "&" * 100_000 and out[6:] == ["", ""]


def test_pages_repeat_and_names_clash(spark):
    rows = [(1, "http://h/1", "<p>a</p>", "t", 7)] * 3 + [(None, None, "<p>b</p>", "t", 7)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host long"))
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "http://h/1", "a", 1)] * 3 + [(None, None, "b", 1)]


def test_many_templates_meet_pages_by_salted_hosts(spark, monkeypatch):
    sources = [site(i, ["red", "blue"]) for i in range(9)]
    want = texts(spark, sources)
    monkeypatch.setattr(html_text, "BROADCAST", -1)
    assert texts(spark, sources) == want


# ---- 7 tokens


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    e, r = Encoder(tokenizer), random.Random(1)
    letters = [*"ab'sstrevemlld ll'  \n\t\r 12!?.,é中  　٣²½ªǅ𝔘😀́​\x85\x1c", "<|endoftext|>", "'s", "'re", "'ll", " '", "\n'", "   "]
    some = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(20_000)] + [None, "", "x" * 5000, " " * 5000, "a" * 300 + "'s"]
    want = [x.ids for x in e.coder.encode_batch_fast([t or "" for t in some], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(pa.array(some))] == want


def test_kept_pieces_start_anew(tokenizer, monkeypatch):
    monkeypatch.setattr("slicewin.llm.bytepieces.KEPT", 64)
    e = Encoder(tokenizer)
    some = [f"word{i} and other{i % 7} things" for i in range(500)]
    for at in range(0, 500, 50):
        part = some[at : at + 50]
        assert [x.tolist() for x in e.encode(pa.array(part))] == [x.ids for x in e.coder.encode_batch(part, add_special_tokens=False)]


def test_tokenizers_of_another_kind(spark):
    other = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    e = Encoder(other)
    some = ["Some Words here", "", "é 中"]
    assert [x.tolist() for x in e.encode(pa.array(some))] == [x.ids for x in e.coder.encode_batch(some, add_special_tokens=False)]


def test_files_are_read_by_whoever_has_them(spark, tokenizer, tmp_path):
    rows = [(i, " ".join(f"w{j % 97}" for j in range(i))) for i in (3, 1, 70_000, 2)] + [(None, None), (1, "again")]
    path = f"file://{tmp_path}/out"
    rans.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer, path)
    out = sorted(rans.read_files(spark.newSession(), path).collect(), key=lambda r: r["start"])
    e = Encoder(tokenizer)
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), out, strict=True):
        ids = np.append(e.encode(pa.array([t], pa.string()))[0], np.uint32(0)).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_are_decoded_from_checkpoints():
    ids = np.random.default_rng(3).zipf(1.3, 300_001) % 500
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=500)))
    data = coder.encode(ids)
    _, lanes, marks = np.frombuffer(data, "<u4", 3)
    assert marks >= 1
    step = int(lanes) * rans.MARK
    parts = [coder.decode(data, m, m + 1 if m < marks else None) for m in range(marks + 1)]
    assert (np.concatenate(parts) == ids).all() and all(len(p) == step for p in parts[:-1])


def test_a_block_that_was_changed_is_refused(spark, tokenizer, tmp_path):
    path = f"file://{tmp_path}/out"
    rans.write_files(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), tokenizer, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("checksum", F.col("checksum") + 1)
    with pytest.raises(Exception, match="checksum"):
        rans.decode_blocks(blocks, rans.table_of(spark.read.parquet(f"{path}/counts"))).collect()


# ---- 9 quality


def test_expectation_maximisation_against_all_votes_one_by_one():
    r = np.random.default_rng(2)
    truth = r.random(4000) < 0.2
    accuracy = [(0.9, 0.05), (0.7, 0.02), (0.8, 0.1)]
    votes = np.array([[("1" if r.random() < (a if t else b) else "0") if r.random() < 0.9 else "-" for a, b in accuracy] for t in truth])
    patterns = ["".join(v) for v in votes]
    counts = {p: patterns.count(p) for p in set(patterns)}
    posterior, theta = quality.expectation_maximisation(counts)
    assert np.abs(theta - np.array(accuracy)).max() < 0.06
    # The same by plain loops over the documents.
    prior, t = 0.1, [[0.7, 0.02] for _ in accuracy]
    for _ in range(50):
        p = []
        for row in votes:
            yes, no = prior, 1 - prior
            for (a, b), v in zip(t, row, strict=True):
                yes *= {"1": a, "0": 1 - a, "-": 1}[v]
                no *= {"1": b, "0": 1 - b, "-": 1}[v]
            p.append(yes / (yes + no))
        p = np.array(p)
        for j in range(len(accuracy)):
            for c, w in enumerate((p, 1 - p)):
                ones, zeros = w[votes[:, j] == "1"].sum(), w[votes[:, j] == "0"].sum()
                t[j][c] = min(max((ones + (1 if c == 0 else 0.02)) / (ones + zeros + (1.5 if c == 0 else 1)), 1e-4), 1 - 1e-4)
        prior = min(max(p.mean(), 1e-4), 0.5)
    assert np.abs(theta - np.array(t)).max() < 1e-6
    assert all(abs(posterior[x] - y) < 1e-6 for x, y in zip(patterns, p, strict=True))


def test_scorer_tells_apart_what_it_was_not_shown():
    r = np.random.default_rng(4)

    def drawn(n):
        y = (r.random(n) < 0.3).astype(float)
        words = [np.unique(np.concatenate([r.integers(quality.DENSE + 1, quality.FEATURES, 30), r.integers(100, 140, 3) if t else np.zeros(0, int)])) for t in y]
        return np.ones((n, quality.DENSE + 1)) * np.eye(quality.DENSE + 1)[0], words, y

    dense, words, y = drawn(1500)
    w = quality.train(dense, np.concatenate(words), np.array([len(x) for x in words]), y)
    _, others, truth = drawn(500)
    found = np.array([w[0] + w[x].sum() > 0 for x in others])
    assert (found == (truth > 0.5)).mean() > 0.97


def test_held_out_accuracy_of_the_classifier(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    try:
        docs, labels = table("documents"), table("labels")
    except Exception:
        pytest.skip("no test data")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    out = quality.classify(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    bad, good = [r for r in out if r["quality"] == 0], [r for r in out if r["quality"] == 1]
    assert sum(r["p_junk"] > 0.5 for r in bad) >= 0.9 * len(bad) and sum(r["p_junk"] > 0.5 for r in good) <= 0.01 * len(good)
    clean = [r for r in out if r["toxic"] == 0]
    assert sum(r["p_toxic"] > 0.5 for r in clean) <= 0.05 * len(clean)


# ---- 8 and 10


def test_very_long_texts_of_the_word_operators(spark):
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(rows).collect()}
    assert found[1] == (5000, 1) and found[2][1] == 1 and found[3] == (1, 3)
    items = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(20, 32)))], "item_id string, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_overlaps(rows, items).collect()}
    assert hits == {1: 12 * 24, 2: 12 * 24, 3: 0}


def test_exact_search_finds_the_same_components(spark):
    r = random.Random(8)
    base = [[f"b{g}x{i}" for i in range(300)] for g in range(3)]
    rows = []
    for i in range(60):
        words = list(base[i % 3])
        for at in r.sample(range(300), r.randrange(14)):
            words[at] = f"e{r.randrange(1 << 40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(neardup.near_duplicates(df).collect()) == sorted(neardup.near_duplicates(df, sketch=None).collect())
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, sketch=64)


def test_digests():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
