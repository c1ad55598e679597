"""Small cases of each operator: nulls, empty texts, repeated rows, empty tables, clashing names."""

import zlib

import numpy as np
import pytest

from slicewin.llm import decontaminate, html_text, neardup, pii, quality, rans, topk, urlfilter

DOCS = "doc_id long, text string, source string, n long, start long, found string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, "x") for i, t in rows], DOCS)


LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, LONG + " tail"), (4, None), (5, ""), (6, "a b"), (7, "A  b"), (None, "z"), (8, " ".join(f"v{i}" for i in range(60)))]


def test_neardup(spark):
    out = {(r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in neardup.near_duplicates(docs(spark, ROWS)).collect()}
    assert out == {(1, 1, True, 57), (2, 1, False, 57), (3, 1, False, 58), (4, 4, True, 0), (5, 5, True, 0), (6, 6, True, 1), (7, 6, False, 1), (None, None, True, 1), (8, 8, True, 57)}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, other texts of one id, and copies without ids."""
    other = LONG.replace("w", "u")
    rows = [*ROWS, (2, "other text of a kept or dropped id"), (9, other), (9, other), (9, "quite another text"), (None, other), (None, "lone " * 9), (None, "lone " * 9)]
    kept = neardup.keep_one_of_each(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 5, 6, 8, 9]
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == ["lone " * 9, "z"]
    assert neardup.keep_one_of_each(docs(spark, [])).count() == 0


def test_group_of_near_copies(spark):
    """A group whose members are similar to some of the others only, and sets larger than a sketch, against all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for size in (150, 400):
        base = [f"b{size}x{i}" for i in range(size)]
        for _ in range(50):
            words = list(base)
            for at in rng.integers(0, size, rng.integers(0, size // 16)):
                words[at] = f"e{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    linked = [[y for y, v in enumerate(sets) if 100 * len(u & v) >= 80 * len(u | v)] for u in sets]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[y] for y in near) for near in linked]
    assert 2 < len(set(root)) < len(rows)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert out == {x: (len(sets[x]), root[x], root[x] == x) for x in range(len(rows))}


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(1, int), np.full(5000, 3), rng.zipf(1.3, 70_001) % 1000, np.arange(1000)):
        freq = rans.frequencies(np.bincount(ids, minlength=1200))
        coder = rans.Coder(freq)
        assert (coder.decode(coder.encode(ids)) == ids).all()


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, at = Tokenizer.from_file(path), 0
    found = sorted(rans.write_and_read(docs(spark, ROWS), path).collect(), key=lambda r: r["start"])
    for (_, text), r in zip(sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), found, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rans.write_and_read(docs(spark, []), path).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, rng.normal(size=8).tolist())]
    rows[7] = (7, rows[8][1])
    out = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x and None not in x and np.isfinite(x).all()}
    expected = set()
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert out == expected
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_personal_data(spark):
    text = "é a.b@c.de 1.2.3.4 300.1.1.1 x4111 1111 1111 1111 +1 (706) 555-3138\n" + "9" * 5000
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, [(1, text), (2, None), (3, "")])).collect()}
    assert [tuple(s) for s in rows[1]["base"]] == [("email", 2, 10), ("ip", 11, 18), ("card", 30, 49), ("phone", 50, 67)]
    assert [rows[i]["base"] for i in (2, 3)] == [[], []]
    assert pii.find_personal_data(docs(spark, [])).count() == 0


def test_disclosing_terms_are_removed(spark):
    rows = [(i, "call Zorblax at z@x.org now") for i in range(4)] + [(9 + i, "call me now at noon") for i in range(40)]
    out = {r["doc_id"]: r["sanitized"] for r in pii.sanitize(pii.find_personal_data(docs(spark, rows))).collect()}
    assert out[1] == "call  at [email] now"
    assert out[10] == "call me now at noon"


def test_terms_disclose_classes_over_whole_documents(spark):
    """Each address is there once; the name stands lines and many characters away, or without any address."""
    far = "filler words " * 8
    rows = [(i, f"Quizzle\n{far}\nu{i}@acme.test") for i in range(5)] + [(5, f"ask QUIZZLE {far}"), *[(9 + i, far) for i in range(40)]]
    out = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, [*rows, rows[0], rows[0]])).collect()}
    assert [tuple(s) for s in out[0]["terms"]] == [("term", 0, 7)] and [tuple(s) for s in out[0]["base"]] == [("email", 9 + len(far), 21 + len(far))]
    assert [tuple(s) for s in out[5]["terms"]] == [("term", 4, 11)]
    assert out[9]["terms"] == []


def test_html(spark):
    page = "<html><nav>menu</nav><article><h1>T&amp;t</h1><p>a  <b>b</b><br>c<p>d</article><div class='comments'>no</div><script>x<y</script><footer>f</footer>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), *[(10 + i, f"http://k/{i}", f"<div>same</div><p>own {i}</p>") for i in range(5)]]
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == ("T&t\n\na b c\n\nd", 13)
    assert out[2] == out[3] == ("", 0)
    assert out[12] == ("own 2", 5)


def test_html_of_a_host_of_copies(spark):
    """Copies of one page are most rows of the host, but one of its three different pages."""
    rows = [(i, "http://h/a", "<div>same</div><p>copied words</p>") for i in range(6)] + [(10 + i, f"http://h/{i}", f"<div>same</div><p>own {i}</p>") for i in range(2)]
    out = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {**{i: "copied words" for i in range(6)}, 10: "own 0", 11: "own 1"}


def test_classifier(spark):
    clean = [(i, f"the quiet river {i} runs by the old mill and its {i} wheels") for i in range(60)]
    toxic = [(100 + i, f"the quiet river {i} runs by you grobnik and its mill") for i in range(12)]
    junk = [(200 + i, " ".join(f"WORD{i}{j}!!" for j in "ABCDEFGHIJ")) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in clean + toxic] + [(999, 0, 1), (None, 0, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["accepted"] for r in quality.classify(docs(spark, [*clean, *toxic, *junk, (300, None), (301, "")]), labels).collect()}
    assert all(out[i] for i, _ in clean) and out[300] and out[301]
    assert not any(out[i] for i, _ in toxic + junk)
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_faults_that_the_scorer_has_not_seen(spark):
    """The scorer is trained on labelled rows without junk; votes over all rows find it."""
    clean = [(i, f"the quiet river {i} runs by the old mill and its {i} wheels") for i in range(60)]
    junk = [(200 + i, " ".join(f"WORD{i}{j}!!" for j in "ABCDEFGHIJ")) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["accepted"] for r in quality.classify(docs(spark, clean + junk), labels).collect()}
    assert out == {i: i < 100 for i in out} and len(out) == 72
    alone = {r["doc_id"]: r["accepted"] for r in quality.classify(docs(spark, clean + junk), labels.limit(0)).collect()}
    assert alone == out


def test_urls_and_overlaps_without_rows(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    items = spark.createDataFrame([("i", "w1 w2 w3"), (None, None)], "item_id string, text string")
    out = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.find_overlaps(docs(spark, ROWS), items).collect()}
    assert out[1] == (3, True) and out[4] == (0, False)
    assert decontaminate.find_overlaps(docs(spark, []), items).count() == 0
