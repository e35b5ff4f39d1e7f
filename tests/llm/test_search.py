"""Exact top-k search, URL filters, archives and decontamination on odd rows and against brute force."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import decontamination, topk, urls, warc
from ledgerflow.llm.queries import URL_RULES

SMALL = "/root/testdata/sf0.001"


# --- Top-k ---


def best(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in usable if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, dims", [(1.0, 40), (1e6, 17), (0.0, 3)])
def test_nearest_equals_brute_force(spark, scale, dims):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=dims) * scale).tolist()) for i in range(310)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(1_000, None), (1_001, [1.0, None]), (1_002, [float("nan")] * dims), (1_050, [float("inf")]), (1_100, []), (1_101, [2.5])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(tuple(r) for r in topk.nearest(frame, F.col("vec_id") % 50 == 0).collect()) == best(rows)


def test_nearest_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [0.5])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.nearest(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 50, 256 * 128), (50, 1, 1, 128 * 512), (50, 2, 0, 128 * 256)]
    assert topk.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.nearest(frame, F.col("vec_id") < 0).count() == 0


# --- URLs ---


def test_stated_rules_and_parts(spark):
    cases = {
        "http://Example.COM/x": ("example.com", "/x", "com/", "allow"),
        "https://a.example.com/en/1?q": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://b.www.example.com/en/": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://x.net/es/#t": ("x.net", "/es/", "net/es/", "block"),
        "http://badnet/fr/": ("badnet", "/fr/", None, "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://É.com/é/?a://b": ("É.com", "/é/", "com/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, "http://example.com/"] * 2)], "page_id long, url string, verdict string")
    rows = urls.judged(pages, URL_RULES, min_support=0.9).collect()
    assert len(rows) == 22
    for r in rows:
        url = [*cases, "http://example.com/"][r.page_id % 11]
        assert (r.host, r.path, r.rule, r.verdict) == cases.get(url, ("example.com", "/", "com/", "allow"))
    assert urls.judged(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judged(pages.filter("url is null"), URL_RULES).collect()} == {"allow"}


def test_mined_combinations_decide_the_rest(spark):
    pages = [(i, f"http://h{i % 7}.net/es/{i}") for i in range(50)] + [(100 + i, f"http://h{i % 7}.com/shop/{i}") for i in range(50)]
    pages += [(1_000, "http://z.org/es/1"), (1_001, "http://z.org/shop/1"), (1_002, "http://z.org/none")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES).collect()}
    assert (got[1_000], got[1_001], got[1_002]) == ("block", "allow", "allow")


def test_three_tokens_together_decide(spark):
    # Any two of the path's segments say nothing; all three of them always mean Spanish pages.
    pages, n = [], 0
    for a in "xy":
        for b in "uv":
            for c in "mn":
                for _ in range(20):
                    n += 1
                    blocked = (a, b, c) == ("x", "u", "m")
                    pages.append((n, f"http://{n}.{'net' if blocked else 'com'}/es/{a}/{b}/{c}/3d-{n % 2}"))
    pages += [(1_000 + n, u) for n, u in enumerate(["http://q.org/x/u/m/7", "http://q.org/x/u/n", "http://q.org/y/u/m", "http://q.org/x/v/m", "http://q.org/" + "x/" * 30_000 + "u/m"])]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES).collect()}
    assert [got[1_000 + n] for n in range(5)] == ["block", "allow", "allow", "allow", "block"]
    tokens = spark.createDataFrame([("h.x", "/12/3d-casino/7a/")], "h string, p string").select(urls.tokens(F.col("h"), F.col("p")).alias("t")).first().t
    assert tokens == ["host=h", "host=x", "top=x", "path=3d-casino", "path=7a"]


def test_url_filter_runs_no_python(spark):
    plan = urls.judged(spark.read.parquet(f"{SMALL}/pages.parquet"), URL_RULES)._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas"))


# --- Archives ---


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    html = [None, "", "a", "a", "<p>é\r\n\r\nWARC/1.1\r\nx", "<p>é\r\n\r\nWARC/1.1\r\nx", "longer text", "longer text", "\x00\n", "y" * 300_000]
    pages = [(10 - i, ["http://a b/", None, "http://x/\r\ny"][i % 3], h, "x") for i, h in enumerate(html)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, key string")
    warc.archived(frame, f"file:{tmp_path}/w", least).collect()
    rows = {r.page_id: r for r in warc.read_warc(spark, f"file:{tmp_path}/w").collect()}
    assert len(rows) == len(pages) and all(r.intact for r in rows.values())
    for page_id, _, h, _ in pages:
        data, r = (h or "").encode(), rows[page_id]
        same = [p for p, _, other, _ in pages if (other or "") == (h or "") and len(data) >= least]
        first = min(same, default=page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page_id else ("revisit", first))
        assert bytes(r.payload or b"") == (data if first == page_id else b"")
        assert r.date == "2024-01-01T00:00:00Z"


def test_archive_headers_and_empty_table(spark):
    head, body = warc.parse_arc(b"http://x y/ 1.2.3.4 20010203040506 text/html 200 - - 7 f.arc 3\nabcd", 2)
    assert (head["url"], head["offset"], body) == ("http://x y/", "7", b"abc")
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://x 1.2.3.4 20010203 text/html 9\nabc", 1)
    with pytest.raises(ValueError):
        warc.parse_arc(b"only two\n", 1)
    record = warc.warc_record(head, b"HTTP/1.1 200 OK\r\n\r\nabc", 4, None) + warc.END
    (got, block), = warc.parse_warc(record)
    assert got["warc-date"] == "2001-02-03T04:05:06Z" and block.endswith(b"abc")
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version, pack", [(1, None), (2, None), (1, "record"), (2, "whole")])
def test_archives_of_several_records_are_read_by_their_lengths(spark, tmp_path, version, pack):
    extra = "" if version == 1 else " 404 - http://to/ 99 old.arc"
    bodies = [b"HTTP/1.0 200 OK\r\nX: y\r\n\r\none\n\nhttp://not.a/ header 3\n", b"HTTP/1.0 200 OK\r\nX-Archive-Key: 8\r\n\r\n" + b"z\xff" * 70_000, b""]
    parts = [warc.version_block(version, "19990101000000")]
    parts += [f"http://p{n}/a b 1.2.3.{n} 1999010203040{n} text/html{extra} {len(b)}\n".encode() + b + b"\n" for n, b in enumerate(bodies)]
    data = b"".join(gzip.compress(p) for p in parts) if pack == "record" else b"".join(parts)
    (tmp_path / "old.arc").write_bytes(gzip.compress(data) if pack == "whole" else data)
    rows = warc.read_arc(spark.read.format("binaryFile").load(f"file:{tmp_path}/old.arc"))
    got = sorted((r.url, r.ip, r.date, r.key, bytes(r.body), r.size) for r in rows.collect())
    assert got == [(f"http://p{n}/a b", f"1.2.3.{n}", f"1999010203040{n}", [None, 8, None][n], b, len(b.partition(b"\r\n\r\n")[2])) for n, b in enumerate(bodies)]
    warc.write_warc(warc.with_first_copy(rows), f"file:{tmp_path}/new", file_bytes=10)
    assert len(list((tmp_path / "new").glob("*.gz"))) >= 1
    back = warc.read_warc(spark, f"file:{tmp_path}/new").collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.date, r.intact) for r in back) == sorted((k or 0, s, f"1999-01-02T03:04:0{n}Z", True) for n, (k, s) in enumerate((g[3], g[5]) for g in got))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"http://no.version/ 1 2 3 4\n"))


def test_pages_without_a_key_are_kept(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (None, None, None), (3, "v", "same"), (4, "v", "same")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages).collect()), key=str)
    assert got == sorted([(None, "response", None, 4), (None, "response", None, 0), (3, "response", None, 4), (4, "revisit", 3, 4)], key=str)


# --- Decontamination ---


def test_candidates_equal_plain_latent_cosines(spark):
    dice = random.Random(4)
    prose = lambda n: " ".join(f"w{min(dice.randint(0, 60), dice.randint(0, 60))}" for _ in range(n))
    items = [decontamination.item_of(i, prose(dice.randint(8, 60))) for i in range(12)]
    vocabulary = np.unique(np.concatenate([i.grams for i in items]))
    counts = np.array([dice.randint(1, 900) for _ in vocabulary])
    space = decontamination.space_of(spark, items, vocabulary, counts, 1_000)
    texts = [prose(dice.randint(0, 120)) + " other words here" * dice.randint(0, 3) for _ in range(30)] + ["", "w1 " * 2_000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    start, end, first = decontamination.words(data, offsets, decontamination.GAPS)
    hashes = decontamination.span_hashes(data, start, end, decontamination.MIXED_LOWER)
    got = set(space.candidates(hashes, first))
    expect, near = set(), set()
    for row in range(len(texts)):
        own = hashes[first[row] : first[row + 1]]
        for begin in decontamination.windows(len(own)):
            v = np.zeros(len(vocabulary))
            for h in own[begin : begin + decontamination.PASSAGE]:
                if h in vocabulary:
                    v[np.searchsorted(vocabulary, h)] += 1
            if v.sum() < space.least:
                continue
            length = np.sqrt((v * space.weights**2).sum())  # a repeated word counts as several
            v *= space.weights
            for owner, cosine in zip(space.owner, space.passages @ (v @ space.basis) / length):
                if cosine >= decontamination.COSINE:
                    expect.add((row, int(begin), int(owner)))
                if abs(cosine - decontamination.COSINE) < 1e-4:
                    near.add((row, int(begin), int(owner)))
    assert expect and got - near == expect - near


def test_the_space_is_the_smallest_that_keeps_half_of_every_passage(spark):
    dice = random.Random(6)
    items = [decontamination.item_of(i, " ".join(f"w{dice.randint(0, 400)}" for _ in range(dice.randint(20, 60)))) for i in range(40)]
    vocabulary = np.unique(np.concatenate([i.grams for i in items]))
    counts = np.array([dice.randint(1, 900) for _ in vocabulary])
    space = decontamination.space_of(spark, items, vocabulary, counts, 1_000)
    weights, rows = np.log(1_001 / (counts + 0.5)).clip(0.05), []
    for item in items:
        for b in decontamination.windows(len(item.grams)):
            v = np.zeros(len(vocabulary))
            np.add.at(v, np.searchsorted(vocabulary, item.grams[b : b + decontamination.PASSAGE]), 1)
            rows.append(v * weights / np.linalg.norm(v * weights))
    rows = np.array(rows)
    left, values, _ = np.linalg.svd(rows, full_matrices=False)
    kept = ((left * values) ** 2).cumsum(1).min(0)
    rank = space.basis.shape[1]
    assert rank < 0.75 * len(rows) and kept[rank - 1] >= decontamination.KEPT > kept[rank - 2]
    # The same directions as the exact decomposition, but for sign and turn.
    exact = (left * values)[:, :rank]
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    assert np.allclose(space.passages @ space.passages.T, exact @ exact.T, atol=1e-3)


def test_planted_items_are_found_and_others_left_alone(spark):
    dice = random.Random(9)
    common = [f"the{i}" for i in range(12)]
    prose = lambda n: [dice.choice(common) if dice.random() < 0.5 else f"w{dice.randint(0, 5_000)}" for _ in range(n)]
    items = [prose(dice.randint(15, 59)) for _ in range(150)]
    docs, planted = [], set()
    for i in range(400):
        words = prose(dice.randint(5, 400))
        if i % 4 == 0:
            k = dice.randrange(len(items))
            item = list(items[k])
            if i % 8 == 0:  # a few words changed
                for j in range(len(item) // 10):
                    item[dice.randrange(len(item))] = f"new{j}"
            cut = dice.randint(0, len(words))
            words = [*words[:cut], *item, *words[cut:]]
            planted.add((i, k))
        docs.append((i, " ".join(words).upper() if i % 3 == 0 else ", ".join(words), 0.5))
    docs += [(1_000, None, 0.0), (1_001, "", 0.0), (1_002, "x", 0.0), (0, docs[0][1], 0.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, share double")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(900, None), (901, ""), (902, "too short")], "item_id long, text string")
    rows = [(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()]
    assert len(rows) == len(planted) + 1 and len(set(rows) & planted) >= 0.99 * len(planted) and not set(rows) - planted
    assert decontamination.without_leaks(frame, bench).filter("doc_id % 4 <> 0 or doc_id > 999").count() == 303
    assert decontamination.leaks(frame.limit(0), bench).count() == 0
    assert decontamination.leaks(frame, bench.limit(0)).count() == 0


def test_common_subsequence_and_answer():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 9, 4, 7, 5])
    left, right = decontamination.common_subsequence(a, b)
    assert a[left].tolist() == b[right].tolist() == [1, 3, 4, 5]
    question = "how many of the great blue birds were seen there by the old river. seven birds"
    item = decontamination.item_of(1, question)
    assert item.answer == len(item.grams) - 2

    def near(text):
        return decontamination.settled(item, decontamination.item_of(0, text).grams, 0)

    asked = "how many of the large red birds were spotted there by the old stream "
    assert near(asked + "seven birds") and near(asked + "three cats") is None


def hashed(words):
    return decontamination.item_of(0, " ".join(words)).grams


@pytest.mark.parametrize("scale", [1, 1_000_000])
def test_short_and_reworded_items_are_candidates_in_corpora_of_any_size(spark, scale):
    dice = random.Random(11)
    items = [[f"w{dice.randint(0, 300)}" for _ in range(dice.randint(8, 16))] for _ in range(60)]
    made = [decontamination.item_of(k, " ".join(w)) for k, w in enumerate(items)]
    known = np.unique(np.concatenate([i.grams for i in made]))
    counts = np.random.default_rng(2).integers(5, 100, len(known)) * scale
    space = decontamination.space_of(spark, made, known, counts, 400 * scale)
    for k, item in enumerate(items):
        new = list(item)
        for j in dice.sample(range(made[k].answer), len(item) * 3 // 10) if made[k].answer >= len(item) * 3 // 10 else []:
            new[j] = f"x{j}"
        for words in (item, new):
            cut = dice.randint(0, 80)
            text = hashed([f"o{j}" for j in range(cut)] + words + [f"p{j}" for j in range(80)])
            found = [near for _, near, owner in space.candidates(text, np.array([0, len(text)])) if owner == k]
            assert any(decontamination.settled(made[k], text, near) for near in found)


def test_short_and_repetitive_items_match(spark):
    items = [(1, "Who won? Ada"), (2, "zebra"), (3, "What is two and two? It is four"), (4, "who won ada"), (5, "no no no no no no no yes no no"), (6, "..."), (7, "never ever there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "so they asked who won, ADA said"), (2, "who won then ada"), (3, "a zebra, and a zebra"), (4, "q: what is two and two? it is four"),
            (5, "well no no no no no no no yes no no then"), (6, "ada"), (7, ""), (8, None), (9, "never ever")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.item_id, r.share, r.begin_word, r.end_word) for r in decontamination.leaks(frame, bench).collect())
    assert got == [(1, 1, 1.0, 3, 6), (1, 4, 1.0, 3, 6), (3, 2, 1.0, 1, 2), (4, 3, 1.0, 1, 9), (5, 5, 1.0, 1, 11)]
    only = decontamination.leaks(frame, bench.filter("item_id = 2")).collect()
    assert [(r.doc_id, r.item_id) for r in only] == [(3, 2)]


def test_repeated_item_words_reach_the_cosine(spark):
    item = decontamination.item_of(1, "go go go go go go go go now please")
    known = np.unique(item.grams)
    space = decontamination.space_of(spark, [item], known, np.full(len(known), 500), 10_000)
    text = hashed([f"o{j}" for j in range(7)] + ["go"] * 8 + ["now", "please"] + [f"p{j}" for j in range(7)])
    assert [owner for _, _, owner in space.candidates(text, np.array([0, len(text)]))] == [0]
