"""URL filter, HTML cut, toxicity, neighbours, SimHash and the pipeline against brute force and edge cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import components, html_cut, near_copies, neighbours, simhash, toxicity, url_filter
from test_llm_text import check_packing, documents, plain_counts

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/1?x=http://a.b/", "http://example.net/EN/1", "https://a.example.com/de/x#/fr/", "http://x.org/fr/",
    "http://x.org", "http://net/", "http://net", "http://notnet/", "http://EXAMPLE.com?/de/", "http://Ä.Net/ü", "a://b://c/d", "http://free-casino.example.com/en/1", "x" * 50_000 + "://h/p", "\nhttp://h.org/fr/\n?",
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for r in ("net/", "example.net/en/", "example.com/de/", "org/fr/"):
        name, below = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below) and len(r) > len(best or ""):
            best = r
    return best


def test_url_filter(spark):
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u, "x", 3.0) for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, score double")
    out = url_filter.filter_urls(pages, url_filter.RULES, model)
    assert out.columns == ["page_id", "url", "host", "score", "path", "rule", "verdict"]
    for r in out.collect():
        host, path = plain_url(r["url"])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        by_model = "block" if model.score(host, path) >= 0.5 else "allow"
        assert r["verdict"] == ({"net/": "block", "example.com/de/": "block"}.get(rule, "allow") if rule else by_model)
    assert url_filter.filter_urls(pages.where("false"), url_filter.RULES, model).count() == 0


def test_url_model_on_held_out_names(spark):
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    bad = ["www.casino-bonus.example.org", "cheap-pills.example.net", "m.free-bets.example.com", "track-ads.example.com"]
    assert not any(h.split(".")[-3] in url_filter.UNWANTED.split() for h in bad)
    good = ["www.botany.example.org", "blog.tiontion.example.com", "thther.example.org", "m.ththre.example.com"]
    assert all(model.score(h, "/en/7") > 0.5 for h in bad) and all(model.score(h, "/en/7") < 0.5 for h in good)
    empty = url_filter.train_url_model(url_filter.labelled_urls(spark).where("false"))
    assert empty.score("a", "/b") == 0.5


def test_minimum_cut_is_optimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        tied = {(a, b): rng.uniform(0, 1.5) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4}

        def cost(x):
            return sum(abs(z) for z, keep in zip(odds, x, strict=True) if (z > 0) != keep) + sum(c for (a, b), c in tied.items() if x[a] != x[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(html_cut.minimum_cut(odds, tied)) - best) < 1e-9


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies to make this site work
for all of our visitors, as you may know.</div><header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<article><h1>Real &amp; title</h1><p><b>First paragraph of the article with <i>enough</i> words.<br>After the break.<p>Short one.
<div class="ad">Buy this splendid machine now, it is cheaper than ever before.</div><p>Last&nbsp;paragraph,
of two lines.<script>var t="</p>";</script><section id="comments"><p>I think that this article is good, and long enough to look like content.</p>
</section></article><aside><p>Some related things that you could read about now, if you like.</p></aside><form>Leave your mail here<input></form>
<footer>(c) me</footer></body></html>"""


def test_html_cut(spark):
    want = "Real & title\nFirst paragraph of the article with enough words. After the break.\nShort one.\nLast paragraph, of two lines."
    assert html_cut.main_text(PAGE) == want
    long = "<p>" + "word " * 200_000 + "end.</p>"
    htmls = [PAGE, None, "", "plain text without any markup at all", "<![bad<p", "<div>" * 3_000 + "deep", long, PAGE]
    pages = spark.createDataFrame([(i, "u", h, "old") for i, h in enumerate(htmls)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_cut.extract(pages).collect()}
    assert got[0] == got[7] == want and got[1] == got[2] == "" and got[3] == htmls[3]
    assert got[6] == ("word " * 200_000 + "end.") and got[5] in ("", "deep")
    assert html_cut.extract(pages.where("false")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if (last := row) else row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_finds_all_words_within_one_edit():
    rng = random.Random(4)
    words = ["idiot", "moron", "loser", "pathetic", "scum", "ab", "abcde"]
    terms = [toxicity.Term(w, False, (2, 2, 2), 1.0) for w in words] + [toxicity.Term("lowei", True, (2, 2, 2), 1.0)]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(5000):
        w = list(rng.choice([*words, "lowei", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "é"])
        w = "".join(w)
        near = [n for n, t in enumerate(words) if w == t or (len(t) >= toxicity.FUZZY_FROM and edits(w, t) <= 1)]
        got = lexicon.match(w)
        if w in words:
            assert got == (words.index(w), 0)
        elif w.startswith("lowei"):
            assert got == (len(words), 2)
        elif near:
            assert got[0] in near and got[1] == 1
        else:
            assert got is None


def toxic_corpus(spark, n=240):
    rng = random.Random(9)
    plain_words = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "m")]
    bad = ["idiot", "moron", "worthless", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain_words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(bad, 2) * 2:
                words[rng.randrange(40)] = w
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic), "x"))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_held_out_and_misspelled(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(toxicity.fold(F.col("doc_id")) == 2).collect()]
    assert len(held) > 30 and all((out[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert model.score("you are an idoit and a m0ron and a wortless one") > 0.3  # an edit, a look-alike, a missing letter
    assert model.score("ban bar best dam fan") < 0.3 and model.score(None) == model.score("")
    quoted = 'they said "idiot" and "moron" were words'
    assert model.score(quoted) < model.score("they idiot and moron were words")


def test_toxicity_cases(spark):
    docs, labels = toxic_corpus(spark, 40)
    rows = documents(spark, [(None, None, "e", "s", 1), (1, "", "e", "s", 1), (1, "", "e", "s", 1), (2, "idiot " * 50_000, "e", "s", 1)]).withColumn("score", F.lit("own"))
    for usable in (labels, labels.where("toxic = 0"), labels.where("false"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.train(docs, usable)
        kept = toxicity.drop_toxic(rows, model)
        assert kept.columns == rows.columns and kept.where("text = ''").count() == 2
    assert toxicity.drop_toxic(rows.where("false"), model).count() == 0


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score double")


def exact_neighbours(rows, every=100):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(np.square(v - w).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, d) for d, j in near[:10]]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((1500, 24)).astype(np.float32)
    rows = [(i, p.tolist(), 0, 0.0) for i, p in enumerate(points)]
    want = exact_neighbours(rows)
    got = {}
    for r in neighbours.nearest(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2:] + x[1:2] for x in found] == sorted(x[2:] + x[1:2] for x in found)
        exact = {j: float(np.sqrt(np.square(points[q].astype(float) - points[j].astype(float)).sum())) for _, j, _ in found}
        assert all(abs(exact[j] - s) < 1e-12 for _, j, s in found)
        hits += len({j for j, _ in want[q]} & {x[1] for x in found})
    assert hits / (10 * len(want)) >= 0.9


def test_neighbours_cases(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0, 0.0) for i in range(0, 1200, 4)]  # one very common vector, in ties
    rows += [(1, None, 0, 0.0), (2, [], 0, 0.0), (3, [0.0] * 3, 0, 0.0), (5, [1.0, None, 2.0], 0, 0.0), (6, [1.0, float("nan"), 2.0], 0, 0.0), (None, same, 0, 0.0)]
    rows += [(7, [1.0, 2.0], 0, 0.0), (10_000, [1.0, 2.5], 0, 0.0), (20_000, [-900.0, 5.0, 1.0, 2.0], 0, 0.0)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact_neighbours(rows)
    assert got == {q: n for q, n in want.items() if n}
    assert neighbours.nearest(vectors(spark, rows).where("false")).count() == 0


def test_neighbours_far_from_the_origin_and_with_repeated_ids(spark, monkeypatch):
    """Rounding of large norms lost true neighbours; rows of one id crowded out the rest of a cell."""
    monkeypatch.setattr(neighbours, "STEP", 64)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16) * 1e7
    points = base + rng.standard_normal((400, 16)) * 0.05
    rows = [(i, p.tolist(), 0, 0.0) for i, p in enumerate(points)]
    rows += [(500, (points[0] + 1e-4 * rng.standard_normal(16)).tolist(), 0, 0.0) for _ in range(40)]
    rows += [(0, (points[0] + 0.01).tolist(), 0, 0.0)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows, "double")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 100, 200, 300, 500):
        own = [np.array(v) for i, v, *_ in rows if i == q]
        best = {}
        for i, v, *_ in rows:
            if i != q:
                best[i] = min(best.get(i, np.inf), *(float(np.sqrt(np.square(o - np.array(v)).sum())) for o in own))
        want = sorted((d, i) for i, d in best.items())[:10]
        assert got[q] == [(i, d) for d, i in want]


def test_probes_come_in_order_of_success():
    rng = np.random.default_rng(0)
    for _ in range(20):
        inside = rng.uniform(0, 1, 4)
        got = neighbours.probes(inside, 60)

        def cost(m):
            return sum(0.0 if d == 0 else (inside[k] - d - 1) ** 2 if d < 0 else (d - inside[k]) ** 2 for k, d in enumerate(m))

        every = sorted(cost([0 if d == 0 else d for d in m]) for m in itertools.product((-2, -1, 0, 1, 2), repeat=4))
        costs = [sum((inside[k] - d - 1) ** 2 if d < 0 else (d - inside[k]) ** 2 for k, d in enumerate(m) if d) for m in got]
        costs = [sum(((inside[k] + abs(d) - 1) ** 2 if d < 0 else (d - inside[k]) ** 2) for k, d in enumerate(m) if d) for m in got]
        assert costs == sorted(costs) and len({tuple(m) for m in got}) == 60 and len(every) == 625


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(pairs_near, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def near_texts(n=160, seed=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t) if rng.random() < 0.95 else rng.choice([None, "", " \n", "one two", "One TWO"]))
    return out


@pytest.mark.parametrize("block", [3, 8192])
def test_simhash_against_brute_force(spark, monkeypatch, block):
    if block == 3:  # workers read the module's value, so the small block is tried in this process
        return small_blocks(monkeypatch)
    texts = near_texts()
    docs = documents(spark, [(i, t, "e", "s", 0) for i, t in enumerate(texts)]).withColumn("fp", F.lit("own"))
    fps = [plain_fingerprint(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = classes_of(near, len(fps))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(fps))] == fps
    assert [got[i]["component_id"] for i in range(len(fps))] == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def small_blocks(monkeypatch):
    """Keys over the block size: set aside, then compared block against block."""
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = int(rng.integers(0, 2**60))
        fps = np.array(sorted({base ^ int(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7)))) for _ in range(14)}), np.uint64)
        n = len(fps)
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])
        cut = [batch.slice(0, 2), batch.slice(2, 5), batch.slice(7)]
        rows = [r for b in simhash._links(iter(cut)) for r in b.to_pylist()]
        links = [(r["a"], r["b"]) for r in rows if r["b"] is not None]
        aside = [(r["a"], r["block"]) for r in rows if r["b"] is None]
        assert sorted(a for a, _ in aside) == sorted(fps.view(np.int64).tolist())
        count = max(b for _, b in aside) + 1
        for i in range(count):
            for j in range(i, count):
                some = sorted(a for a, b in aside if b in (i, j))
                cols = [np.zeros(len(some), np.int64), np.full(len(some), i), np.full(len(some), j), np.array(some)]
                for b in simhash._block_links(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "i", "j", "fp"])])):
                    links += [(r["a"], r["b"]) for r in b.to_pylist()]
        place = {x: k for k, x in enumerate(fps.view(np.int64).tolist())}
        got = classes_of([(place[a], place[b]) for a, b in links], n)
        want = classes_of([(a, b) for a, b in itertools.combinations(range(n), 2) if int(fps[a] ^ fps[b]).bit_count() <= 4], n)
        assert got == want


def test_simhash_cases(spark):
    long = " ".join(f"word{i % 997}" for i in range(120_000))
    rows = [(4, None), (3, ""), (9, long), (9, long), (2, long + " x"), (None, long), (None, "only here, without an id"), (5, "a b"), (6, "A  B")]
    docs = documents(spark, [(i, t, "e", "s", 0) for i, t in rows])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 3), (3, 3), (9, 2), (9, 2), (2, 2), (None, 2), (None, None), (5, 5), (6, 5)], key=str)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["2", "3", "5", "None", "None"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [plain_shingles(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return classes_of(near, len(sets)), near


def varied_texts(n=160, seed=3):
    """Copies with up to six words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(25)]
    out = [None, "", " \n", "one two", "One  TWO"]
    while len(out) < n:
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("chars", [4000, 4_000_000])
def test_near_copies_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(near_copies, "BLOCK_CHARS", chars)  # the small one deals groups into blocks
    texts = varied_texts()
    docs = documents(spark, [(i, t, "e", "s", 0) for i, t in enumerate(texts)]).withColumn("tid", F.lit("own"))
    want, near = plain_groups(texts)
    kept = near_copies.keep_distinct(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert len(near) > 100


def plain_prints(text):
    hashes, out = [xxhash.xxh64_intdigest(" ".join(w)) for w in plain_shingles(text)], []
    for k in range(near_copies.PRINTS):
        mixed = [(h ^ int(near_copies._TURNS[k])) * int(near_copies._ODD[k]) % 2**64 for h in hashes]
        mixed = [(x ^ x >> 32) * int(near_copies._ODD[-1 - k]) % 2**64 for x in mixed]
        mixed = [x ^ x >> 29 for x in mixed]
        out.append(sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in mixed) > len(mixed)))
    return out


def test_near_copies_go_through_simhash(spark, monkeypatch):
    texts = varied_texts(90)
    found = [plain_prints(t) for t in texts]
    assert [[p % 2**64 for p in near_copies.prints(near_copies.shingles(t or ""))] for t in texts] == found
    # five bits in three segments leave one with a single bit, so these must meet; others may
    apart = {(a, b): min((x ^ y).bit_count() for x in found[a] for y in found[b]) for a, b in itertools.combinations(range(len(texts)), 2)}
    _, near = plain_groups(texts)
    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "tid long, text string")
    seen, candidates = [], near_copies.simhash_candidates
    monkeypatch.setattr(near_copies, "simhash_candidates", lambda signed: seen.append(candidates(signed)) or seen[-1])
    monkeypatch.setattr(near_copies, "band_candidates", lambda signed: signed.selectExpr("tid AS a", "tid AS b").where("false"))
    links = [tuple(sorted(r)) for r in near_copies.near_links(rows).collect()]
    assert set(links) <= set(near)  # the exact check follows
    group = classes_of(links, len(texts))
    reached = [pair for pair in near if apart[pair] <= 5]
    assert all(group[a] == group[b] for a, b in reached) and len(reached) > 20
    assert all(apart[tuple(sorted(r))] <= near_copies.MAX_BITS for r in seen[0].collect())


def test_near_copies_stage_reaches_the_similarity(spark, tmp_path):
    """A pair at 0.80-0.85 differs in more than four bits of a fingerprint, and stayed in the corpus."""
    texts = [t for t in varied_texts() if t and len(t) > 20]
    _, near = plain_groups(texts)
    sets = [plain_shingles(t) for t in texts]
    a, b = next((a, b) for a, b in near if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.85 and (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4)
    docs = documents(spark, [(1, texts[a], "e", "s", 0), (2, texts[b], "e", "s", 0), (None, texts[a], "e", "s", 0)])
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, str(tmp_path)).collect()} == {1, None}
    assert near_copies.keep_distinct(docs.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: k for k, x in enumerate(nodes)}
    want = classes_of([(place[a], place[b]) for a, b in edges if a != b], len(nodes))
    assert got == {x: nodes[want[place[x]]] for x in nodes}


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs, labels = toxic_corpus(spark, 120)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    stop = "the of and in to a is for was on".split()
    rng = random.Random(8)
    rows = []
    for i, t in enumerate(texts):
        words = t.split() + [rng.choice(stop) for _ in range(25)]
        rows.append((i, " ".join(words) + "\nAll rights of this text belong to the owner, page " + str(i) + "\n" + "last " + t[::-1], "e", f"s{i % 3}", 7))
    rows += [(500 + i, rows[i][1], "e", "s", 1) for i in range(5)] + [(900, "too short", "e", "s", 1), (901, None, None, None, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == table.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, after = now.collect(), (now := spark.read.parquet(path)).collect()
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            assert not any(i < 120 and i % 4 == 0 for i in ids) and {i for i in range(120) if i % 4} <= ids
        elif name == "quality_rules":
            assert ids == {r["doc_id"] for r in before if plain_counts(r["text"])[0] >= 50}
        elif name == "line_dedup":
            first = min(r["doc_id"] for r in before)
            assert all(("All rights" in r["text"]) == (r["doc_id"] == first) for r in after) and not ids & {500 + i for i in range(5)}
            assert all(r["n_chars"] == (len(r["text"]) if r["doc_id"] != first else 7) for r in after)
        else:
            fps = [plain_fingerprint(r["text"]) for r in before]
            near = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
            groups = classes_of(near, len(fps))
            assert sorted(ids) == sorted(min(r["doc_id"] for r, g in zip(before, groups, strict=True) if g == x) for x in set(groups))
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), now.collect())


def test_quality_stage_keeps_a_clean_long_document(spark, tmp_path):
    """A document of more than a million words was dropped for its length."""
    words = "transform(sequence(1, 1000001), i -> if(i % 4 = 0, 'the', translate(string(i), '0123456789', 'abcdefghij')))"
    docs = spark.sql(f"SELECT 1L AS doc_id, array_join({words}, ' ') AS text")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, str(tmp_path)).select("doc_id").collect()] == [1]


def test_pipeline_on_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
