"""Classifiers, URL filters, WARC and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import quality, toxicity, urls, warc

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["Gronk", "blarfy"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(1000, None), (1001, ""), (None, "gronk"), (1002, "word1 " * 20000), (1003, "blarfy"), (1003, "blarfy")]
    return spark.createDataFrame(docs + odd, "doc_id bigint, text string"), spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int"), {k: (q, t) for k, q, t in labels}, len(docs) + len(odd)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, known, n = labelled
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == known[r.doc_id][1] for r in held]) > 0.95
    assert {r.predicted for r in rows if r.doc_id in (1000, 1001)} == {0} and {r.predicted for r in rows if r.doc_id == 1003} == {1}


def test_held_out_labels_are_never_used(labelled):
    docs, labels, _, _ = labelled
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turned = labels.withColumn("toxic", F.when(fold % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.allclose(a.weights, b.weights, atol=1e-5)
    assert np.allclose(quality.train(docs, labels).weights, quality.train(docs, turned).weights)


def test_quality_on_held_out_rows(labelled):
    docs, labels, known, n = labelled
    rows = quality.quality_report(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert len(rows) == n and np.mean([r.predicted == known[r.doc_id][0] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    ranking = quality.train(docs, labels)
    assert ranking.score(np.array([quality.text_features(None)])).shape == (1,)


def test_labels_of_one_class_or_none(spark, labelled):
    docs = labelled[0]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_report(docs, none).collect()} == {0}
    assert {r.score for r in quality.quality_report(docs, none).collect()} == {0.0}
    good = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_report(docs, good).collect()} == {1}
    assert {r.score for r in quality.quality_report(docs, good).collect()} == {1.0}
    assert toxicity.toxicity_report(docs.where("1 = 0"), labelled[1]).collect() == []


def dense_toxicity(rows):
    """An independent fit: dense matrix of n-gram sets, the same loss, minimised by plain gradient steps; the scores of all texts."""
    def grams(text):
        t = f" {text.lower()} "
        return {t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    y = np.array([label for _, label in rows])
    sets = [grams(t) for t, _ in rows]
    names = sorted(set().union(*sets))
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, s in enumerate(sets):
        x[i, [place[g] for g in s]] = 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    c1, c0 = x[y == 1].sum(0), x[y == 0].sum(0)
    r = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    r[(c1 + c0 < 3) | (np.abs(r) < 1)] = 0
    x = x * r / np.sqrt(np.median([len(s) for s in sets]))
    w, b, weight = np.zeros(len(names)), 0.0, np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(3000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= 2.0 * (x.T @ g + 1e-3 * w)
        b -= 2.0 * g.sum()
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_toxicity_agrees_with_a_dense_fit(labelled):
    docs, labels, known, _ = labelled
    learned = [r for r in docs.where("doc_id < 600").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    want = dense_toxicity([(r.text, known[r.doc_id][1]) for r in learned])
    model = toxicity.train(docs, labels)
    got = np.array([1 / (1 + np.exp(-(model.bias + model.weights[toxicity.ngram_ids(r.text)].sum()))) for r in learned])
    assert ((got >= 0.5) == (want >= 0.5)).mean() > 0.99 and np.corrcoef(got, want)[0, 1] > 0.97


def test_ngrams_are_counted_once_a_document():
    text = "Abcabc"
    grams = {f" {text.lower()} "[i:i + n] for n in toxicity.ORDERS for i in range(len(text) + 3 - n)}
    assert len(toxicity.ngram_ids(text)) == len(grams) == len(toxicity.ngram_ids(text, seen=np.zeros(1 << toxicity.BITS, np.int32)))


def test_samples_are_bounded_in_bytes_and_rows(spark, labelled):
    from attesta.llm.labels import label_sample, labelled_texts

    docs = spark.createDataFrame([(i, "x" * (i % 90), "extra") for i in range(100)] + [(7, "again" * 30, "e")] * 50, "doc_id bigint, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    sample, _ = label_sample(labels, "toxic", 1000, 5, 0)
    rows = labelled_texts(docs, sample, 700).collect()
    assert len({r._doc for r in rows}) == len(rows) and all(sum(len(r._text) for r in rows if r.y == y) <= 700 for y in (0, 1))
    assert len(labelled_texts(docs, sample, 0).collect()) == 2 and len(labelled_texts(docs, sample, 1 << 20).collect()) == sample.count()
    one = toxicity.train(*labelled[:2], class_bytes=0)
    assert np.isfinite(one.weights).all()


def test_quality_agrees_with_plain_gradient_steps():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 4))
    y = (x @ [1, -2, 0.5, 0] + rnd.normal(size=300) > 0.3).astype(int)
    ranking = quality.fit_pairs(x, y, y.mean())
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, 4)  # every preference pair
    w = np.zeros(4)
    for _ in range(2000):
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-3 * w)
    assert np.corrcoef(z @ w, ranking.raw(x))[0, 1] > 0.99
    assert abs((ranking.score(x) >= 0.7).mean() - y.mean()) < 0.05
    far = x[:1].copy()
    far[0, 1] = 1e9  # one outlying feature scores like 8 deviations
    assert ranking.raw(far) == pytest.approx(np.clip((far - ranking.mean) / ranking.scale, -8, 8) @ ranking.weights)


def test_scores_with_clashing_columns_and_empty_tables(spark, labelled):
    docs, labels = labelled[:2]
    odd = docs.selectExpr("*", "'a' as score", "1 as _doc", "2 as _text", "3 as y", "4 as _score")
    for report, keep, plain in ((toxicity.toxicity_report, toxicity.drop_toxic, toxicity), (quality.quality_report, quality.keep_quality, quality)):
        assert sorted(report(odd, labels).collect(), key=str) == sorted(report(docs, labels).collect(), key=str)
        assert keep(odd, labels).columns == odd.columns and keep(odd, labels).count() == keep(docs, labels).count()
        assert report(docs.where("1 = 0"), labels).collect() == [] and keep(odd.where("1 = 0"), labels).collect() == [], plain


def test_rules_and_hosts(spark):
    rows = [
        (1, "https://WWW.Example.NET/en/a?b#c", None), (2, "http://example.net/fr/", None), (3, "http://a.example.com/de/x", ""), (4, "http://a.example.com/en/x", '<a href="http://good.org/fr/1">'), (5, "http://good.org/fr/1", None),
        (6, None, None), (7, "no scheme", None), (8, "http://x.net", None), (9, "http://planet/", None), (10, "http://notexample.net/en/", None), (10, "http://notexample.net/en/", None),
    ]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 6, 7)] == [("www.example.net", "/en/a", "example.net/en/"), ("", "", None), ("", "", None)]
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 5, 10)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]
    assert got[8].rule is None and got[9].rule is None and got[6].verdict == "allow"
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_trust_and_distrust_follow_links(spark):
    hosts = spark.createDataFrame([("good", 1, 1, 0), ("bad", 1, 0, 1), ("mid", 1, 0, 0), ("spam", 1, 0, 0)], "host string, pages bigint, allowed bigint, blocked bigint")
    edges = spark.createDataFrame([("good", "mid", 1), ("spam", "bad", 3), ("mid", "end", 1)], "src string, dst string, n bigint")
    got = {r.host: r for r in urls.propagate(hosts, edges).collect()}
    damp = 0.85**2  # brute force over this chain: mid gets good's trust, spam gets bad's distrust
    assert got["mid"].trust > 0.3 and got["mid"].distrust == 0 and got["spam"].distrust > 0.3 and got["spam"].trust == 0
    assert got["good"].trust == pytest.approx(1) and got["bad"].distrust == pytest.approx(1) and 0 < got["end"].trust <= damp


def test_host_edges_of_mixed_html(spark):
    html = """<a href="/in">x</a><a HREF='?q=1'><img alt="a > b" src="img/a.png"><script src=//CDN.org/x.js></script><form action="https://b.com/go"><a data-href="http://no.net/" href="http://b.com/">
    <a href="mailto:a@c.com"><p>href="http://text.net/"</p>"""
    pages = spark.createDataFrame([(1, "http://a.com/", html), (2, "http://a.com/2", "<a href=/z>"), (3, "http://d.com/", None), (4, None, "<a href=/z>")], "page_id bigint, url string, html string")
    assert {(r.src, r.dst): r.n for r in urls.host_edges(pages).collect()} == {("a.com", "a.com"): 4, ("a.com", "cdn.org"): 1, ("a.com", "b.com"): 2}


def test_derivatives_link_back(spark):
    rows = [(1, "http://a/", "<html><script>x<y</script><p>A &amp;lt; B</p><!-- c --></html>"), (2, None, None), (2, None, None), (3, "http://b/", "é" * 50000)]
    source = warc.responses(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    made = warc.warc_text(warc.derivatives(source)).collect()
    ids = {r.record_id: r for r in source.collect()}
    assert len(made) == 8 and all(ids[r.refers_to].payload_digest == r.source_payload_digest and r.record_id != r.refers_to for r in made)
    text = next(r for r in made if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "A &lt; B" and f"WARC-Refers-To: {text.refers_to}" in text.warc and "Content-Length: 8\r\n" in text.warc
    facts = next(r for r in made if r.page_id == 1 and r.warc_type == "metadata")
    assert "source-header: Content-Type=text/html; charset=utf-8" in facts.block


def test_derivatives_carry_the_headers_and_dates_of_their_input(spark):
    pages = spark.sql("select 1L as page_id, 'http://a/' as url, '<p>x' as html, map('Content-Type', 'text/x', 'Server', 's') as h, timestamp'2020-02-03 04:05:06' as t union all select 2L, null, null, null, null")
    source = warc.responses(pages, headers_column="h", date_column="t")
    made = warc.derivatives(source.selectExpr("*", "'k' as warc_type", "'b' as block", "7 as crawl")).collect()
    assert len(made) == 4 and made[0].asDict().keys() >= {"page_id", "crawl", "warc_type", "block"} and {r.warc_type for r in made} == {"metadata", "conversion"}
    facts = {r.page_id: r for r in made if r.warc_type == "metadata"}
    assert facts[1].date == "2020-02-03T04:05:06Z" and facts[1].source_headers == {"Content-Type": "text/x", "Server": "s"} and "source-header: Server=s\r\n" in facts[1].block
    assert facts[2].date == "2024-01-01T00:00:00Z" and facts[2].source_headers["Content-Length"] == "0"
    assert warc.derivative_report(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_url_verdicts_against_brute_force(spark):
    rnd = random.Random(5)
    names = ["a.net", "b.net", "example.net", "x.example.net", "example.com", "w.example.com", "good.org", "c.io", "d.io", "e.io", "f.io", "planet"]
    rows = []
    for i in range(150):
        links = "".join(f'<a href="http://{rnd.choice(names)}/{rnd.choice(["en/", "fr/", ""])}">' for _ in range(rnd.randint(0, 4)))
        rows.append((i, f"http://{rnd.choice(names)}/{rnd.choice(['en/', 'de/', 'fr/', ''])}{'long/' * (2000 if i == 3 else 0)}{i}?q#f", links))
    rows += [(i, None, "<a href=//c.io/>") for i in (200, 200)]

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit) if fit else None

    hosts = {n: [0, 0, 0] for n in names}
    links = {}
    for _, url, html in rows:
        host, _, rule = judged(url)
        if host:
            hosts[host][0] += 1
            hosts[host][1 if rule and rule[2] == "allow" else 2] += rule is not None
            for target in html.split('href="http://')[1:]:
                links[host, target.split("/")[0]] = links.get((host, target.split("/")[0]), 0) + 1
    share = {}
    for way in (1, 2):
        edges = {(a, b) if way == 1 else (b, a): n for (a, b), n in links.items()}
        move = np.zeros((len(names), len(names)))
        for i, a in enumerate(names):
            total = sum(n for (x, _), n in edges.items() if x == a)
            if not total:
                move[i, i] = 1
            for j, b in enumerate(names):
                if (a, b) in edges:
                    move[i, j] += edges[a, b] / total
        seed, base = (np.array([hosts[n][k] for n in names], float) for k in (way, 0))
        s, t = seed, base
        for _ in range(12):
            s, t = 0.15 * seed + 0.85 * s @ move, 0.15 * base + 0.85 * t @ move
        share[way] = dict(zip(names, np.where(t > 0, s / np.maximum(t, 1e-300), 0), strict=True))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as host", "'y' as rule", "1 as trust", "2 as src")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(rows)
    by_url = {r[0]: r[1] for r in rows}
    seen = set()
    for r in got:
        host, path, rule = judged(by_url[r.page_id])
        method = "block" if host and share[2][host] - share[1][host] > 0.5 + 1e-9 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], rule[2] if rule else method)
        assert not host or (r.trust, r.distrust) == (pytest.approx(share[1][host], abs=1e-5), pytest.approx(share[2][host], abs=1e-5))
        seen.add((r.rule is None, r.verdict))
    assert len(seen) >= 3
    tie = [("block", "x.io", "/a/"), ("allow", "io", "/a/")]
    assert [r.verdict for r in urls.filter_urls(spark.createDataFrame([(1, "http://x.io/a/b", None)], "page_id bigint, url string, html string"), tie).collect()] == ["block"]


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, DATA).cache()
        assert step.columns == docs.columns and step.count() <= before.count(), name
    assert set(rows) == {r.doc_id for r in step.select("doc_id").collect()}
    insults = lambda df: df.where(F.col("text").rlike(r"(?i)\b(moron|idiot|scum)\b")).count()
    assert insults(step) < 0.1 * insults(docs)
