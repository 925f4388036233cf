import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from framequorum.llm import langid, toxicity, urls

from .conftest import prose

BAD = ["grubnok", "wezzlepot", "snarfic"]


def _text(rng, toxic):
    words = prose(rng.randrange(10**6), rng.randrange(20, 90)).split()
    for _ in range(max(1, len(words) // 25) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    y = np.array([i % 4 == 0 for i in range(400)], dtype=np.int64)
    return toxicity.SubwordSoftmax(rounds=60).fit([_text(rng, t).encode() for t in y], y).scorer()


def scores(model, texts):
    b = [t.encode() for t in texts]
    return model(np.frombuffer(b"".join(b), np.uint8), np.r_[0, np.cumsum([len(x) for x in b])].astype(np.int64))


def test_held_out_toxicity(model):
    rng = random.Random(77)
    bad, good = scores(model, [_text(rng, True) for _ in range(100)]), scores(model, [_text(rng, False) for _ in range(100)])
    assert (bad >= 0.5).mean() >= 0.95 and (good >= 0.5).mean() <= 0.05


def test_misspellings_share_subwords(model):
    s = scores(model, [prose(5, 20) + " grubnokk", prose(5, 20) + " wezzlepott", prose(5, 20)])
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5


def test_one_insult_in_a_long_text_is_seen(model):
    assert scores(model, [prose(6, 3000) + " snarfic " + prose(7, 3000)])[0] > 0.5


def test_texts_do_not_influence_each_other(model):
    texts = [prose(1, 40), "", "snarfic", prose(2, 5)]
    assert np.allclose(scores(model, texts), [scores(model, [t])[0] for t in texts])


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, None), (None, 1, 1), (8, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (3, 4, 7))
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect() if r.doc_id == 4} == {0.01}


LATIN = {"xx": "kana kiri taku moshi nara", "yy": "grund straat wijk zeer haast", "zz": "pelo luna casa verde ojo"}


def _docs(spark, n=90):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(LATIN)[i % 3]
        rows.append((i, " ".join(rng.choice(LATIN[lang].split()) for _ in range(30)), lang, f"{lang}.host"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language(spark):
    docs = _docs(spark)
    out = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    assert all(out[r.doc_id].language == r.lang and out[r.doc_id].accepted for r in docs.collect())


def test_every_label_is_fitted(spark):
    """More labels than LANGUAGES, the last of them the rarest."""
    rows = [(100 * k + i, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} " * 9, f"l{k:02}") for k in range(70) for i in range(1 + (k < 69))]
    model = langid.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:02}" for k in range(70)] + ["und"]


def test_a_short_text_follows_its_host(spark):
    docs = _docs(spark).unionByName(spark.createDataFrame([(900, "a", None, "yy.host"), (901, "a", None, "zz.host")], "doc_id long, text string, lang string, source string"))
    out = {r.doc_id: r.language for r in langid.identify_documents(docs).collect()}
    assert (out[900], out[901]) == ("yy", "zz")


def test_markup_suffix_and_host_speak_for_pages(spark):
    docs = _docs(spark)
    page = lambda i, lang, body, host: (i, f"https://{host}/p", f'<html lang="{lang}-US"><script>x</script><p>{body}</p></html>')
    pages = [page(i, lang, LATIN[lang], f"a.site.{lang}") for i, lang in enumerate(list(LATIN) * 8)] + [page(100, "zz", "a", "new.site.zz"), (101, None, None)]
    out = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert all(out[i].language == lang for i, lang in enumerate(list(LATIN) * 8)) and out[100].language == "zz" and not out[101].accepted


def test_declared_language(spark):
    df = spark.createDataFrame([('<html lang="de-AT">',), ("<HTML LANG=fr>",), ("<html data-x='1' lang = 'es'>",), ("<p lang='it'>",), (None,)], "t string")
    assert [r[0] for r in df.select(langid.declared(F.col("t"))).collect()] == ["de", "fr", "es", None, None]


def test_language_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in langid.identify_documents(odd).collect()}
    assert all(rows[i].language == "und" and not rows[i].accepted for i in (3, 4, 7)) and rows[1].accepted
    kept = langid.accepted_documents(odd)
    assert kept.columns == odd.columns and {1, 2, 5} <= {r.doc_id for r in kept.collect()}
    assert langid.identify_documents(none).count() == 0
    assert {r.language for r in langid.identify_documents(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_rejected_row_takes_no_other_with_it(spark):
    clean = _docs(spark)
    more = [(None, clean.first().text, "xx", "xx.host"), (None, "", None, None), (1, "", None, None), (1, "12 34", None, "yy.host")]
    kept = langid.accepted_documents(clean.unionByName(spark.createDataFrame(more, clean.schema)))
    assert sorted(map(str, kept.collect())) == sorted(map(str, [*clean.collect(), Row(**dict(zip(clean.columns, more[0], strict=True)))]))
    assert kept.where("doc_id is null").count() == 1


URLS = {
    "http://a.net": ("a.net", "", None), "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/"), "x://net/": ("net", "/", "net/"), "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/"),
    "http://anet/": ("anet", "/", None), "https://b.org/fr/": ("b.org", "/fr/", "org/fr/"), "https://b.org/en/#://c.net/": ("b.org", "/en/", None), "nothing": ("", "", None), "": ("", "", None), "http://h?p://x/": ("h", "", None), "http://É.org/fr/a\nb": ("É.org", "/fr/a\nb", "org/fr/"),
}


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(99, None)], "page_id long, url string")
    rows = {r.page_id: r for r in urls.filter_urls(df).collect()}
    for i, (host, path, rule) in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        if rule:
            assert rows[i].verdict == {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[rule]
    assert rows[99].host == rows[99].path == "" and rows[99].verdict in ("allow", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    """One url, repeated beyond the bound, with the lowest hash of all: the trees still see both kinds."""
    two = [f"http://a{i}.net/" for i in range(30)] + [f"http://b{i}.org/fr/" for i in range(30)]
    low = spark.createDataFrame([(u,) for u in two], "url string").orderBy(F.xxhash64("url")).first().url
    rows = [*two, *[low] * 60, "http://a99.net", "http://b99.org/en/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    out = {r.page_id: r for r in urls.filter_urls(df, train_rows=50).collect()}
    assert len(out) == len(rows) and (out[120].verdict, out[121].verdict) == ("block", "allow")


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.3)).astype(float)
    t = urls.BoostedTrees().fit(x[:1000], y[:1000])
    assert ((t.logits(x[1000:]) > 0) == y[1000:]).mean() > 0.95


def test_url_model_on_held_out_hosts():
    rng = random.Random(2)
    make = lambda bad: (f"http://{'buy-cheap-' * bad}{rng.randrange(10**6)}.example/{'x/' * rng.randrange(1, 4)}" + ("?a=1&b=2&c=3" if bad else ""), 0)
    data = [(make(b)[0], b) for b in [0, 1] * 300]
    parts = [((u, u.split("/")[2], "/" + "/".join(u.split("?")[0].split("/")[3:])), b) for u, b in data]
    model = urls.UrlModel.fit([p for p, _ in parts[:400]], [b for _, b in parts[:400]])
    assert ((model.block_probability([p for p, _ in parts[400:]]) >= 0.5) == np.array([b for _, b in parts[400:]])).mean() > 0.95


def test_posterior_is_the_products_of_the_evidence(spark):
    """Every factor by a plain loop: smoothed host prior, text, suffix and markup, without the row's own share."""
    import math

    names = ["a", "b", langid.UNKNOWN]
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        loglik = rng.normal(size=3) * 2
        share = np.exp(loglik - loglik.max())
        share /= share.sum()
        domain = ["x.de", "y.fr", None][i % 3]
        rows.append((i, None if domain is None else f"h{i % 2}.{domain}", domain, None if domain is None else domain[-2:], ["a", "b", None, None][i % 4], loglik.tolist(), share.tolist(), 5))
    df = spark.createDataFrame(rows, "id long, host string, domain string, suffix string, markup string, loglik array<double>, share array<double>, trigrams long")
    got = {r.id: r for r in langid.fuse(df, names, 0.5).collect()}
    corpus = [sum(r[6][k] for r in rows) for k in range(3)]
    for i, host, domain, suffix, markup, loglik, share, _ in rows:
        prior = [(c + 1) / (len(rows) + 3) for c in corpus]
        for at, own in ((2, domain), (1, host)):
            if own is not None:
                same = [r for r in rows if r[at] == own and r[0] != i]
                prior = [(sum(r[6][k] for r in same) + langid.STRENGTH * prior[k]) / (len(same) + langid.STRENGTH) for k in range(3)]
        logit = [loglik[k] + math.log(prior[k]) for k in range(3)]
        for at, own in ((3, suffix), (4, markup)):
            if own is not None:
                same = [r for r in rows if r[at] == own and r[0] != i]
                logit = [x + math.log((sum(r[6][k] for r in same) + 0.5) / (corpus[k] + 1)) for k, x in enumerate(logit)]
        mass = [math.exp(x - max(logit)) for x in logit]
        assert got[i].language == names[logit.index(max(logit))] and abs(got[i].confidence - 1 / sum(mass)) < 1e-5


def test_sampled_counts_are_the_texts(spark):
    """The sums that executors send are those of the sampled texts: with few rows, of all."""
    rows = [(i, prose(i, 30), "en") for i in range(20)] + [(100 + i, prose(i, 30).replace("e", "ö"), "de") for i in range(20)]
    model = langid.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    want = langid.TrigramModel.fit([t.encode() for _, t, _ in rows], [x for _, _, x in rows])
    assert model.languages == want.languages and np.allclose(model.log_probs, want.log_probs)
