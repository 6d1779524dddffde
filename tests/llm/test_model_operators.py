"""Language ID, toxicity, HTML extraction and vectors: brute force, planted cases, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import langid, metric_join, string_kernel, style_tree
from tests.llm.helpers import frame
from tests.llm.test_text_operators import brute_components


# ---------------------------------------------------------------- language ID

@pytest.mark.parametrize("langs,switch", [(2, 1.0), (3, 2.5), (5, 0.0)])
def test_viterbi_equals_plain_recursion(langs, switch):
    r = np.random.default_rng(langs)
    sizes = [0, 1, 2, 63, 64, 65, 128, 0, 200, 7, 0]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores = r.normal(0, 2, (first[-1], langs)).astype(np.float32)
    label = langid.viterbi(scores, first, switch)
    for a, z in zip(first[:-1], first[1:]):
        if z > a:
            x = scores[a:z].astype(float)
            v = x[0]
            for t in range(1, len(x)):
                v = np.maximum(v, v.max() - switch) + x[t]
            got = label[a:z]
            assert abs(x[np.arange(len(x)), got].sum() - switch * (got[1:] != got[:-1]).sum() - v.max()) < 1e-2


SPEECH = {"en": "the house and the garden were with that thing which they had when",
          "de": "und der nicht ein schöner garten mit dem haus das sich über", "el": "και το σπίτι με τον κήπο που είναι εδώ"}


def speech(lang, r, n=30):
    w = SPEECH[lang].split()
    return " ".join(r.choice(w) for _ in range(n))


def test_viterbi_of_many_languages():
    want = np.repeat([199, 3, 150], 90)
    scores = np.zeros((len(want), 200), np.float32)
    scores[np.arange(len(want)), want] = 5
    assert langid.viterbi(scores, np.array([0, 200, len(want)]), 2.0).tolist() == want.tolist()


def test_language_id(spark):
    r = random.Random(1)
    rows = [(i, speech(lang, r), lang) for i, lang in enumerate(list(SPEECH) * 20)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "no lang", None), (None, "x", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "el", "en"]
    mixed = speech("en", r) + " " + speech("de", r, 40) + " " + speech("en", r, 25)
    odd = [(1, None), (2, ""), (3, "12 -- !"), (4, "12 €"), (5, mixed), (6, speech("el", r)), (6, speech("el", r)), (None, speech("en", r)), (7, "漢字")]
    got = langid.identify(frame(spark, odd), model)
    assert "h1" in got.columns
    rows = {(x["doc_id"], x["text"]): x for x in got.collect()}
    assert all(rows[i, t]["lang_pred"] == "und" and rows[i, t]["score"] == 0 and rows[i, t]["spans"] == [] for i, t in odd[:4])
    assert [(s["lang"], s["start"], s["end"]) for s in rows[5, mixed]["spans"]] == [("en", 0, 30), ("de", 30, 70), ("en", 70, 95)]
    assert rows[5, mixed]["lang_pred"] == "de" or rows[5, mixed]["lang_pred"] == "en"
    assert rows[6, odd[5][1]]["lang_pred"] == "el" and rows[None, odd[7][1]]["lang_pred"] == "en"
    assert langid.train(docs.where("false")) is None
    assert {x["lang_pred"] for x in langid.identify(frame(spark, odd, False), None).collect()} == {"und"}
    assert langid.identify(frame(spark, [], False), model).collect() == []


def test_language_id_held_out(spark):
    from caseflow.llm.queries import op9_language_id

    d = "/root/testdata/sf0.01"
    r = op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n = r.where("held_out").count()
    assert n > 100 and r.where("held_out and lang = lang_pred").count() >= 0.98 * n


# ---------------------------------------------------------------- toxicity

def test_kernel_values_equal_the_plain_kernel():
    """Decision values from the triple table are the kernel expansion, word by word."""
    words = sorted(string_kernel.words_of("trash idiot queen xylophone a bb of extraordinary"))
    z = sorted(string_kernel.words_of("idiot stupid queue"))

    def plain(x, y):
        def triples(w):
            s, out = [0, *w, 0], Counter()
            for i in range(len(s)):
                for k in range(i + 2, min(len(s), i + string_kernel.SPAN)):
                    for j in range(i + 1, k):
                        out[s[i], s[j], s[k]] += string_kernel.DECAY ** (k - i + 1)
            return out
        p, q = triples(x), triples(y)
        norm = lambda w: float(string_kernel._norms(np.array([len(w) + 2]))[0])
        return sum(v * q[t] for t, v in p.items()) / norm(x) / norm(y)

    alpha, table = [0.7, -1.3, 0.4], np.zeros(64 ** 3, np.float32)
    for a, (t, v) in zip(alpha, string_kernel._features(z), strict=True):
        table[t] += a * v
    at, got = string_kernel.word_values(string_kernel._stack(words), table)
    assert len(at) == len(words)
    assert np.allclose(got, [sum(a * plain(w, y) for a, y in zip(alpha, z)) for w in words], atol=1e-4)


def test_joined_letters_and_marks():
    assert string_kernel.words_of("i.d-i o t") == string_kernel.words_of("idi o t")
    assert string_kernel.words_of("x i d i o t") == string_kernel.words_of("xidiot")
    s, begins = string_kernel.symbols(pa.array(["a b", None, "", "c"]))
    assert len(begins) == 5 and [int(s[b]) for b in begins] == [0] * 5


def toxic_rows(n=300):
    r = random.Random(2)
    fine = "the that with then thing this and ring string table stable other under over house".split()
    rows = []
    for i in range(n):
        w = [r.choice(fine) + r.choice(["", "s", "ing", "er"]) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["grobnak", "plimoff", "vexulor"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    labelled = spark.createDataFrame([*rows, (900, None, 1), (901, "x", None), (None, "y", 1)], "doc_id long, text string, toxic int")
    model = string_kernel.train(labelled, labelled)
    new = [(1, "the house and a GROBNAK here"), (2, "the thing with p-l.i m o f f under"), (3, "over grobxnak table"), (4, "over vexullor table"),
           (5, "the house and the ring"), (6, None), (7, ""), (8, "?! 12"), (8, "?! 12"), (None, "stable string")]
    got = string_kernel.toxicity(frame(spark, new), model).collect()
    by = {x["doc_id"]: x["score"] for x in got}
    assert len(got) == len(new) and all(0 <= x["score"] <= 1 for x in got)
    assert min(by[1], by[2], by[4]) > 0.5 > max(by[5], by[6], by[7], by[8], by[None]) and by[3] > 10 * by[5]
    assert string_kernel.train(labelled, labelled.where("toxic = 0")) is None
    assert {x["score"] for x in string_kernel.toxicity(frame(spark, new, False), None).collect()} == {0.0}
    assert string_kernel.toxicity(frame(spark, [], False), model).collect() == []


def test_other_documents_labels_are_not_learned(spark, monkeypatch):
    shares = []
    monkeypatch.setattr(string_kernel, "fit", lambda texts, toxic, share: shares.append(share))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(8)] + [(i, 1) for i in range(50, 60)], "doc_id long, toxic int")
    string_kernel.train(docs, labels)
    assert shares == [0.25]


# ---------------------------------------------------------------- HTML

def page(i, body, menu="Home News About"):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><script>var x='<p>no</p>';</script></head><body><nav><a>{menu}</a></nav>"
            f"<div class='box'>Always the same line</div><div class='post'>{body}</div><form><input>send</form>"
            f"<div id='comments'>reader {i}</div><footer>&copy; site</footer></body></html>")


def test_style_tree_drops_what_never_changes(spark):
    rows = [(i, f"http://a.org/{i}", page(i, f"<p>Own &amp; text <b>no {i}</b>\n of<br>page<p>next</p>")) for i in range(8)]
    rows += [(20, "http://b.org/", page(20, "only")), (21, None, "x &lt;b&gt; <i>y</i>z"), (22, "u", None), (23, "u", ""),
             (23, "u", ""), (None, "http://a.org/0", rows[0][2]), (24, "c", "<p>open <b>bold<div>1 < 2</div><a href='>'>q</a><!-- no")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as nodes", "'t' as text")
    got = {x["page_id"]: x["text"] for x in style_tree.main_text(df).collect()}
    assert got[3] == "Own & text no 3 of\npage\nnext" and got[None] == "Own & text no 0 of\npage\nnext"
    assert got[20] == "Always the same line\nonly"
    assert got[21] == "x <b> yz" and got[22] == "" and got[23] == "" and got[24] == "open bold\n1 < 2\nq"
    assert style_tree.main_text(df.where("false")).collect() == []


def test_copies_of_an_article_stay(spark):
    html = "<html><body><article><h1>T</h1><p>body</p><section class='comments'>x</section></article></body></html>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", html) for i in range(9)], "page_id long, url string, html string")
    assert {x["text"] for x in style_tree.main_text(df).collect()} == {"T\nbody"}


def test_copies_without_an_article_stay(spark):
    """Three copies are no menu, nor are 85 copies of a page beside 15 others; a page of nothing but a menu line keeps it."""
    site = lambda host, bodies: [(i, f"http://{host}/{i}", f"<html><head><title>{i}</title></head><body><div class='box'>Same</div>"  # noqa: E731
                                  f"<div class='post'><p>{b}</p></div></body></html>") for i, b in enumerate(bodies)]
    rows = [(100 + i, u, h) for i, u, h in site("three.org", ["copy"] * 3)]
    rows += [(200 + i, u, h) for i, u, h in site("many.org", ["copy"] * 85 + [f"own {k}" for k in range(15)])]
    rows += [(300, "http://many.org/x", "<html><body><div class='box'>Same</div></body></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {x["page_id"]: x["text"] for x in style_tree.main_text(df).collect()}
    assert [got[100 + i] for i in range(3)] == ["Same\ncopy"] * 3
    assert [got[200 + i] for i in range(100)] == ["copy"] * 85 + [f"own {k}" for k in range(15)] and got[300] == "Same"


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='no-sidebar'", "div class='page sticky-header'",
                                     "div class='post comments-open'", "div class='sidebar'", "form id='aspnet'"])
def test_wrappers_are_no_noise(wrapper):
    names = ["section id='related-work'", "p class='legal'", "section id='search-algorithms'", "div class='no-ads'"]
    inner = "".join(f"<{x}>text {k}</{x.split()[0]}>" for k, x in enumerate(names))
    noise = ("<div class='comments'>c</div><div class='x cookie-notice'>n</div><div id='sidebar'>s</div><aside><article>a</article></aside>"
             "<div class='comments'><article class='comment'>d</article></div>")
    want = "\n".join(f"text {k}" for k in range(len(names)))
    for tag in ("article", "main", "div"):
        # outside an article a paragraph's name counts
        html = f"<body><{wrapper}><{tag}>{inner.replace(' class=' + repr('legal'), '') if tag == 'div' else inner}</{tag}>" + (noise if tag != "div" else "") + f"</{wrapper.split()[0]}></body>"
        b = pa.RecordBatch.from_pydict({"html": [html], "nodes": pa.array([None], pa.list_(pa.string()))})
        got = next(style_tree._extract([])(iter([b]))).column("text")[0].as_py()
        assert got == want, tag
    html = f"<body><div class='post'>{inner}</div>{noise}<div hidden><article>h</article></div></body>"
    b = pa.RecordBatch.from_pydict({"html": [html], "nodes": pa.array([None], pa.list_(pa.string()))})
    assert "text 0\n" in next(style_tree._extract([])(iter([b]))).column("text")[0].as_py() and "h" not in [t for _, n, _, t in style_tree.parse(html).texts if not n]


@pytest.mark.parametrize("html,want", [
    ("<article><div class='share-buttons'>Share on X</div><p>Body</p><div class='author-bio'>A. U.</div>"
     "<div class='post-comments'>nice</div></article>", "Body"),
    ("<body><div class='newsletter'><h3>Subscribe now</h3></div><form><p>Your email</p><input></form></body>", ""),
    ("<body><div class='cookie-notice'><p>We use cookies</p></div></body>", ""),
    ("<body><section class='comments'><article class='comment'>c</article><section id='reply'>r</section></section></body>", ""),
    ("<body><form id='aspnet'><h1>Title</h1><div>text</div></form></body>", "Title\ntext"),
    ("<body><div class='article-header'><h1>T</h1></div><div class='site-header'>S</div><p>b</p></body>", "T\nb"),
    ("<div>" * 300 + "deep<p>er" + "</div>" * 300, "deep\ner"),
    ("<body><p>" + "long words " * 60_000 + "</p></body>", ("long words " * 60_000).strip())])
def test_meaning_of_single_pages(spark, html, want):
    df = spark.createDataFrame([(1, "http://a.org/1", html)], "page_id long, url string, html string")
    assert [x["text"] for x in style_tree.main_text(df).collect()] == [want]


def site_pages():
    """Two hosts whose articles hold bars, boxes and notes of neutral names; layouts differ and pages repeat."""
    r, rows = np.random.default_rng(5), []
    for i in range(60):
        host = "big.org" if i % 3 else "small.org"
        k = 3 if i % 10 == 9 else i  # copies
        own = [f"own {k} {j} " + "word " * int(r.integers(1, 30) if k == i else 4) for j in range(1 + k % 3)]
        html = ("<html><body><div class='t1'>Site name</div><article><div class='x1'>Share on <i>X</i></div>" + "<section>" * (k % 2)
                + "".join(f"<p>{o}</p>" for o in own) + "</section>" * (k % 2) + (f"<div class='rel'><span>See also</span><div>{k % 2}</div></div>")
                + "<h2>Written by the desk</h2></article>" + "<div class='low'><p>All rights</p><p>Contact us</p></div>" + f"<div class='foot'>{k % 3}</div></body></html>")
        rows.append((i, f"http://{host}/{i}", html))
    return rows


def brute_texts(rows, least):
    """The style tree with plain loops: every branch's nodes are looked up one by one."""
    out, hosts = {}, {}
    for i, url, html in rows:
        hosts.setdefault(url.split("/")[2], []).append((i, style_tree.parse(html)))
    for pages in hosts.values():
        distinct = {}
        for _, dom in pages:
            own = {}
            for path, noise, _, text in dom.texts:
                if not noise:
                    own.setdefault(path, []).append(" ".join(text.split()))
            distinct.setdefault(tuple((p, tuple(t)) for p, t in own.items()), (own, dom.children))
        facts = []  # (path, is text, pages, weight, entropy)
        for kind in (0, 1):
            for path in {p for d in distinct.values() for p in d[1 - kind]}:
                values = [" ".join(d[0][path]) if kind else ",".join(d[1][path]) for d in distinct.values() if path in d[1 - kind]]
                n = len(values)
                h = -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0
                facts.append((path, kind, sum(map(len, values)) if kind else n, (0.5 + h * n) / (0.5 + n)))
        total = sum(w * h for _, kind, w, h in facts if kind)
        drop = set()
        for top in {p[:k] for p, *_ in facts for k in [*(j for j, c in enumerate(p) if c == "/"), len(p)]}:
            below = [(p[len(top):].count("/"), kind, w, h) for p, kind, w, h in facts if p == top or p.startswith(top + "/")]
            weight = sum(w * 0.9 ** d for d, _, w, _ in below)
            if sum(w * h * 0.9 ** d for d, _, w, h in below) / weight < least and sum(w * h for _, kind, w, h in below if kind) <= total / 2:
                drop.add(top)
        for i, dom in pages:
            own = [x for x in dom.texts if not x[1]]
            out[i] = style_tree._text(x for x in own if not any(x[0] == t or x[0].startswith(t + "/") for t in drop)) or style_tree._text(own)
    return out


def test_style_tree_decides_inside_articles_as_plain_loops_do(spark):
    rows = site_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    on = {x["page_id"]: x["text"] for x in style_tree.main_text(df).collect()}
    off = {x["page_id"]: x["text"] for x in style_tree.main_text(df, least=0.0).collect()}
    assert on == brute_texts(rows, style_tree.IMPORTANCE) and off == brute_texts(rows, 0.0)
    assert all(on[i] != off[i] for i in on)  # without the tree every text is another
    for i, text in on.items():
        assert "own " in text and not any(x in text for x in ("Share on", "Site name", "Written by", "All rights", "Contact us", "See also"))
        assert "Share on X" in off[i] and "All rights" in off[i]


# ---------------------------------------------------------------- vectors

@pytest.mark.parametrize("unit,visitors,cell", [(8000, 64000, 4000), (16, 50, 20)])
def test_metric_range_join(spark, monkeypatch, unit, visitors, cell):
    for k, v in (("UNIT", unit), ("VISITORS", visitors), ("CELL", cell)):
        monkeypatch.setattr(metric_join, k, v)
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 8))
    x[50:90] = x[5] + r.normal(scale=0.12, size=(40, 8))
    x[90:100] = x[7]
    x[100:110] = x[8] * np.linspace(0.5, 40, 10)[:, None]
    rows = [(200 - i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [math.nan] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [math.inf] * 8),
             (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 as id", "2 as n", "3 as h1")
    fine = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows)
            if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(p, q) for p in fine for q in fine if p[0] < q[0] and len(p[2]) == len(q[2])
             and p[2] @ q[2] / np.sqrt(p[2] @ p[2]) / np.sqrt(q[2] @ q[2]) >= 0.95]
    comp = brute_components({i for i, _ in rows if i is not None}, [(p[1], q[1]) for p, q in pairs])
    links = Counter([p[0] for p, _ in pairs] + [q[0] for _, q in pairs])
    want = Counter((i, links[k], comp.get(i), i is None or comp[i] == i) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, metric_join.near_vectors(df).collect())) == want
    assert metric_join.near_vectors(df.where("false")).collect() == []
