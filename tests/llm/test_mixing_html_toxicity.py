from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import htmltemplate as H
from tallyframe.llm import mixing as M
from tallyframe.llm import toxicity as X
from tests.llm.conftest import SF


def poured(words):
    """Targets by raising one level in small steps."""
    order = sorted(s for s in words if s is not None) + [None] * (None in words)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    low, high, total = 0.0, float(sum(words.values())) * 3 + 1, sum(words.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * words[s], level * weight[s]) for s in words) < total else (low, level)
    return {s: min(3 * words[s], low * weight[s]) for s in words}


@pytest.mark.parametrize("words", [{"a": 10, "b": 10}, {"a": 1, "b": 100, "c": 50, None: 7}, {"x": 0, "y": 9}, {None: 4}, {}, {"a": 1, "b": 1, "c": 1, "d": 1000}])
def test_targets(words):
    got = M.targets(words)
    assert got == pytest.approx(poured(words), rel=1e-6, abs=1e-6)
    assert sum(got.values()) == pytest.approx(sum(words.values()))


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_split_is_exact_and_even(shards):
    counts = [5, 0, 120, 33]
    got = M.split(counts, shards, 1)
    assert got.sum(0).tolist() == counts and (got >= 0).all() and np.ptp(got.sum(1)) <= shards.bit_length()
    assert (M.split(counts, shards, 1) == got).all()


def draws(docs):
    sized, _, plan, single = M.plan(docs)
    return M.with_draws(sized, plan, single).select("doc_id", "source", "size", "target", "source_size", F.size("draws").alias("times")).collect()


def test_mixture(documents):
    import re

    rows = draws(documents)
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents.collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    words, taken, target = Counter(), Counter(), {}
    for r in rows:
        words[r.source] += r.size
        taken[r.source] += r.size * r.times
        target[r.source] = r.target
        assert 0 <= r.times <= 3
    assert target == pytest.approx(M.targets(dict(words)))
    for s in words:
        assert abs(taken[s] - target[s]) <= max(50, 0.02 * target[s])
    assert sorted(map(str, rows)) == sorted(map(str, draws(documents.repartition(7))))


def test_shards_hold_the_quotas_of_the_tree(documents, monkeypatch):
    """Block draws by source and shard, as the query's rows have them, are the splitting tree's."""
    monkeypatch.setattr(M, "SHARD_WORDS", 5_000)
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    quotas, split = [], M.split
    monkeypatch.setattr(M, "split", lambda counts, shards, seed: quotas.append(split(counts, shards, seed)) or quotas[-1])
    sized, _, plan, single = M.plan(documents)
    drawn = M.with_draws(sized, plan, single).select("skey", "block", "draws").collect()
    blocks = {(r.skey, r.block, d.copy, d.shard) for r in drawn for d in r.draws}
    assert len(blocks) == len({b[:3] for b in blocks})  # a draw of a block goes to one shard as a whole
    (quota,) = quotas
    keys, counts = sorted({r.skey for r in drawn}), Counter((b[0], b[3]) for b in blocks)
    missing = [quota[s, i] - counts[k, s] for i, k in enumerate(keys) for s in range(len(quota))]
    assert len(quota) > 3 and quota.shape[1] == len(keys)
    assert min(missing) >= 0 and sum(missing) <= len(keys)  # a source's last block may turn out to have no row that fits


def test_mix_gives_the_drawn_rows(documents, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 5_000)
    times = {r.doc_id: r.times for r in draws(documents)}
    out = M.mix(documents)
    assert out.columns == documents.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in times.items() if n})
    assert out.rdd.getNumPartitions() > 3


def test_mixture_odd_rows(odd, none):
    rows = draws(odd)
    assert len(rows) == 11 and {r.target for r in rows if r.source == ""} == {6.0}
    assert M.mix(odd).columns == odd.columns and draws(none) == [] and M.mix(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site &amp; name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
%s
<aside>More</aside><div id="comments"><article><p>A reader's comment</p></article></div><form><p>Search</p><input></form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<article><h1>Title</h1><p>One&nbsp;  two<br>three</p><p>Four <b>five</b><i>six</i></article>", "Title\n\nOne two three\n\nFour fivesix"),
        ("<main><div>alpha<p>beta</div>gamma</main>", "alpha\n\nbeta\n\ngamma"),
        ("<article><p>a &lt;b&gt; &#233; &eacute; &unknown; &amp</p><div class='advert'>Buy</div><ul><li>x<li>y</ul></article>", "a <b> é é &unknown; &\n\nx\n\ny"),
        ("<article><p>cut <b>off</article", "cut off"),
        ("<article><table><tr><td>1</td><td>2</td></tr><tr><td>3</table><pre>a\n  b</pre><script>x</script></article>", "1 2\n\n3\n\na b"),
        ("<article><p>a 1 < 2 <3 b</p><p hidden>no</p><p style='display:none'>no</p><header><h2>Head</h2></header></article>", "a 1 < 2 <3 b\n\nHead"),
        ("<article></article>", ""),
    ],
)
def test_marked_articles(inner, want):
    assert H.extracted(PAGE % inner) == want


def test_templates_find_the_slot(spark):
    """No element is marked: what varies on the host's pages is the article, what does not is the template."""
    page = "<html><body><div class=top><p>Welcome to us</p></div><div class=wrap><div class=text><h1>Story {0}</h1><p>Body of {0}</p><p>Always the same line</p></div><p>All rights reserved</p></div></body></html>"
    rows = [(i, f"https://Host.example/{i}?q", page.format(i)) for i in range(6)] + [(99, "http://other/1", page.format("x")), (100, None, None), (101, "http://e/", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i][0].startswith(f"Story {i}\n\nBody of {i}") and "Welcome" not in got[i][0] and "rights" not in got[i][0]
    assert got[99][0].startswith("Welcome to us\n\nStory x") and got[100] == ("", 0) and got[101] == ("", 0)


def site(rng, n):
    """Pages without marks: (html, blocks of the article). A stock line, a box and most of a footer are on some pages only."""
    words = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        title, paragraphs = f"Title {i} {rng.choice(words)}", [" ".join(rng.choices(words, k=rng.randrange(8, 40))) + "." for _ in range(rng.randrange(2, 6))]
        if rng.random() < 0.7:
            paragraphs.insert(rng.randrange(len(paragraphs) + 1), "A stock line that many articles hold.")
        box = "<div class=box><h4>More of it</h4><div><span>Read on</span><p>All our stories</p></div></div>" if rng.random() < 0.7 else ""
        low = "<div class=low><p>All rights held</p><i>by us</i></div>" if i % 4 else ""
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<html><head><title>{title}</title></head><body class=b><div class=top><b>Welcome</b><i>to us</i></div><div class=wrap><h1>{title}</h1><div class=text>{inner}{box}</div></div>{low}</body></html>"
        out.append((html, [title, *paragraphs]))
    return out


def deduced(pages, least=3):
    """Texts of a host's pages by the same rules, with whole occurrence vectors, from the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.stack, self.elements, self.texts = [], [], []
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            self.stack.append(f"{tag}[{attrs}]" if attrs else tag)
            self.elements.append(tuple(self.stack))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            self.texts.append((tuple(self.stack), data))

    read = [Reader(h) for h in pages]
    read = [(r.elements, [t for t in r.texts if "title" not in t[0]]) for r in read]
    tokens = {t for elements, texts in read for t in (*elements, *texts) if t[-1] != "title"}
    vectors = {t: tuple(e.count(t) + x.count(t) for e, x in read) for t in tokens}
    classes = defaultdict(set)
    for t, v in vectors.items():
        if max(v) == 1 and sum(v) >= len(pages) / 2:
            classes[v].add(t)
    is_text = lambda t: isinstance(t[0], tuple)
    above = lambda t: t[0] if is_text(t) else t[:-1]
    accepted: set = set()
    for v, members in sorted(classes.items(), key=lambda c: (-sum(c[0]), -len(c[1]))):
        if len(members) < least or least > 1 and all(map(is_text, members)):
            continue
        around = min(map(above, members), key=len)
        if least == 1 or not accepted or around in accepted and all(above(t)[: len(around)] == around for t in members):
            accepted |= members
    constant = {t for t in accepted if is_text(t)}
    own = {e: sum(len(d) for _, texts in read for p, d in texts if p[: len(e)] == e and (p, d) not in constant) for e in accepted - constant}
    main = max((len(e), e) for e, n in own.items() if n >= 0.8 * max(own.values()))[1]
    out = []
    for _, texts in read:
        inside = [t for t in texts if t[0][: len(main)] == main]
        if not any("h1" in t[0] for t in inside):
            inside = [t for t in texts if "h1" in t[0]][:1] + inside
        out.append("\n\n".join(d for p, d in inside if (p, d) not in constant))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_templates_against_whole_vectors(spark, monkeypatch, seed):
    """Unmarked pages of two hosts: the planted blocks, and those that plain loops deduce. Without classes, texts that recur are lost."""
    rng = random.Random(seed)
    sites = {"one.example": site(rng, 9), "two.example": site(rng, 14)}
    rows = [(k, f"http://{host}/{k}", html) for host, pages in sites.items() for k, (html, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((f"http://{host}/{k}", "\n\n".join(blocks)) for host, pages in sites.items() for k, (_, blocks) in enumerate(pages))
    assert sorted((r.url, r.text) for r in H.main_text(df).collect()) == want
    assert sorted((f"http://{host}/{k}", t) for host, pages in sites.items() for k, t in enumerate(deduced([h for h, _ in pages]))) == want
    if not seed:
        tokens = [(1, "/b/div", 9, 1, 500), (2, "/b", 9, 1, 900), (3, "#/b", 9, 1, 20), (4, "#/b/div", 6, 7, 80)]
        assert H.template(tokens) == ("/b", [3]) and H.template(tokens, 1)[1] == [3] and H.template(tokens[:1] + tokens[1:3] + [(4, "/b/div/i", 6, 7, 0), (5, "#/b/div", 6, 7, 9), (6, "#/b/div/i", 6, 7, 9)])[1] == [3, 5, 6]


def test_without_templates_or_classes_the_result_is_another():
    """An ablation: no template; tokens by their frequency alone instead of nested classes."""
    pages = site(random.Random(7), 12)
    want = ["\n\n".join(b) for _, b in pages]
    assert deduced([h for h, _ in pages]) == want and deduced([h for h, _ in pages], least=1) != want
    assert all(H.extracted(h) != w for (h, _), w in zip(pages, want))


def test_marked_pages_come_through_their_slot(spark):
    """Over the table, with the marks taken out of the pages: the same texts, from the template alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.groupBy(H.host_of().alias("host")).count().where("count >= 4")
    some = pages.join(hosts, H.host_of() == F.col("host")).select("page_id", "url", "html")
    bare = some.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1section>"))
    one, two = ({r.page_id: r.text for r in H.main_text(d).collect()} for d in (some, bare))
    same = sum(one[i] == two[i] for i in one)
    assert len(one) > 50 and same >= 0.95 * len(one), (same, len(one))


def test_words_that_name_other_things_stay_in_articles():
    inner = "<article><p class='market-share'>One</p><div class=alert><p>Two</p></div><p class='related work'>Three</p><div class=advert>Buy</div><div class=comments>So</div></article><div class=share>Tell</div>"
    assert H.extracted(PAGE % inner) == "One\n\nTwo\n\nThree"


def test_equal_pages_keep_marked_text(spark):
    rows = [(i, "http://h/x", PAGE % "<article><p>Same text &amp; more</p></article>") for i in range(5)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "page_id long, url string, html string, main string")
    assert {r.text for r in H.main_text(df).collect()} == {"Same text & more"}
    assert H.main_text(df.where("false")).count() == 0


def test_pages_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1]) if inner else []
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in blocks)
        assert got[r.page_id] == "\n\n".join(b for b in plain if b)


def all_paths(machine, symbols, weights):
    """Every path, step by step, without choosing."""
    paths = [(machine.start, 0.0, ())]
    for symbol in symbols:
        paths = [(to, w + sum(weights[a] * n for a, n in acts), out + (put,)) for state, w, out in paths for to, put, acts in machine.step(state, symbol)]
    return paths


def read(symbols, weights=X.STATED):
    return X.grammar().best([{"I": "I5", "i": "I2"}.get(s, s) for s in symbols] + ["$"], weights)


def test_machine():
    for symbols, put in (
        ("xIx", "I"), ("GxI", "IG"), ("IxG", "IG"), ("xNI", "nI"), ("NxxIx", "nI"), ("NxxxI", "I"), ("RxI", "rI"), ("RGNI", "rnIG"), ("AVG", "T"), ("AxVxG", "T"), ("NAVG", "nT"),
        ("AxxxxVG", "x"), ("VG", "x"), ("I", "x"), ("II", "I"), ("ix", "I"),
    ):
        assert put in read(symbols)[2], symbols
    assert read("I")[0] == 0 and read("xN")[0] == 0 and read("")[0] == 0
    assert "nI" not in read("xNII")[2] or read("xNII")[0] == max(w for _, w, _ in all_paths(X.grammar(), ["x", "N", "I5", "I5", "$"], X.STATED))
    swap = X.Transducer({(0, "a"): [(0, "b", (("plain", 1),))]}) @ X.Transducer({(0, "b"): [(0, "c", (("odds", 2),)), (1, "d", ())], (1, "b"): []})
    assert swap.best("aa", {"plain": 1.0, "odds": 0.25})[::2] == (3.0, ("c", "c")) and swap.best("aa", {"plain": 1.0, "odds": -1.0})[::2] == (0.0, ("c", "d"))


def test_best_path_is_the_best_of_all_paths():
    machine, rng = X.grammar(), random.Random(5)
    for k in range(250):
        symbols = [rng.choice(["I1", "I4", "I6", "A", "V", "G", "N", "R", "x", "x"]) for _ in range(rng.randrange(8))] + ["$"]
        weights = X.STATED if k % 2 else {a: rng.uniform(-3, 3) for a in X.ACTS}
        assert machine.best(symbols, weights)[0] == pytest.approx(max(w for _, w, _ in all_paths(machine, symbols, weights)))


STEMS = {s: 6.0 for s in X.INSULTS}


def test_clauses_decide():
    g = X.Grammar(STEMS)
    plain, said, negated, clean = (g.score(t) for t in ("You are an idiot.", "He said that you are an idiot.", "You are not an idiot.", "A fine day. You are here."))
    assert plain > said > clean and plain > negated > clean and plain > 0.3 > clean and g.score("I will kill you") > 0.3 > g.score("They kill time. You know")
    assert g.score(None) == g.score("") == clean
    for lone in ("idiot", "Idiot! Moron.", "stupid\nidiot"):  # words that are no clause
        assert g.score(lone) == clean


def test_weights_of_arcs_decide():
    texts = ["You are an idiot.", "He said that you are an idiot.", "You are not an idiot", "I will kill you", "some trash here"]
    scores = lambda weights: [X.Grammar(STEMS, np.concatenate([list(weights.values()), X.fixed_weights()[len(X.ACTS) :]])).score(t) for t in texts]
    stated = scores(X.STATED)
    assert len({*scores(dict.fromkeys(X.ACTS, 0.0))}) == 1
    for act, moved in (("odds", [0, 1, 2, 4]), ("target", [0, 1, 2]), ("reported", [1]), ("negated", [2]), ("threat", [3])):
        turned = scores(X.STATED | {act: X.STATED[act] * 1.5})
        assert [i for i in range(5) if turned[i] != stated[i]] == moved, act


@pytest.mark.parametrize("sf,recall,precision", [("sf0.1", 0.9, 0.95), ("sf0.01", 0.6, 0.9)])
def test_held_out_recall_and_what_the_machine_is_for(sf, recall, precision):
    """On held-out rows; without the machine's paths nothing is told apart."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '/root/testdata/{sf}/documents.parquet' JOIN '/root/testdata/{sf}/labels.parquet' USING (doc_id) ORDER BY ALL").fetchall()
    out = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    stems, weights = X.fit([(t or "", y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2])
    g = X.Grammar(stems, weights)
    said = [(g.score(t) >= X.THRESHOLD, y) for t, y in out]
    assert sum(p for p, y in said if y) >= recall * sum(y for _, y in out) and sum(y for p, y in said if p) >= precision * sum(p for p, _ in said)
    g.machine = X.Transducer({})
    g.memo.clear()
    assert len({g.score(t) for t, _ in out}) == 1


def test_fit_learns_stems():
    rows = [(f"der tag ist gut {i}", 0) for i in range(200)] + [(f"so ein grobiansky{i % 5} hier {i}", 1) for i in range(40)]
    stems, weights = X.fit(rows)
    g = X.Grammar(stems, weights)
    assert any(s.startswith("grob") for s in stems) and g.score("ein grobianskyx da") > 0.5 > g.score("der tag ist gut")


def test_op1(spark):
    rows = {r.doc_id: r for r in X.op1_toxicity_grammar(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [(rows[i].score, t) for i, t in labels.items() if rows[i].held_out]
    pos, neg = [s for s, t in out if t], [s for s, t in out if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.7 and sum(s >= 0.3 for s in neg) <= 0.03 * len(neg)


def test_held_out_labels_do_not_matter(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (X.model(documents, t, ~X.held_out()) for t in (labels, turned))
    assert one[0] == two[0] and (one[1] == two[1]).all()


def test_clashing_labels(spark):
    """Of a doc_id's labels one of toxic decides, in any order."""
    docs = spark.createDataFrame([(i, f"plain words {i}" if i % 2 else f"you are an idiot {i}") for i in range(40)], "doc_id long, text string")
    rows = [(i, int(i % 2 == 0)) for i in range(40)] + [(i, 0) for i in range(0, 40, 2)]
    one, two = (X.model(docs, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (rows, rows[::-1]))
    assert one[0] == two[0] and (one[1] == two[1]).all() and X.Grammar(*one).score("you are an idiot 7") > 0.5


def test_scores_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    fitted = X.model(odd, labels)
    assert (fitted[1] == X.fixed_weights()).all()
    out = X.scored(odd, fitted)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"] and out.count() == 11
    by = defaultdict(set)
    for r in out.collect():
        by[r.text].add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    assert X.scored(none, fitted).count() == 0 and X.kept(odd, fitted, 0.5).count() == 11


def test_rows_that_do_not_fit_are_passed_over():
    units = [100] * 10 + [50_000] + [100] * 245
    assert sum(units[i] for i in M.filled(units, 20_000, None)) == 20_000
    assert M.filled([7, 1000, 3, 5], 13, None) == [0, 3]
    assert M.filled([1000, 1000], 1600, None) == [0, 1] and M.filled([100, 15_000], 10_000, 100) == [0] and M.filled([100, 15_000], 10_000, 10_000) == [1]


@pytest.mark.parametrize("block_rows", [256, 16, 4])
def test_a_very_long_document_does_not_miss_the_target(spark, monkeypatch, block_rows):
    """Half of six of the sources is drawn, in which one document is nearly as long as all that is wanted."""
    monkeypatch.setattr(M, "BLOCK_ROWS", block_rows)
    rows = [(1000 * k + i, f"s{k}", "w " * (24_000 if i == 11 else 100)) for k in range(9) for i in range(256)]
    got = draws(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.times
        target[r.source] = r.target
        assert 0 <= r.times <= 3
    assert max(abs(taken[s] - target[s]) for s in target) <= 50


@pytest.mark.parametrize(
    "page",
    [
        "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><body><article><p>One two</p></article></body></html>",
        "<!DOCTYPE html><head><title>T</title><link rel=x><article><p>One two</article>",
        "<head><title>T</title><p>One two",
        "<head><title>T</title>One <b>two</b>",
        "<title>T</title><p>One two",
    ],
)
def test_a_head_without_its_end_tag(page):
    assert H.extracted(page) == "One two"
