"""License scans, spelling variants and hard negatives against slow twins, and their odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkspark.llm import bpe, cover_tree, gru_langid, html_template, kn_quality, license_scan, spelling_variants

# ---- license scans ------------------------------------------------------------------------------------------------


def slow_scan(text, templates, phrases):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    at = lambda p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {label: at(p) for p, label in phrases.items()}
    places = sorted(i for v in base.values() for i in v)
    labels, share = {k for k, v in base.items() if v}, 0.0
    for label, wording in set(templates):
        t = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", wording.lower()) if w]
        n = len(t) - license_scan.GRAM + 1
        hits = sorted((i - j, j, i) for i in range(len(words) - 2) for j in range(n) if words[i : i + 3] == t[j : j + 3])
        groups = []
        for h in hits:
            if not groups or h[0] - groups[-1][-1][0] > license_scan.DRIFT:
                groups.append([])
            groups[-1].append(h)
        for g in groups:
            covered, length = len({j for _, j, _ in g}), max(i for *_, i in g) + 3 - min(i for *_, i in g)
            if covered >= license_scan.LEAST_SHARE * n and length <= license_scan.REACH * len(t):
                labels.add(label)
                share = max(share, covered / n)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, v in base.items() if v)), ",".join(sorted(labels)), 1.0 if places else share


def test_license_scan_equals_a_slow_scan(spark):
    r = random.Random(5)
    some = [t for _, t in license_scan.TEMPLATES]
    texts = [None, "", "  ", "--", "CC-BY", "cc by cc by", "cc", "Général public licensé", "Released under the MIT License", "released under the mit", "all rights reserved " * 3]
    for _ in range(150):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += r.choices(["the", "License", "under", "cc", "by", "all", "rights", "reserved", "General", "public", "x1", "é", "中文"], k=r.randrange(0, 12))
            t = r.choice(some).split()
            a = r.randrange(0, 3)
            part = t[a : len(t) - r.randrange(0, 3)]
            for _ in range(r.randrange(0, 3)):  # words put in, left out and changed
                k = r.randrange(0, len(part) + 1)
                part[k : k + r.randrange(0, 2)] = r.choices(["or", "and", "X"], k=r.randrange(0, 2))
            words += part
        texts.append(r.choice([" ", ", ", "\n"]).join(words))
    texts += [some[1] + " " + "word " * 50_000 + some[4], *texts[:30]]
    docs = spark.createDataFrame([(None if i % 20 == 7 else i % 60, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, own string")
    out = license_scan.scanned(docs, spark.createDataFrame(license_scan.TEMPLATES, "label string, text string"), license_scan.PHRASES)
    got = sorted((tuple(x) for x in out.collect()), key=str)
    want = sorted(((None if i % 20 == 7 else i % 60, *slow_scan(t, license_scan.TEMPLATES, license_scan.PHRASES)) for i, t in enumerate(texts)), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in want])
    assert any(w[6] and not w[5] for w in want)


def test_license_scan_of_nothing(spark):
    out = license_scan.scanned(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(license_scan.TEMPLATES, "label string, text string"), {})
    assert out.collect() == []


# ---- spelling variants --------------------------------------------------------------------------------------------


def slow_variants(docs):
    counts = {}
    for doc_id, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(r"[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    skips = {}
    for w in counts:
        for p in range(len(w)):
            skips.setdefault((p, w[:p] + w[p + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for (_, s), members in skips.items():
        for w in members:
            near[w] |= members - {w}
            if s in counts:
                near[w].add(s)
                near[s].add(w)
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        out[w] = best if best and counts[best] >= 5 * n else None
    rows = []
    for w in counts:
        root = w
        while out[root]:
            root = out[root]
        rows.append((w, out[w], root, counts[w], len(near[w]), counts.get(out[w])))
    return sorted(rows)


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abé", k=r.randrange(6, 9))) for _ in range(60)]
    words += ["aabbaa", "abbaa", "aabaa" + "b", "aaaaaa", "aaaaaaa", "Ünders", "ünders", "×÷×÷×÷"]
    long = "".join(r.choices("abcdefgh", k=64))
    words += [long[:63], long, long + "a", long + "ab", long[:30] + long[31:], long[:30] + "zz" + long[31:], "q" * 4000, "q" * 4001, "q" * 2000 + "r" + "q" * 2000]
    docs = []
    for i in range(260):
        docs.append((None if i == 9 else i // 2, r.choice([" ", "1", "\n"]).join(r.choices(words, weights=[1 + 40 * (k % 7 == 0) for k in range(len(words))], k=80))))
    docs += [(900, "Garden " * 300), (901, "gardenu " * 40), (902, "gardenux " * 6)]
    docs += [(5, None), (6, ""), (7, "abc 123"), *docs[:3]]
    got = spelling_variants.variants(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == slow_variants(docs)
    assert any(f for _, f, *_ in rows) and any(f and rt != f for _, f, rt, *_ in rows)
    assert any(len(w) > 4000 and n_near for w, _, _, _, n_near, _ in rows)


def test_variants_of_nothing(spark):
    assert spelling_variants.variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id bigint, text string")).collect() == []


# ---- hard negatives -----------------------------------------------------------------------------------------------


def slow_negatives(rows, every):
    fine = [(i, lb, v) for i, lb, v in rows if lb is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, (lb + 1) % 10 if i is not None and i % 7 == 0 else lb, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lb, v in fine]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    anchors = {(i, lb, tuple(v)) for i, lb, v in fine if i is not None and i % every == 0}
    last = lambda i: 2**63 if i is None else i
    for i, lb, v in anchors:
        good = sorted(((-score(v, w), last(k), k) for k, m, w in fine if m == lb and k != i))[:5]
        bad = sorted(((-score(v, w), last(k), k) for k, m, w in fine if m != lb))
        for p, _, k in good:
            fit = [(s, n) for s, _, n in bad if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, k, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["plain", "clustered", "odd"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "SAMPLE", 100)
    r = np.random.default_rng(4)
    n = 700
    x = r.normal(size=(n, 8))
    if kind == "clustered":
        x = x * 0.2 + r.normal(size=(6, 8))[r.integers(0, 6, n)]
        x *= r.uniform(0.2, 3, (n, 1))
    rows = [(int(i), int(lb), v) for i, lb, v in zip(range(n), r.integers(0, 4, n), x.astype(np.float32).tolist(), strict=True)]
    if kind == "odd":
        rows = [(i, lb, [float(round(a)) for a in v]) for i, lb, v in rows]  # many ties
        rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [None] * 8), (n + 3, 1, [float("nan")] * 8), (n + 4, 1, [float("inf")] * 8), (None, 2, rows[3][2]), (n + 5, 2, rows[3][2][:4]), (n + 6, 3, []), (800, 1, [0.0] * 8)]
        rows += rows[:40] + [rows[100]] * 300
    made = cover_tree.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>"), F.col("id") % 20 == 0)
    assert sorted((tuple(x) for x in made.collect()), key=str) == slow_negatives(rows, 20)


def test_negatives_of_large_components_and_of_nothing(spark):
    # scores beyond 2^53, so that doubles don't hold them, and beyond 2^63
    rows = [(k, k % 3, [2e5 * (k + 1), -1e5 * k]) for k in range(30)]
    made = cover_tree.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), F.col("id") % 10 == 0)
    assert sorted((tuple(x) for x in made.collect()), key=str) == slow_negatives(rows, 10)
    huge = [(k, k % 3, [3e9 * (k + 1), -1e9 * k]) for k in range(30)]
    assert cover_tree.hard_negatives(spark.createDataFrame(huge, "vec_id bigint, label int, embedding array<double>"), F.col("id") % 10 == 0).count() >= 0
    empty = cover_tree.hard_negatives(spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>"), F.col("id") % 10 == 0)
    assert empty.collect() == []


def test_tree_bounds_hold():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(500, 6)))
    most = float(np.sqrt((x * x).sum(axis=1)).max()) * (1 + 1e-9)
    tree = cover_tree.Tree.build(x, most)
    under = lambda k: tree.rows[k] if tree.rows[k] is not None else np.concatenate([under(c) for c in tree.children[k]])
    q = np.floor(256 * r.normal(size=6))
    low, high = cover_tree.bounds(q, most, tree.lift[tree.centre], tree.radius)
    for k in range(len(tree.centre)):
        own = x[under(k)] @ q
        assert low[k] <= own.min() and own.max() <= high[k]
    assert sorted(under(0)) == list(range(500))


# ---- pages, languages, decoding -----------------------------------------------------------------------------------


def test_what_looks_like_a_tag_in_a_script_is_none():
    page = html_template.Page("<script>s='<a ';</script><nav>menu</nav><article><p>It's one</p><p>two</p></article>")
    assert page.text(None) == "It's one\ntwo"
    page = html_template.Page("<style>a{content:\"<p '\"}</style><aside>x</aside><main><h1>T</h1>It's \"so\"</main><!-- <p> --><footer>f</footer>")
    assert page.text(None) == "T\nIt's \"so\""


def test_blocks_of_an_article_stay():
    page = html_template.Page("<article><h1>A</h1><div class='related'>more on this</div><section class='search results'>r</section><blockquote class=notice>n</blockquote><div class='advert'>buy</div><section class='comments'>me too</section></article><div class='related'>other</div>")
    assert page.text(None) == "A\nmore on this\nr\nn"


def test_deep_nesting_costs_its_elements():
    n = 100_000
    page = html_template.Page("<article>" + "<div>" * n + "deep" + "</div>" * n + "<p>after</p></article>")
    assert page.text(None) == "deep\nafter" and max(map(len, page.opened)) < 1000
    assert html_template.Page("<b>" * n + "x" + "</p>" * 1000).text(None) == "x"


def test_a_language_of_short_texts_is_learned(spark):
    r = random.Random(8)
    rows = [(k, " ".join(r.choices(["the", "and", "house", "which", "through"], k=30)), "en") for k in range(120)]
    rows += [(200 + k, r.choice(["ναι", "όχι", "καλά", "ευχαριστώ", "παρακαλώ"]), "el") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = gru_langid.predict(docs, gru_langid.train(docs)).select("lang", "lang_pred").collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.97 * len(found)


def test_ids_are_cut_by_number():
    column = pa.array([[1] * 5, None, [], [2] * 9, [3], [4] * 4], pa.list_(pa.int32()))
    parts = list(bpe.id_slices(column, 6))
    assert parts == [(0, 3), (3, 1), (4, 2)] and list(bpe.id_slices(column[:0], 6)) == []


def random_page(r):
    """A page, and the blocks of its article: built together, so that nothing is parsed to know them."""
    blocks, held = [], []

    def words():
        t = " ".join(r.choices(["one", "it's", 'the "end"', "a<b", "x & y", "ß", "café"], k=r.randrange(1, 5)))
        held.append(" " + t + "\n")
        return " " + t.replace("&", "&amp;").replace("<", "&lt;").replace("é", r.choice(["é", "&eacute;", "&#233;"])) + "\n"

    def stop():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    def unseen(html):
        stop()
        return html

    def inline(depth):
        out = words()
        if depth and r.random() < 0.5:
            name = r.choice(["b", "a href='/x?a=1&b=2'", "span class=related", 'em title="a > b"'])
            out += f"<{name}>" + inline(depth - 1) + f"</{name.split()[0]}>" + words()
        if r.random() < 0.2:
            held.append(" ")
            out += "<br>"
        return out

    def block(depth):
        kind = r.choice(["p", "div", "section", "ul", "h2", "script", "aside", "comment", "advert", "blockquote"])
        if kind == "script":
            return unseen("<script>if (a<b) s='<p class=\"x' + \"<div \";</script>")
        if kind == "aside":
            return unseen("<aside>see <p>also</p></aside>")
        if kind == "advert":
            return unseen("<div class='advert big'><p>buy</p> now</div>")
        if kind == "comment":
            return "<!-- <p>not this</p> -->"
        stop()
        if kind == "ul":
            out = "<ul>"
            for _ in range(r.randrange(1, 4)):
                out += "<li>" + inline(2)
                stop()
            out += "</ul>"
        elif kind in ("p", "h2") or not depth:
            out = f"<{kind}>" + inline(2) + f"</{kind}>"
        else:
            out = f"<{kind} class=c{r.randrange(3)}>" + "".join(block(depth - 1) if r.random() < 0.7 else inline(1) for _ in range(r.randrange(1, 5))) + f"</{kind}>"
        stop()
        return out

    body = ""
    for _ in range(r.randrange(1, 6)):
        body += block(r.randrange(0, 3))
    stop()
    return body, list(blocks)


def test_pages_equal_how_they_were_built():
    r = random.Random(9)
    for _ in range(300):
        inner, want = random_page(r)
        html = "<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a href=/>menu</a></nav><article>" + inner + "</article><footer>end</footer></body></html>"
        if want:
            assert html_template.Page(html).text(None).split("\n") == want, html


# ---- language model -----------------------------------------------------------------------------------------------


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by its definition: a function of (context, byte)."""
    fold = lambda t: bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in t.encode())
    counts = {order: {}}
    for t in texts:
        s = b"\n" * (order - 1) + fold(t) + b"\n"
        for i in range(order, len(s) + 1):
            counts[order][s[i - order : i]] = counts[order].get(s[i - order : i], 0) + 1
    for k in range(order - 1, 0, -1):  # in how many different longer n-grams
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    less = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        less[k] = [0] + [0.5 * i if y is None or not n[i] else max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        own = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        back = sum(less[k][min(c, 3)] for c in own.values()) / total
        return max(0, own.get(g, 0) - less[k][min(own.get(g, 0), 3)]) / total + back * p(g[1:])

    def nll(t):
        s = b"\n" * (order - 1) + fold(t) + b"\n"
        return -sum(math.log(p(s[i - order : i])) for i in range(order, len(s) + 1))

    return nll


def test_language_model_equals_its_definition(spark):
    r = random.Random(12)
    texts = [" ".join(r.choices(["the", "cat", "Sat", "on", "mats", "1999", "é", "of"], k=r.randrange(1, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    good = [i for i in range(40) if i % 3]
    folds = {x.doc_id: x.f for x in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(kn_quality.FOLDS)).alias("f")).collect()}
    got = {x.doc_id: (x.nll, x.n_bytes) for x in kn_quality.scored(docs, spark.createDataFrame([(i,) for i in good], "doc_id bigint")).collect()}
    for f in set(folds.values()):
        model = kneser_ney([texts[i] for i in good if folds[i] != f], kn_quality.ORDER)
        for i in range(40):
            if folds[i] == f:
                assert got[i] == (pytest.approx(model(texts[i])), len(texts[i].encode()) + 1)


def test_network_reads_as_its_equations_say():
    """Whole texts, byte by byte with scalars: segments start anew, padding isn't read, documents get the mean over their bytes."""
    r, net = np.random.default_rng(2), gru_langid.Network(["a", "b", "c"], hidden=3)
    net.p["out"] = r.normal(size=net.p["out"].shape).astype(np.float32)
    net.p["bias"] = r.normal(size=net.p["bias"].shape).astype(np.float32)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(part, d):
        p, h, out, s = net.p, net.h, {}, [0.0] * net.h
        for t in range(len(part)) if d == "f" else range(len(part) - 1, -1, -1):
            x = [float(v) for v in p[f"in{d}"][:, part[t]]]
            gate = [sigmoid(x[i] + sum(float(p[f"rec{d}"][i, j]) * s[j] for j in range(h))) for i in range(2 * h)]
            new = [math.tanh(x[2 * h + i] + sum(float(p[f"cand{d}"][i, j]) * gate[h + j] * s[j] for j in range(h))) for i in range(h)]
            s = [gate[i] * s[i] + (1 - gate[i]) * new[i] for i in range(h)]
            out[t] = s
        return out

    texts = ["Één straße".encode(), b"x" * 64, b"The quick brown fox " * 9, b"q"]
    best, score = net.documents(texts)
    for text, b, sc in zip(texts, best, score, strict=True):
        sums, low = [0.0] * 3, bytes(c + 32 if 65 <= c <= 90 else c for c in text)
        for i in range(0, len(low), gru_langid.SEGMENT):
            part = low[i : i + gru_langid.SEGMENT]
            f, w = states(part, "f"), states(part, "b")
            for t in range(len(part)):
                logits = [float(net.p["bias"][k, 0]) + sum(float(net.p["out"][k, j]) * v for j, v in enumerate(f[t] + w[t])) for k in range(3)]
                e = [math.exp(v - max(logits)) for v in logits]
                sums = [a + v / sum(e) for a, v in zip(sums, e, strict=True)]
        means = [v / len(text) for v in sums]
        assert b == max(range(3), key=means.__getitem__) and sc == pytest.approx(max(means), rel=1e-4)


def test_one_pass_equals_two(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello  world, 中文 é\n"), (2, None), (3, ""), (None, "x" * 5000), (4, "<|endoftext|> and ퟿"), (4, "the cat " * 3000)]
    docs = spark.createDataFrame([(i, t, "k", "i") for i, t in rows], "doc_id bigint, text string, kept string, ids string")
    two = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    one = bpe.round_trip(docs, path)
    assert sorted(map(str, one.select("doc_id", "kept", "ids", "decoded").collect())) == sorted(map(str, two.select("doc_id", "kept", "ids", "decoded").collect()))
    assert {x.decoded for x in one.collect()} == {t or "" for _, t in rows}
