"""Main bodies, residue, packing and names."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.llm import mainbody, names, packing, residue


def page(title, body, menu=("Home", "Shop"), foot="(c) 2020 Site", style=0, h1=True):
    head = f"<html><head><title>{title}</title><script>var a='</p>';</script></head><body>"
    t = f"<h1>{title}</h1>" if h1 else f"<p>{title}</p>"
    ad = "Rate this (5 votes)"
    if style == 0:
        return head + "<nav><ul>" + "".join(f"<li><a href='/x'>{m}</a></li>" for m in menu) + f"</ul></nav><main>{t}" + "".join(f"<p>{b}</p>" for b in body) + f"<aside><div><a href='/r'>{ad}</a></div></aside></main><footer><div>{foot}</div></footer></body></html>"
    cell = lambda x: f"<table><tr><td>{x}</td></tr></table>"
    return head + cell("".join(f"<p>{m}</p>" for m in menu)) + cell(t + "".join(f"<p>{b}</p>" for b in body) + cell(f"<p><a href='/r'>{ad}</a></p>")) + cell(f"<p>{foot}</p>") + "</body></html>"


def segments(title, body, menu=("Home", "Shop"), foot="(c) 2020 Site", style=0, h1=True):
    return [*menu, title, *body, "Rate this (5 votes)", foot]


PROSE = "We keep {0} for {1} days to improve {2} and hand some of it to partners whenever the law asks for it."


@pytest.fixture(scope="module")
def site(spark):
    rnd = random.Random(4)
    rows, docs, want = [], [], set()
    for style in (0, 1):
        for p in range(9):
            i = f"s{style}p{p}"
            body = [PROSE.format(f"thing{rnd.randrange(999)}", rnd.randrange(999), f"goal{rnd.randrange(999)}") for _ in range(rnd.randrange(2, 5))]
            kw = dict(style=style, h1=p != 8)
            title = f"Notice {style}" if p < 8 else "Page not found"
            if p == 8:
                body = ["Reference 17"]
            rows.append((i, page(title, body, **kw), segments(title, body, **kw)))
            docs += [(i, f"https://www.host{style}.example/{p}"), (i, f"https://host{style}.example/{p}")]
            n = len(rows[-1][2])
            want |= {(i, 0), (i, 1), (i, n - 2), (i, n - 1)}
    rows += [("null", None, ["only segment"]), ("none", None, None), ("empty", "", []), ("bare", "<p>a<p>b", ["a", "b"])]
    return spark.createDataFrame(rows, "doc_id string, raw string, segments array<string>").withColumn("host", F.lit("clash")).withColumn("id", F.lit(0)), spark.createDataFrame(docs, "doc_id string, url string"), want


def test_boilerplate(site):
    pages, docs, want = site
    got = [tuple(r) for r in mainbody.boilerplate_segments(pages, docs).where("doc_id LIKE 's%'").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    b = {r["doc_id"]: r["body"] for r in mainbody.main_bodies(pages, docs).collect()}
    assert b["s1p8"] == "Page not found\nReference 17" and b["none"] is None and b["empty"] == ""
    assert mainbody.boilerplate_segments(pages.limit(0), docs).count() == 0


def test_residue_pages(site):
    pages, docs, _ = site
    got = {r["doc_id"]: r["reason"] for r in residue.residue_documents(pages, docs).collect()}
    assert got == {"s0p8": "message", "s1p8": "message"}


def test_parser():
    root, leaves, title = mainbody.parse("<html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- c --><div>x <b>y</b><p>a<p>b<br>c</div><ul><li>1<li>2</ul>tail</body></html>")
    assert title == "T & U" and [x.text for x in leaves] == ["x y", "a", "b c", "1", "2", "tail"]
    assert mainbody.parse("")[1] == [] and [x.text for x in mainbody.parse("plain < text")[1]] == ["plain < text"]


def test_tree_matching():
    s = lambda *k: ("r", tuple((x, ()) if isinstance(x, str) else x for x in k))
    top = mainbody.Slot("#")
    a, b = s("h1", "p", "foot"), s("nav", "h1", "p", "foot")
    top = mainbody.Slot("r")
    mainbody.merge(a, top, 1)
    mainbody.merge(b, top, 2)
    assert [k.label for k in top.kids] == ["nav", "h1", "p", "foot"] and [k.weight for k in top.kids] == [2, 3, 3, 3]
    again = mainbody._slot(mainbody.load_template(mainbody.dump_template(top)))
    assert mainbody.dump_template(again) == mainbody.dump_template(top)
    assert mainbody._match(a, top, {}) == 4 and mainbody.load(mainbody.dump(b)) == b


@pytest.mark.parametrize("text,bit", [
    ("This notice was issued by {{company_name}} and covers it.", 2), ("Write to [object Object] by letter.", 2), ("[INSERT COMPANY NAME] shares data", 2), ("XXXX Ltd (fill in) shares", 2), ("by ${operator} and", 2),
    ("covers %s and", 2), ("__COMPANY__ may", 2), ("<COMPANY NAME HERE> may", 2), ("TODO: legal name shares", 2), ("For accounts, undefined may copy names.", 2), ("on [date of last revision] and", 2), ("by <%= brand %>", 2), ("%%SITE_NAME%% shares", 2),
    ("Publishers replace the macro {{PARTNER_ID}} in the tag with the number.", 0), ("Fields in square brackets, such as [Name], are optional.", 0), ("Statistics [off] Marketing [off]", 0), ("annex 352 [see note 3] shows", 0), ("5 % of users", 0),
    ("Lorem ipsum dolor sit amet consectetur", 4), ("Your text goes here.", 4), ("asdf asdf qwer test test test", 4), ("Our Latin motto is printed on every letter; dolor and labor are its first words.", 0),
    ("404 - the page was not found", 8), ("Bitte aktivieren Sie JavaScript, um fortzufahren.", 8), ("Cette page est introuvable", 8), ("Página no encontrada", 8), ("Please prove that you are human", 8), ("Gone", 8),
    ("If a page is not found, our server logs the address and shows error 404 for 30 days.", 0), ("Ray 598-300", 16), ("Incident 319", 16), ("We share your data with partners.", 0), ("", 0),
])
def test_line_rules(text, bit):
    assert residue.flag_line(text) & (bit or 31) == bit


def test_best_fit():
    bins = packing.best_fit([5, 7, 3, 5, 10, 0, 2], 10)
    assert sorted(k for b in bins for k in b) == list(range(7)) and len(bins) == 4
    assert packing.best_fit([], 10) == []


def test_packing(spark):
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice(["data", "policy", "notice"]) for _ in range(n))
    rows = [(i, words(rnd.randrange(1, 90))) for i in range(400)] + [(900, None), (901, ""), (902, words(700)), (902, words(5)), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("used", F.lit(1)).withColumn("grp", F.lit(1))
    r = packing.pack(df, capacity=100, chunk=40).collect()
    enc = packing._encoder(packing.TOKENIZER)
    size = sorted((i, len(enc.encode_ordinary(t)) if t else 0) for i, t in rows if i is not None)
    by, cont = {}, {}
    for x in r:
        by.setdefault(x["id"], []).append(x)
        cont.setdefault(x["container"], []).append(x)
    assert all(sum(y["tokens"] for y in v) == v[0]["used"] <= 100 for v in cont.values())
    assert sorted(k for k, v in by.items()) == sorted({i for i, _ in size})
    total = {}
    for i, n in size:
        total[i] = total.get(i, 0) + n
    assert {k: sum(y["tokens"] for y in v) for k, v in by.items()} == total
    assert all(len(v) == 1 for k, v in by.items() if k != 902)
    assert len(cont) <= 1.1 * (sum(total.values()) / 100) + 2
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_osa():
    def full(a, b):
        d = {(i, j): max(i, j) if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in range(2))
        for k in (0, 1, 2, 3):
            assert names.osa(a, b, k) == min(full(a, b), k + 1)


@pytest.mark.parametrize("k", [1, 2])
def test_segment_join_is_complete(spark, k):
    rnd = random.Random(k)
    keys = set()
    for _ in range(60):
        a = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(8, 15)))
        keys.add(a)
        for _ in range(3):
            b = list(a)
            for _ in range(rnd.randrange(1, k + 1)):
                p = rnd.randrange(len(b) - 1)
                op = rnd.randrange(4)
                if op == 0:
                    b[p] = "z"
                elif op == 1:
                    b.insert(p, "y")
                elif op == 2:
                    del b[p]
                else:
                    b[p], b[p + 1] = b[p + 1], b[p]
            if len(b) >= 8:
                keys.add("".join(b))
    df = spark.createDataFrame([(x,) for x in keys], "s string")
    got = {(r["a"], r["b"]) for r in names._within(names.segment_candidates(df, "s", k, 8).withColumn("k", F.lit(k))).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(keys), 2) if names.osa(a, b, k) <= k}


def test_windows_of_keys_are_not_gathered_on_the_driver(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(2000).select(F.concat(F.lit("bafmud"), F.col("id").cast("string"), F.lit("dovetail")).alias("s")).write.parquet(path)  # far below the threshold as a file
    plan = names.segment_candidates(spark.read.parquet(path), "s", 2, 16)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


GROUPS = [
    ["Bafmud Dovetail Technologies GmbH", "bafmud dovetail tech. gmbh", "Bafmud Dovetail", "BAFMUD / DOVETAIL TECHNOLOGIES", "Technologies, Bafmud Dovetail", "Dovetail Technologies Bafmud", "bafmuddovetail.example", "Bafmud Dovetail Technologies (BDT)",
     "Bafmdu Dovetail Technologies", "Báfmud  Dovetail Technologies G.m.b.H.", "BafmudDovetail", "The Bafmud Dovetail Technologies group", "Bafmud d/b/a Dovetail Technologies"],
    ["Bafmud Kernel Media LLC", "Bafmud Kernel Mdia", "bafmud kernel"],
    ["Elizabeth Korzanowski", "Korzanowski, Liz", "E. Korzanowski", "Elizabeth J. Korzanowski", "Elizabeth Korzanowski (Liz)", "elizabteh korzanowski", "Korzanowski, E."],
    ["Daniel Korzanowski", "Dan Korzanowski"],
    ["???"],
]


def test_names(spark):
    flat = [n for g in GROUPS for n in g]
    df = spark.createDataFrame([(n,) for n in flat + flat[:3]] + [(None,), ("",)], "name string").withColumn("class_id", F.lit(1)).withColumn("key", F.lit(""))
    got = {(r["name_a"], r["name_b"]) for r in names.spelling_pairs(df).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2)}
    assert got == want
    assert names.link_names(df).count() == len(flat)
    assert names.spelling_pairs(df.limit(0)).count() == 0


def test_one_word_names_need_the_same_business(spark):
    rows = ["Acmelor Media", "Acmelor Analytics", "Acmelor Identity Group", "ACMELOR MEDIA Ltd", "Acmelor Analytcs", "Acmelor"]
    got = {r["name"]: r["class_id"] for r in names.link_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    assert got["Acmelor Media"] == got["ACMELOR MEDIA Ltd"] and got["Acmelor Analytics"] == got["Acmelor Analytcs"]
    assert len(set(got.values())) == 4
    two = {r["name"]: r["class_id"] for r in names.link_names(spark.createDataFrame([(x,) for x in rows[:1] + rows[5:]], "name string")).collect()}
    assert len(set(two.values())) == 1


def test_short_and_long_keys(spark):
    rows = ["Hotjar"] * 30 + ["Hotjra"] + ["Horjar"] * 30 + ["Hotjarr", "Botjar"] + ["Gregorovius Pemberton", "Gregorovuis Pembetron", "Mary Ann Vandersmith", "Vandersmith, Mary Ann", "Bob Lee Stone", "Stone, Robert Lee"]
    got = {r["name"]: (r["class_id"], r["n_links"]) for r in names.linked_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    same = lambda a, b: got[a][0] == got[b][0]
    assert same("Hotjar", "Hotjra") and same("Hotjar", "Hotjarr") and not same("Hotjar", "Horjar") and not same("Hotjar", "Botjar")
    assert same("Gregorovius Pemberton", "Gregorovuis Pembetron") and same("Mary Ann Vandersmith", "Vandersmith, Mary Ann") and same("Bob Lee Stone", "Stone, Robert Lee")
    assert got["Hotjar"][1] == 2 and got["Botjar"][1] == 0


def test_ambiguous_initial_links_to_nobody(spark):
    df = spark.createDataFrame([("Daniel Korzanowski",), ("Deborah Korzanowski",), ("D. Korzanowski",)], "name string")
    assert names.spelling_pairs(df).count() == 0


def test_established_words_are_not_typos(spark):
    rows = [(f"{c} {n}",) for n in ("Gable", "Sable") for c in ("Zortuman", "Plixeran", "Quandiro", "Wexalopi", "Brintoko", "Hulvenar", "Jastimor", "Kopradel", "Lumfiget")]
    df = spark.createDataFrame(rows, "name string")
    assert names.spelling_pairs(df).count() == 0


def test_masks():
    a = mainbody.masked("Write to a@b.example on 3 March 2024 at https://x.example/y, section 12.")
    assert a == mainbody.masked("write to  zz@c.example on 14 July 2023 at https://other.example/z, section 7.") and "march" not in a and "example" not in a
    assert mainbody.masked("We may march on") == "we may march on" and mainbody.masked("") == ""


def test_deep_markup(spark):
    deep = "<html><head><title>T</title></head><body>" + "<div>x" * 5000 + "<p>inner</p>" + "</div>" * 5000 + "<h1>T</h1></body></html>"
    pages = spark.createDataFrame([("a", deep, ["x", "inner", "T"]), ("b", deep.replace("inner", "other"), ["x", "other", "T"]), ("c", "<div>" * 20000, []), ("d", None, None)], "doc_id string, raw string, segments array<string>")
    docs = spark.createDataFrame([(x, "https://h.example/" + x) for x in "abcd"], "doc_id string, url string")
    got = {r["doc_id"]: r["body"] for r in mainbody.main_bodies(pages, docs).collect()}
    assert set(got) == {"a", "b", "c", "d"} and "T" in got["a"]


def test_head_without_end():
    _, leaves, title = mainbody.parse("<html><head><title>T</title><meta x=1><script>if (a<b) {}</script><p>a</p><p>b</p>")
    assert title == "T" and [x.text for x in leaves] == ["a", "b"]
    _, leaves, title = mainbody.parse("<head><title>A &lt; B</title><style>p{}</style></head>text")
    assert title == "A < B" and [x.text for x in leaves] == ["text"]


def test_varying_prose_decides_where_the_title_is_elsewhere(spark):
    """The title stands in a banner; the body is where prose varies."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, docs = [], []
    for k in range(30):
        paras = [" ".join(word() for _ in range(25)) for _ in range(4)]
        segs = ["Home", "Partners", f"Notice {k}", *paras, "All rights reserved by the operator of this site and nobody else, whatever is said elsewhere on it."]
        raw = f"<title>Notice {k}</title><ul class=nav><li>Home<li>Partners</ul><div class=banner><h1>Notice {k}</h1></div><div class=text>" + "".join(f"<p>{p}</p>" for p in paras) + f"</div><div class=foot><p>{segs[-1]}</p></div>"
        rows.append((f"d{k}", raw, segs))
        docs.append((f"d{k}", f"https://one.example/{k}"))
    p, d = spark.createDataFrame(rows, "doc_id string, raw string, segments array<string>"), spark.createDataFrame(docs, "doc_id string, url string")
    got = {(r["doc_id"], r["seg_pos"]) for r in mainbody.boilerplate_segments(p, d).collect()}
    assert {x for _, x in got} == {0, 1, 2, 7} and all((f"d{k}", 7) in got for k in range(30))
    r = {x["rule"]: x["n"] for x in mainbody.decisions(p, d).collect() if x["main_body"]}
    assert r == {"body": 120}


@pytest.mark.parametrize("size", [60, 150, 210, 400])
def test_messages_of_any_length(size):
    text = "The page you asked for could not be found on this server."
    more = " Check the address for typing errors or go back to the start page."
    while len(text) < size:
        text += more
    assert residue.flag_line(text) & 8
    assert residue.flag_line(("We keep records of your visits and of the forms you fill in. " * 8)[:size] + " If a page is not found, we log it.") & 8 == 0


def test_groups_of_masked_lines(spark):
    """A line that says nothing goes with messages beside which it stands on several hosts; numbers and addresses in it don't matter."""
    rows, docs = [], []
    for k in range(8):
        segs = ["Page not found", f"Ticket {k * 37} of <b>ops{k}@h{k}.example</b>".replace("<b>", "").replace("</b>", "")]
        rows.append((f"m{k}", f"<title>Oops</title><div><h1>Oops</h1><p>{segs[0]}</p><p>{segs[1]}</p></div>", ["Oops", *segs]))
        docs.append((f"m{k}", f"https://h{k}.example/x"))
    body = ["We share names with partners. " * 4, "Ask the clerk about it. " * 6]
    rows += [("p", f"<title>P</title><div><h1>P</h1><p>{body[0]}</p><p>{body[1]}</p></div>", ["P", *body]), ("q", "<title>Oops</title><div><h1>Oops</h1><p>Page not found</p><p>Our own words stand here alone.</p></div>", ["Oops", "Page not found", "Our own words stand here alone."])]
    docs += [("p", "https://p.example/"), ("q", "https://q.example/")]
    p, d = spark.createDataFrame(rows, "doc_id string, raw string, segments array<string>"), spark.createDataFrame(docs, "doc_id string, url string")
    got = {r["doc_id"] for r in residue.residue_documents(p, d).collect()}
    assert got == {f"m{k}" for k in range(8)}
