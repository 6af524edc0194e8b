import pytest

from skyweave.llm import html_text, language

from .fixtures import clashing, rows, table

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/">Home</a></ul></nav></header><div id="cookie-notice">We use cookies, yes, we do, really.</div>
<div class="wrap"><div class="post-body"><h2>Title &amp; more</h2><p>First   paragraph, with commas, and&nbsp;enough text to count.<p>Second<br>line, <b>bold</b> and <i>more.
<ul><li>one<li>two <a href="/x">link</a></ul><div class="ad-box">Buy now, cheap, fast, today, all of you out there.</div><blockquote>Said so.</blockquote><p>Last.</p></div>
<aside><p>Side, text, with, many, commas, to, tempt, the, scorer, into, it.</p></aside></div>
<form><p>Your name, please, here</p><input></form><section id="comments"><p>Nice one, thanks, really, a lot, good, work, this is long.</p></section><footer>(c) us</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph, with commas, and enough text to count.\nSecond line, bold and more.\none\ntwo link\nSaid so.\nLast."


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article><p>x</article><article class='comment'><p>y, z, w, and, so, on</article>", "x"),
        ("<div><section><p>One, two, three, four, five and more text.</p></section><section><p>Ok.</p></section></div>", "One, two, three, four, five and more text.\nOk."),
        ("<main><h1>H</h1><p>t</main><footer>f", "H\nt"), ("<p>&lt;b&gt; &#233; &eacute;", "<b> é é"), ("<!-- <p>x</p> --><p>y", "y"), ("<p>cut <b", "cut"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<article><div class='post-header'><h1>H</h1></div><p>t<ul><li><a href=x>see</a></ul></article>", "H\nt\nsee"), ("</p></div>x", "x"), ("<div hidden>no</div><p>yes", "yes"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_shapes(page, text):
    assert html_text.main_text(page) == text


PROSE = "Lorem ipsum, dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."
THREE = " ".join([PROSE] * 3)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<main><article><p>{THREE}</article><article><p>A second one, short but there.</article></main>", f"{THREE}\nA second one, short but there."),
        (f"<body><form id=f><div id=head>Site</div><div class=content><h1>T</h1><p>{THREE}<p>{PROSE}</div><input><button>Go</button></form>", f"T\n{THREE}\n{PROSE}"),
        (f"<body><h1>N</h1><div class=reviews><p>{THREE}<p>{PROSE}</div>", f"N\n{THREE}\n{PROSE}"),
        (f"<article><p>{THREE}<div class=alert-system><p>The alert system, as built, works.</div><section id=legal-history><p>Its legal history, in short.</section></article>", f"{THREE}\nThe alert system, as built, works.\nIts legal history, in short."),
        (f"<div><p>{PROSE}</p>Bare text that follows the paragraph, and is part of it.<div class=x><p>{THREE}</div></div>", f"{PROSE}\nBare text that follows the paragraph, and is part of it.\n{THREE}"),
        (f"<div class=c><p>{THREE}</p><ul><li><a href=1>One source</a><li><a href=2>Other source</a></ul><p>{PROSE}</div>", f"{THREE}\nOne source\nOther source\n{PROSE}"),
        (f"<main><article><p>{THREE}</article><ul><li>Bob: nice<li>Eve: thanks a lot</ul></main>", THREE),
        (f"<main><h1>T</h1><p>{PROSE}<h2>3 Comments</h2><ul><li>Bob: nice, really, good, great, super, wow, yes</ul></main>", f"T\n{PROSE}"),
        (f"<article><p>{PROSE}<article><p>A reader says, this is good.</article></article>", PROSE), (f"<article><p>Short one, ok.</article><section id=comments><p>{THREE}{THREE}</section>", "Short one, ok."),
        ("<div class=ad>Buy this, all of you, now, today, or never, we say.</div><article><h1>T</h1><p>Short.</article>", "T\nShort."), ("<div class=ad>Buy this, all, now.</div><article><h1>Only a title</h1></article>", "Only a title"),
        (f"<article><h1>T</h1><div class=reviews><p>{THREE}</div></article>", f"T\n{THREE}"),
        (f"<div class='sidebar-left wrapper'><div class=post-header><h1>T</h1></div><p>{THREE}</div><div class=sidebar>Other things, of no matter.</div>", THREE), ("<article><p>Let <math><mi>x</mi></math> be.</article>", "Let x be."),
    ],
)
def test_scores_decide(page, text):
    assert html_text.main_text(page) == text


def planted(seed: int) -> tuple[str, str]:
    """A page and its article, with things around and in it that are not of it."""
    import random

    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum,", "dolor", "sit", "amet,", "elit", "sed"]) for _ in range(n)) + "."
    junk = [
        lambda: "<div class=ad>Buy now, all of you.</div>", lambda: "<aside><p>Side, note, here.</p></aside>", lambda: "<script>var a = '<p>no</p>';</script>", lambda: "<form><label>Your name</label><input></form>", lambda: "<!-- <p>not this</p> -->",
        lambda: f"<div id='cookie-notice'>{words(8)}</div>", lambda: "<nav><ul><li><a href=/>Home</a></ul></nav>", lambda: f"<ul class='related-posts'><li><a href=/x>{words(4)}</a></ul>", lambda: "<style>p{}</style>", lambda: f"<div class=share-buttons>{words(3)}</div>",
    ]
    body, text = [], []
    for _ in range(rng.randint(3, 9)):
        kind, t = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "table", "pre", "div"]), words(rng.randint(12, 40))
        marked = t.replace("dolor", rng.choice(["<b>dolor</b>", "do<i>lor</i>", "<a href=/d>dolor</a>", "dolor"]), 1).replace(" sit ", rng.choice([" sit ", "\n\t sit&#32;", " sit&nbsp;"]), 1)
        body.append({"li": f"<ul><li>{marked}</ul>", "table": f"<table><tr><td>{marked}</table>", "blockquote": f"<blockquote><p>{marked}</blockquote>"}.get(kind, f"<{kind}>{marked}</{kind}>"))
        text.append(t)
        if rng.random() < 0.4:
            body.append(rng.choice(junk)())
    holder = rng.choice(["article", "div class=content", "main", "section id=story", "div"])
    page = "".join(["<!doctype html><html><head><title>T</title></head><body>", "<header><h1>Site</h1></header>", *(j() for j in rng.sample(junk, 3)), f"<{holder}>", *body, f"</{holder.split()[0]}>", f"<section class=comments><p>{words(30)}</p></section>", *(j() for j in rng.sample(junk, 2)), "<footer>Us, all rights.</footer></body></html>"])
    return page, "\n".join(text)


@pytest.mark.parametrize("seed", range(150))
def test_planted_articles(seed):
    page, text = planted(seed)
    assert html_text.main_text(page) == text


def naive_points(e, root) -> float:
    """An element's score from its definition: every paragraph below it, by its distance."""
    total = 0.0
    for owner, text in html_text.blocks(root):
        if owner.tag in html_text.HEADINGS:
            continue
        at = owner if owner.tag in ("div", "section", "article", "main", "body", "html", "td", "form") else owner.parent
        level = 1
        while at and at is not e:
            at, level = at.parent, level + 1
        if at is e:
            points = min(len(text) / 100, 3) + sum(text.count(c) for c in ",،、，") + (len(text) >= 25)
            points *= 1 - (html_text.density(owner) if owner.tag in ("p", "li", "td", "dd", "dt") else 0)
            total += points / (1 if e.tag in ("article", "main") else level)
    total *= 1 - html_text.density(e)
    return total * (1.25 if e.tag == "article" else 1.1 if html_text.marks(e) & html_text.LIKELY and e.tag not in ("main", "body", "html") else 1)


@pytest.mark.parametrize("seed", range(20))
def test_scores_are_those_of_the_definition(seed):
    tree = html_text.Tree()
    tree.feed(planted(seed)[0])
    html_text.cleared(tree.root)
    html_text.weighed(tree.root)
    for e in html_text.scored(html_text.blocks(tree.root)):
        assert abs(e.points - naive_points(e, tree.root)) < 1e-6


def test_long_and_deep_pages():
    many = "".join(f"<p>{PROSE} {i}</p>" for i in range(20_000))
    assert html_text.main_text(f"<article>{many}</article>").count("\n") == 19_999
    for hard in ("<div>" * 50_000 + PROSE, "<" * 200_000, "<p " * 100_000, "<!--" * 100_000, "&" * 300_000, "<a href=" * 50_000, "</p>" * 100_000, "<p>a" * 50_000, "<![CDATA[" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<a title=\"x>" + "<b>" * 50_000, "<a '>" * 50_000, "<script>" * 50_000):
        assert isinstance(html_text.main_text(hard), str)


def test_ties_go_to_the_first():
    assert html_text.main_text(f"<div><div class=a><p>{PROSE}</p></div></div><div><div class=b><p>{PROSE}</p></div></div>").startswith(PROSE)


def test_extracted(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id bigint, url string, html string")
    out = html_text.extracted(clashing(pages)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert html_text.extracted(pages.limit(0)).collect() == []


WORDS = {"aa": ["kora", "tuni", "beko", "lami"], "bb": ["xyrr", "wytt", "zxqu", "vwyk"], "cc": ["señor", "niña", "años", "caña"]}


def corpus(n=240):
    import random

    rng = random.Random(8)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))) + " 12!", lang, "s", 1) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy(spark):
    data = corpus()
    out = {r.doc_id: r for r in language.languages(clashing(table(spark, data))).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [r for r in data if out[r[0]].held_out]
    assert len(held) > 30 and all(out[r[0]].lang_pred == r[2] and 0.9 <= out[r[0]].score <= 1 for r in held)


def test_filters_return_all_languages_of_an_ngram():
    grams = {k: language.grams(" ".join(v)) for k, v in WORDS.items()}
    filters = language.LanguageFilters.of(grams | {"dd": grams["aa"]})
    cover = dict(zip(filters.languages, filters.coverage(grams["aa"]), strict=True))
    assert cover["aa"] == cover["dd"] == 1 and cover["bb"] < 0.1
    assert filters.predict("tuni beko")[0] == "aa"
    many = language.LanguageFilters.of({f"l{i}": grams["bb"] if i == 70 else grams["cc"] for i in range(80)})
    assert many.predict("xyrr wytt zxqu")[0] == "l70"


def test_language_edge_cases(spark):
    data = [*corpus(60), *rows(), (901, "123 ... !!", None, None, None), (902, None, "aa", None, None)]
    out = language.languages(clashing(table(spark, data)))
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert len(got) == len(data)
    assert {(p, s) for i, p, s in got if i in (901, 902)} == {("und", 0.0)}
    assert {r.lang_pred for r in language.languages(table(spark, [(1, "abc", None, None, None)])).collect()} == {"und"}
    assert language.languages(table(spark, [])).collect() == []
    kept = language.keep_identified(clashing(table(spark, data)))
    assert {901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and set(range(60)) - {0, 1, 2} <= {r.doc_id for r in kept.collect()}


def test_pieces_of_long_texts_have_the_same_grams(monkeypatch):
    text = "Ab, cd  efg\n" * 50 + "x" * 300 + " é  ü. " * 40
    whole = sorted(language.grams(text).tolist())
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(language, "PIECE", size)
        assert "".join(language.pieces(text)) == text and sorted(h for p in language.pieces(text) for h in language.grams(p).tolist()) == whole


def test_long_texts_are_read_whole():
    filters = language.LanguageFilters.of({k: language.grams(" ".join(v)) for k, v in WORDS.items()})
    assert filters.predict("kora " * 100 + "xyrr wytt zxqu vwyk " * 5000)[0] == "bb"


SIX = "".join(f"<p>Paragraph number {i} of the article, with a comma, goes on for a while and ends here.</p>" for i in range(6))
SIX_TEXT = "\n".join(f"Paragraph number {i} of the article, with a comma, goes on for a while and ends here." for i in range(6))
ONE = "<p>About this site, a short note, stands beside it.</p>"
COMMENT = "<div class='comment'><span class='author'>Bob</span> <time>May 2</time><p>I like this, really, very much indeed.</p></div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='discussion'>{SIX}</div><div class='info'>{ONE}</div>", SIX_TEXT),
        (f"<div class='newsletter'>{SIX}</div><div class='info'>{ONE}</div>", SIX_TEXT),
        (f"<article>{SIX}<h2>Responses</h2>{ONE}<h2>Methods</h2>{ONE}</article>", f"{SIX_TEXT}\nResponses\nAbout this site, a short note, stands beside it.\nMethods\nAbout this site, a short note, stands beside it."),
        (f"<article>{SIX}<h2>Responses</h2>{COMMENT}<h2>Methods</h2>{ONE}</article>", f"{SIX_TEXT}\nMethods\nAbout this site, a short note, stands beside it."),
        (f"<article><h1>Book</h1><article><h2>One</h2>{SIX}</article><article><h2>Two</h2>{SIX}</article></article>", f"Book\nOne\n{SIX_TEXT}\nTwo\n{SIX_TEXT}"),
        (f"<article>{SIX}{SIX}<article><time>May 2</time>{ONE}</article></article>", f"{SIX_TEXT}\n{SIX_TEXT}"),
        (f"<body><script>x()</script><noscript><article>{SIX}</article></noscript></body>", SIX_TEXT),
        (f"<div class='post'>{ONE}</div><div class='comments'>{COMMENT * 9}</div>", "About this site, a short note, stands beside it."),
        (f"<main>{SIX}<section class='discussion'>{COMMENT}{COMMENT}</section></main>", SIX_TEXT),
    ],
)
def test_names_decide_less_than_points(page, text):
    assert html_text.main_text(page) == text
