from corpusloom.llm import html as M


def test_held_out_pages():
    right = total = 0
    for page in M.labelled_pages(80, seed=1234):
        found = M.blocks(page)
        right += sum((b.truth is not False) == y for b, y in zip(found, M.trained().decode(found)))
        total += len(found)
    assert right / total > 0.985


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li>
<li><a href=y>More</a></li></ul></nav><!-- ad --><div class="ad">Buy this thing now.</div><article><h1>A &amp; B</h1><p><b>First
 \t line.<br>again <a href=z>here</a><p>Second caf&eacute; &#8364; para&nbsp;graph, with words.</p>Loose tail.</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot.</p></div></section><form><label>Mail</label><select><option>One</select></form>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=q>Other story</a></ul></aside><footer>&copy; x &middot; All rights.</footer></body></html>"""


def test_page():
    assert M.extract(PAGE) == "A & B First line. again here Second café € para graph, with words. Loose tail."


def test_truncated_and_broken():
    assert M.extract(PAGE[: PAGE.index("para&nbsp;") + 7]).endswith("Second café € para&nb")
    assert M.extract("<article><p>One two three four.<div>Five <b>six</div><p>seven &am") == "One two three four. Five six seven &am"
    for bad in (None, "", "   ", "<<<", "<p", "<!--", "<script>x", "<a href='", "&#0; &#x110000; &", "</p></p>"):
        assert isinstance(M.extract(bad), str)
    assert M.extract(None) == M.extract("") == ""


def test_long_page():
    body = "".join(f"<p>Paragraph {i} has a few words in it.</p>" for i in range(20_000))
    text = M.extract(f"<body><article><h1>Long</h1>{body}</article></body>")
    assert text.startswith("Long Paragraph 0 ") and text.endswith("19999 has a few words in it.") and text.count("Paragraph") == 20_000
    M.extract("<div>" * 3000 + "x" + "</div>" * 3000)


def test_viterbi_is_best():
    from itertools import product

    model = M.trained()
    found = M.blocks(PAGE)[:9]
    score = [sum(model.weights.get(f, 0.0) for f in fs) for fs in M.block_features(found)]

    def total(ys):
        return sum(s for s, y in zip(score, ys) if y) + sum(model.moves[2 * a + b] for a, b in zip(ys, ys[1:]))

    assert abs(total(model.decode(found)) - max(map(total, product((False, True), repeat=len(found))))) < 1e-9


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in M.extract_pages(df).collect()], key=str)
    text = M.extract(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert M.extract_pages(df.limit(0)).count() == 0


def test_self_closed_svg_hides_nothing():
    want = M.extract(PAGE)
    for icon in ('<svg class="icon"/>', "<math/>", '<SVG viewBox="0 0 1 1" />'):
        assert M.extract(PAGE.replace("First", icon + "First")) == want, icon
    assert M.extract(PAGE.replace("First", "<svg><path d='x'/><text>hidden</text></svg>First")) == want
    assert M.extract(PAGE.replace("First", "<svg/><svg><text>hidden</text></svg><svg/>First")) == want
    assert M.extract(PAGE.replace("First", "<script src=x />hidden</script>First")) == want  # a slash does not close a script


def test_unclosed_head():
    want = M.extract(PAGE)
    bare = PAGE.replace("</head><body>", "").replace("</body>", "")
    assert M.extract(bare) == M.extract(bare.replace("<head>", "<head><meta charset=x><link rel='a>b' href=y/><!-- </p> --><base>")) == want
    assert [b.text for b in M.blocks("<head><title>T</title> Words at once <p>more")] == ["Words at once", "more"]
    assert [b.text for b in M.blocks("<p>one<head><meta a=b><title>T</title><p>two<head><p>three<head>")] == ["one", "two", "three"]
    assert [b.text for b in M.blocks("<head><title>T</title></head><p>one<head><div>x</div></head><p>two")] == ["one", "x", "two"]
    assert M.blocks("<head><title>T</title>") == M.blocks("<head") == M.blocks("<head><script>x") == []
    M.blocks("<head>" * 100_000)


ARTICLE = "<article><h1>A long title of it</h1><p>Some words are here, and more.</p></article>"
WANT = "A long title of it Some words are here, and more."


def test_pages_with_left_out_tags_keep_their_article():
    for page in (
        f"<html><head><title>t</title>{ARTICLE}</html>",
        f"<head><title>t</title><meta charset=x>{ARTICLE}",
        f"<head><title>t</title><div class=ad>Buy it</div></head>{ARTICLE}",
        f"<title>t</title>{ARTICLE}".replace("<title>t</title>", "<head><title>t</head>"),
        f"<head><title>t<body>{ARTICLE}",
        f"<head><noscript><img src=x></head>{ARTICLE}",
        f"<head><noscript><img src=x></noscript><template>x</template><title>t</title>{ARTICLE}",
        f"<body><svg class=x/>{ARTICLE}",
        f"<body><svg class=x>{ARTICLE}",
        f"<body><svg><foreignObject><div>in a drawing</div></foreignObject></svg>{ARTICLE}".replace("in a drawing", ""),
        f"<body><math>{ARTICLE}",
        f"<body><!-->{ARTICLE}",
        f"<body><!-- a --!>{ARTICLE}",
        f"<body></ x>{ARTICLE}",
        f"<body><iframe src=x><p>no</p></iframe>{ARTICLE}",
    ):
        assert M.extract(page) == WANT, page


def test_formulas_and_fallbacks_are_blocks():
    assert M.extract("<article><p>We show that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article>") == "We show that x=2 holds for all of them."
    for tag in ("noscript", "object", "audio", "video", "map", "canvas", "template", "datalist"):
        assert [b.text for b in M.blocks(f"<p>One<{tag}>two</{tag}>three")] == ["One", "two", "three"], tag
        assert M.extract(f"<article><p>Some words are here, and more.</p><{tag}><p>Then this is a whole paragraph, and it goes on.").startswith("Some words are here, and more."), tag


def test_unclosed_quotes():
    assert M.extract('<article><p title="abc>Some words are here, and more.</p><p>Second one of these.</p></article>') == "Some words are here, and more. Second one of these."
    assert M.extract("<article><p title=don't>Some words are here, and more.</p><p class='a'>Second one of these.</p></article>") == "Some words are here, and more. Second one of these."
    assert M.extract('<article><p title="a > b">Some words are here, and more.</p></article>') == "Some words are here, and more."


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        M.extract("<div class=a>" * n + "x" + "</div>" * n)
        M.extract("".join(f"<div class={'abcdefgh'[i % 8]}{'xyzw'[i % 4]}>w{i}." for i in range(n)) + "</q>" * n)
        M.extract("<b>" * n + "<p>x" * n + "</i>" * n)
        return time.process_time() - began

    M.trained()
    assert took(20_000) < 12 * max(took(5_000), 0.2)


# Pages written by hand after common site layouts, none of which the generator knows; 1 before a block of the article.
HAND = [
    """<body class="home blog"><div id="page"><header id="branding"><hgroup><h1>0|My Garden Notes</h1><h2>0|Just another weblog</h2></hgroup></header>
    <div id="access"><a href=/>0|Home</a></div><div id="primary"><div id="content" role="main"><div class="post hentry"><h2 class="entry-title">1|Growing beans on a balcony</h2>
    <div class="entry-content"><p>1|Beans need a pole, some sun and a deep pot.</p><p>1|I water them twice a day in July, and once in a week of rain.</p><ul><li>1|Pick them young.</li><li>1|Dry the rest for seed.</li></ul></div>
    <div class="sharedaddy"><h3>0|Share this:</h3></div></div></div></div><div id="secondary" class="widget-area"><h3>0|Recent Posts</h3><ul><li><a href=a>0|Tomatoes</a></li><li><a href=b>0|Mint</a></li></ul></div>
    <div id="colophon"><div id="site-generator"><a href=w>0|Proudly powered by a tool</a></div></div></div></body>""",
    """<body><div class="topnav"><a href=1>0|News</a> <a href=2>Sport</a> <a href=3>Weather</a></div><main><article class="news"><header><h1>1|Bridge opens after two years</h1>
    <p class="byline">1|By Ana Diaz, 3 May</p></header><p>1|The new bridge over the river was opened on Monday.</p><figure><img src=b.jpg alt=b><figcaption>1|The bridge at night.</figcaption></figure>
    <p>1|Thousands of people walked across it, many of them with children.</p><aside class="related"><h3>0|Read more</h3><a href=x>0|Ferry to stop in June</a></aside><p>1|Cars may use it from Thursday on.</p></article></main>
    <section id="comments"><h2>0|Comments</h2><div class="comment"><p>0|At last, I have waited so long for this.</p></div></section><footer><p>0|© 2024 The Daily. All rights reserved.</p></footer></body>""",
    """<body><div class="cookie-consent">0|We use cookies to improve this site. <button>0|Accept</button></div><nav class="sidebar-nav"><ul><li><a href=a>0|Install</a></li><li><a href=b>0|Usage</a></li></ul></nav>
    <div class="document"><div class="body"><section><h1>1|Installing</h1><p>1|Download the archive and unpack it in a folder.</p><pre>1|tar xf tool.tar</pre><p>1|Then run the command below.</p><pre>1|./tool --help</pre>
    <table><tr><th>1|Option</th><th>1|Meaning</th></tr><tr><td>1|-q</td><td>1|Say nothing at all.</td></tr></table></section></div></div><div class="footer">0|© Copyright 2020. <a href=s>Show source</a></div></body>""",
    """<body><table class="layout"><tr><td class="menu"><a href=1>0|Start</a><br><a href=2>About us</a></td><td><div class="text"><h2>1|The mill at the lake</h2><p>1|The mill was built in 1788 and burned down twice.</p>
    <p>1|Today it is a museum, open from April to October.</p></div></td></tr><tr><td colspan=2 class="bottom">0|Contact: mill at lake dot example</td></tr></table></body>""",
    """<body><div id="mw-page-base"></div><div id="content" class="mw-body"><h1 id="firstHeading">1|Heron</h1><div id="bodyContent"><p>1|Herons are long-legged birds of lakes and coasts; there are some 70 species.</p>
    <h2>1|Food</h2><p>1|They eat fish, frogs and insects, which they catch with a quick thrust of the bill.</p><ol class="references"><li>1|A. Bird, Herons of the World, 1990.</li></ol></div></div>
    <div id="mw-navigation"><h2>0|Navigation menu</h2><ul><li><a href=x>0|Log in</a></li><li><a href=y>0|Create account</a></li></ul></div><div id="footer"><ul><li>0|This page was last edited on 1 May.</li></ul></div></body>""",
    """<body><div class="banner promo">0|Sale! Ten percent off all shoes, this week only.</div><div class="wrap"><section class="story-body"><h1>1|How we test shoes</h1><p>1|Each pair is worn for a hundred kilometres by three runners.</p>
    <blockquote><p>1|A shoe that hurts on the first day will hurt on the last.</p></blockquote><p>1|We then weigh it, and cut it open.</p></section><form class="newsletter-signup"><label>0|Your mail</label><input><button>0|Sign up</button></form></div>
    <div class="social-links"><a href=f>0|Follow us</a></div></body>""",
    # Bare layouts: nothing names the article.
    "<html><body><h1>1|On keeping bees</h1><p>1|A hive needs some room, and a place in the sun.</p><p>1|In spring the bees fly out as soon as it is warm.</p></body></html>",
    "<body bgcolor=white><font face=arial><b>1|Notes of a sailor</b><br><br>We left the port at five in the morning.<p>1|The wind was weak, and we rowed for an hour.</font></body>",
    "<html><body><div><div><div><p>1|The library holds forty thousand books.</p><p>1|Most of them were given by the town's people over the years.</p></div></div></div></body></html>",
    "<table width=100%><tr><td><a href=i>0|Index</a> | <a href=n>Next</a></td></tr><tr><td><p>1|Chapter two tells how the road was built.</p><p>1|It took nine years and the work of many hands.</p></td></tr></table>",
    "<pre>1|RELEASE NOTES  This version mends three faults of the last one. Upgrade soon.</pre>",
    "<body><p>1|My grandmother baked bread every Friday.</p><p>1|She used rye flour, salt and a sour dough that was older than me.</p><hr><p><a href=h>0|Home</a> | <a href=c>Contact</a></p></body>",
    "<div id=x1><div id=x2><h2>1|What the survey says</h2><p>1|Half of those asked take the train; a third of them ride a bike.</p><p>1|Only a few still use a car every day.</p></div></div><div id=x3>0|© 2011 Someone</div>",
    "<body><center><h2>1|Rules of the club</h2></center><ol><li>1|Be on time for every meeting.</li><li>1|Bring your own cup and plate.</li><li>1|Leave the room as you found it.</li></ol></body>",
    "<html><body><dl><dt>1|Anchor</dt><dd>1|A heavy piece of iron that holds a ship in its place.</dd><dt>1|Bow</dt><dd>1|The front of a ship.</dd></dl></body></html>",
    "1|A page without any tag at all, as servers sometimes send it. It has two sentences.",
    "<span>1|One line of text in a span, with nothing around it.</span>",
    "<body><h3>1|Recipe for soup</h3><ul><li>1|Two onions, cut into rings.</li><li>1|A litre of water or broth.</li></ul><p>1|Cook it all for twenty minutes, and serve it hot.</p></body>",
    # Other sites.
    """<div class="gnb"><ul><li><a href=1>0|Top</a></li><li><a href=2>0|World</a></li></ul></div><div class="article_view"><h3 class="tit_view">1|Rain expected in the north</h3><p>1|Heavy rain is expected in the north of the country on Tuesday.</p><p>1|People are asked to stay away from rivers.</p></div><div class="ad_wrap">0|Get a loan today.</div>""",
    """<header><a href=/>0|The Post</a><nav><a href=a>0|Politics</a></nav></header><main><div class="lede"><h1>1|A town without cars</h1><p>1|For ten years no car has driven through the old town.</p></div><p>1|Shops feared for their trade; it doubled instead.</p><div class="newsletter">0|Sign up for our letter.</div><p>1|Other towns now want to do the same.</p></main><footer>0|About us</footer>""",
    """<div id="forum"><div class="topic"><h2>1|How do I sharpen a chisel?</h2><div class="message"><p>1|I bought an old chisel and it is quite blunt, what stone should I use?</p></div></div></div><div class="copyright">0|Powered by a board.</div>""",
    """<nav class="breadcrumb"><a href=1>0|Docs</a> / <a href=2>API</a></nav><article class="markdown-body"><h1>1|Queue</h1><p>1|A queue holds items until a worker takes them.</p><pre>1|queue.put(item)</pre><h2>1|Limits</h2><p>1|It holds a thousand items at most.</p></article><nav class="pagination"><a href=3>0|Previous</a></nav>""",
    """<div class="cookie-bar"><p>0|This site uses cookies to count its visitors.</p></div><div class="layout"><div class="col-main"><h1>1|The oldest tree</h1><p>1|In a valley in the south stands a tree of three thousand years.</p><p>1|Nobody is told where exactly it is.</p></div><div class="col-side sidebar"><h4>0|Most read</h4><ol><li><a href=x>0|The tallest tree</a></li></ol></div></div>""",
    """<body><div class="menu"><a href=1>0|Home</a></div><div class="story"><h1>1|Cup won at last</h1><div class="meta">1|12 June, by R. Stone</div><p>1|After ninety minutes and a penalty the cup was theirs.</p></div><div class="comments"><div class="comment"><p>0|What a match that was!</p></div><div class="comment"><p>0|The penalty was a gift, if you ask me.</p></div></div></body>""",
    """<body><div role="navigation"><ul><li><a href=a>0|Shop</a></li></ul></div><div role="main"><h1>1|Wool blanket</h1><p>1|Woven from the wool of mountain sheep, it keeps you warm in any winter.</p><p>1|Wash it by hand in cold water.</p></div><div role="contentinfo">0|© Blanket makers</div></body>""",
    """<div class="wrapper"><div class="topbar"><a href=l>0|Log in</a></div><section class="post"><header><h1>1|Why I walk to work</h1></header><div class="entry"><p>1|It is four kilometres, along a canal and through a park.</p><p>1|On the way I think about nothing at all.</p></div><div class="tags"><a href=t>0|walking</a> <a href=u>city</a></div></section></div>""",
    """<body><article><h1>1|Eclipse seen by thousands</h1><p>1|At noon it became dark for two minutes.</p><div class="advertisement">0|Glasses at half the price!</div><p>1|The birds fell silent, and so did the people.</p></article><aside class="recommended"><h3>0|You may also like</h3><a href=m>0|Mars comes closer</a></aside><div class="modal">0|Subscribe to read more.</div></body>""",
    """<body><ul class="menu"><li><a href=1>0|A</a></li><li><a href=2>0|B</a></li></ul><div class="text"><p>1|The first railway here was opened in 1854; it ran to the coast.</p><table><tr><td>1|Length</td><td>1|32 km</td></tr></table></div><form class="search"><label>0|Search</label><input></form></body>""",
    """<main id="main-content"><h1>1|Pay your bill</h1><p>1|You can pay your bill in three ways.</p><ul><li>1|At any post office.</li><li>1|By transfer from your bank.</li></ul></main><footer class="site-footer"><ul><li><a href=p>0|Privacy</a></li></ul><p>0|© City works</p></footer>""",
    """<div class="page"><div class="header"><h1><a href=/>0|Night sky</a></h1></div><div class="content"><h2>1|Finding the pole star</h2><p>1|Follow the line of the two last stars of the wagon, five times their distance.</p></div><div class="share"><a href=s>0|Tweet</a></div><div class="footer">0|All rights reserved.</div></div>""",
    """<body><noscript>0|Please turn on scripts.</noscript><div class="alert">0|The office is closed on Monday.</div><div class="article-body"><p>1|Snails are slow, but they get everywhere.</p><blockquote>1|Never hurry a snail.</blockquote><p>1|So says a proverb of my village.</p></div></body>""",
    """<div><ul><li><a href=1>0|Start</a></li><li><a href=2>0|Team</a></li><li><a href=3>0|Jobs</a></li></ul></div><div><h1>1|We build boats</h1><p>1|Our yard has built boats of wood since 1921, each of them by hand.</p><p>1|Come and see us at work.</p></div>""",
]


BARE = "<p>The council met on Monday to talk about the bridge.</p><p>Most of its members were for it, but some had doubts.</p><p>A vote is planned for next week.</p>"


def test_bare_pages_keep_every_paragraph():
    want = "The council met on Monday to talk about the bridge. Most of its members were for it, but some had doubts. A vote is planned for next week."
    for page in (f"<html><body>{BARE}</body></html>", BARE, f"<div><div>{BARE}</div></div>", f"<table><tr><td>{BARE}</table>", f"<body><center><font>{BARE}</font></center>", f"<html><head><title>t</title></head><body><div id=c7>{BARE}</div></body></html>"):
        assert M.extract(page) == want, page
        assert M.extract(page.replace("<p>", "<h1>Council meets</h1><p>", 1)) == "Council meets " + want, page
    assert M.extract("Plain text without tags. It has a few sentences in it. Nothing more.") == "Plain text without tags. It has a few sentences in it. Nothing more."


def test_head_tags_in_the_body_say_nothing():
    text = "<article><p>We say that the <head> element holds the title of a page.</p><p>It ends at </head> and the body begins.</p><p>This is the last paragraph.</p></article>"
    want = "We say that the element holds the title of a page. It ends at and the body begins. This is the last paragraph."
    assert M.extract(text) == M.extract(f"<html><head><title>t</title></head><body>{text}") == M.extract(f"<html><head><title>t</title>{text}") == want
    assert M.extract(text.replace("<head>", "<title>hidden</title>")) == want and "This is the last" in M.extract(text.replace("<head>", "<title>"))


def test_hand_labelled_pages():
    """Blocks of pages of another source than the training pages: F1 over all blocks."""
    import re

    hit = wrong = lost = 0
    assert len(HAND) >= 30
    for page in HAND:
        truth = [b.text[0] == "1" for b in M.blocks(page)]
        page = re.sub(r"[01]\|", "", page)
        found = M.blocks(page)
        assert len(found) == len(truth) and M.extract(page), page
        for want, got in zip(truth, M.trained().decode(found)):
            hit, wrong, lost = hit + (want and got), wrong + (got and not want), lost + (want and not got)
    print(hit, wrong, lost)
    assert 2 * hit / (2 * hit + wrong + lost) > 0.9


def test_any_markup_is_read():
    """Pages of random pieces of markup, closed or not, in any order."""
    import random

    rng = random.Random(3)
    bits = "<head> </head> <title> </title> <noscript> <template> <style> </style> <script> <p <p> /> > <svg </svg> <math> </div> <!-- --> <! </ text &amp; <br> <body> <foreignObject> </a>".split(" ")
    bits += [" a=", "'", '"', "<div class=x>", "<a href='x'>", " ", "\n"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert isinstance(M.extract(page), str), page
