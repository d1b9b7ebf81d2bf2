import pytest

from basketlens.llm.text_density import extract, main_text

STORY = ["The first paragraph of the story is long enough to count as text.", "The second one goes on, with more words than the first had.", "And a third ends it."]
BODY = "".join(f"<p>{p}</p>" for p in STORY)
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(8)) + "</ul>"
PAGES = {
    "article": f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{LINKS}</nav><article>{BODY}</article><footer>&copy; x</footer></body></html>",
    "divs": f"<body><div id='top-menu'>{LINKS}</div><div class='content'>{BODY}</div><div class='sidebar'>{LINKS}<p>Words in the sidebar that are not the story.</p></div></body>",
    "comments": f"<body><main>{BODY}<div class='comments'><p>{'A reader wrote a very long comment here. ' * 20}</p></div></main></body>",
    "notice": f"<body><div class='cookie-notice'><p>{'We use cookies on this site to do things. ' * 5}</p></div><article>{BODY}<aside>Related stories</aside><form>Mail <input></form></article></body>",
    "unclosed": f"<body><div><article>{'<p>'.join(['', *STORY])}<script>var x = '<p>no</p>'</script></article>",
    "links inside": f"<body><article>{BODY}<div>{LINKS}</div></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert main_text(PAGES[name]) == "\n".join(STORY)


def test_blocks_space_and_references():
    html = "<body><article><h1>A &amp; B</h1><p>one\n  <b>two</b>three<br>four &#233;&eacute;&nbsp;x &lt;tag&gt;<!-- no --></p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>"
    assert main_text(html) == "A & B\none twothree\nfour éé x <tag>\na\nb\nc\nd"


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p", "<p"), ("<div></div>", ""), ("<a href='x>y</a> z", "y z"), ("<b>x</i></b>", "x"),
                                       ("<script>alert(1)", ""), ("<!-- open", ""), ("<nav>only menu</nav>", ""), ("&lt;b&gt; &amp", "<b> &")])
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_long_page_is_read_whole():
    paragraphs = [f"Paragraph {i} has a number of words in it." for i in range(5000)]
    assert main_text("<body><div>" + "".join(f"<p>{p}" for p in paragraphs) + "</div>").split("\n") == paragraphs


def test_table(spark):
    rows = [(1, "u", PAGES["divs"], 5), (1, "u", PAGES["divs"], 5), (2, None, None, None)]
    out = extract(spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"]) for r in out.collect()) == [(1, len("\n".join(STORY)))] * 2 + [(2, 0)]
    assert extract(spark.createDataFrame(rows, "page_id int, url string, html string, x int").limit(0)).count() == 0


LONG = [f"Paragraph {i} of the other part is long as well, with words enough to count as text." for i in range(8)]
QUOTES = [" ".join([x] * 4) for x in LONG[:2]]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("html,want", [
    (f"<body><article>{paragraphs(QUOTES)}<article>{paragraphs(LONG * 2)}</article></article></body>", QUOTES + LONG * 2),
    (f"<body><div><article>{paragraphs(LONG)}</article><article>{paragraphs(LONG[::-1])}</article></div></body>", LONG + LONG[::-1]),
    (f"<body><div>{paragraphs(LONG)}<article><p>A short teaser.</p></article></div><div>{paragraphs(LONG)}</div></body>", [*LONG, "A short teaser.", *LONG]),
    (f"<body><article><p>A short teaser.</p></article><div>{paragraphs(LONG)}</div></body>", LONG),
    (f"<body><article><h1>Title</h1><div>{paragraphs(LONG)}</div></article></body>", ["Title", *LONG]),
], ids=["nested", "siblings", "teaser in the core", "teaser beside", "title beside the core"])
def test_sums_and_threshold_choose_among_articles(html, want):
    assert main_text(html).split("\n") == want


@pytest.mark.parametrize("odd", ["<svg/>", "<svg width='4'/>", "<math />", "<noscript>", "<template>", "<svg><title>t</title><path d='1'/><text>no</text></svg>", "<noscript><div><p>no</noscript>",
                                 "<template><p>no</p><svg><g>no</template>"])
def test_skipped_elements_do_not_swallow_the_page(odd):
    for html in (f"<body><article><h1>Title</h1>{odd}{BODY}</article></body>", f"<body><div><h1>Title</h1><p>{STORY[0]}{odd}</p>{''.join(f'<p>{p}</p>' for p in STORY[1:])}</div></body>"):
        assert main_text(html) == "\n".join(["Title", *STORY])


def test_skipped_element_inside_a_paragraph():
    assert main_text(f"<body><article><p>One <noscript><p>no</p></noscript>two</p>{BODY}</article></body>") == "\n".join(["One two", *STORY])


def test_many_open_tags_stay_linear():
    assert main_text(f"<body><article>{'<svg>' * 20000}{BODY}</article></body>") == "\n".join(STORY)


def test_title_and_short_parts_beside_the_core():
    long, other = paragraphs(LONG), paragraphs(LONG[::-1])
    assert main_text(f"<body><nav><h1>Site</h1></nav><div><h1>Title</h1></div><div>{long}</div></body>").split("\n") == ["Title", *LONG]
    assert main_text(f"<body><div><div>{long}</div><div><p>Short.</p></div><ul><li><a href='/'>Link</a></li></ul><div>{other}</div></div></body>").split("\n") == [*LONG, "Short.", *LONG[::-1]]


def plain_density(html):
    """Composite text density written out node by node on a tree of the standard parser: (tag, sum) of the largest sum."""
    import math
    import xml.etree.ElementTree as ET
    root = ET.fromstring(html)

    def counts(e, linked=False):
        linked = linked or e.tag == "a"
        own = [len(t.strip()) for t in [e.text, *[c.tail for c in e]] if t and t.strip()]
        kids = [counts(c, linked) for c in e]
        c, lc = sum(own) + sum(k["c"] for k in kids), sum(own) * linked + sum(k["lc"] for k in kids)
        return {"e": e, "own": own, "linked": linked, "kids": kids, "c": c, "lc": lc, "t": sum(k["t"] + 1 for k in kids), "lt": sum(k["lt"] + (k["e"].tag == "a") for k in kids)}

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        inner = c / max(lc, 1) * max(t, 1) / max(lt, 1)
        return c / max(t, 1) * (math.log(inner) / math.log(base) if base > 1 + 1e-9 else math.log(c + 1.0))

    top = counts(root)
    ratio = top["lc"] / top["c"]
    best = []

    def walk(n):
        best.append((sum(density(k["c"], k["t"], k["lc"], k["lt"]) for k in n["kids"]) + sum(density(c, 1, c * n["linked"], int(n["linked"])) for c in n["own"]), n["e"]))
        for k in n["kids"]:
            walk(k)
    walk(top)
    return max(best, key=lambda b: b[0])[1]


@pytest.mark.parametrize("seed", range(12))
def test_core_is_the_largest_sum_of_a_plain_reading(seed):
    import random
    draw = random.Random(seed)

    def part(depth):
        if depth == 0 or draw.random() < 0.3:
            words = " ".join(draw.choice(["long", "text", "of", "words"]) + str(draw.randrange(999)) for _ in range(draw.choice([2, 8, 40])))
            return f"<p>{words}</p>" if draw.random() < 0.7 else f"<p><a href='x'>{words}</a></p>"
        return f"<div>{''.join(part(depth - 1) for _ in range(draw.randrange(1, 5)))}</div>"
    html = f"<body>{''.join(part(3) for _ in range(4))}</body>"
    core = " ".join("".join(plain_density(html).itertext()).split())
    joined = "".join(main_text(html).split())
    plain = ["".join(t.split()) for e in [plain_density(html)] for p in (e.iter("p") if e.tag != "p" else [e]) for t in ["".join(p.itertext())] if p.find("a") is None]
    assert core and all(t in joined for t in plain)
