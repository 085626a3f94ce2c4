"""Articles of common templates, a host each, against their known lines."""

import random

from stratagraph.llm import htmltext

WORDS = "river stone garden winter letter market window music harbour forest paper silver morning travel story kitchen".split()


def line(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def page(rng, kind):
    """A page's body and its article's lines."""
    title, text = line(rng, 4), [line(rng, 25) for _ in range(3)]
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    short = [line(rng, 2) for _ in range(4)]
    body = {
        "head": f"<div class='post'><div class='head'><h2>{title}</h2></div><div class='text'>{paragraphs}</div></div>",
        "header": f"<div class='post'><header><h1>{title}</h1></header><div class='text'>{paragraphs}</div></div>",
        "points": f"<div class='post'><div class='text'>{paragraphs}</div><div class='points'><ul>{''.join(f'<li>{x}</li>' for x in short)}</ul></div></div>",
        "talk": f"<div class='post'><div class='text'>{paragraphs}</div><div class='talk'>{''.join(f'<p>{x}</p>' for x in short)}</div></div>",
        "code": f"<div class='post'><div class='text'>{paragraphs}</div><div class='code'><pre>{short[0]} <span class='comment'># {short[1]}</span></pre></div></div>",
        "advert": f"<div class='post'><div class='text'>{paragraphs.replace('</p>', ' <span class=advert>Buy <span>now</span> 5</span> on</p>')}</div></div>",
        "replies": f"<article><h1>{title}</h1>{paragraphs}<div class='responses'>{''.join(f'<p>{line(rng, 20)}</p>' for _ in range(2))}</div></article>",
    }[kind]
    lines = {"head": [title, *text], "header": [title, *text], "points": text + short, "talk": text + short, "code": [*text, f"{short[0]} # {short[1]}"], "advert": [f"{t} on" for t in text], "replies": [title, *text]}[kind]
    around = "<header class='site-header'><a href='/'>Home</a></header><div class='notice'>We use cookies.</div>{}<div class='box'><p>Our paper comes out in the morning, write to us at any time of the day.</p></div><footer>All rights</footer>"
    return around.format(body), lines


def test_articles_of_common_templates(spark):
    rng = random.Random(17)
    rows, want = [], {}
    for k, kind in enumerate(("head", "header", "points", "talk", "code", "advert", "replies")):
        for i in range(12):
            body, lines = page(rng, kind)
            rows.append((100 * k + i, f"https://t{k}.example.org/{i}", f"<html><body>{body}</body></html>"))
            want[100 * k + i] = "\n".join(lines)
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_inline_adverts():
    text = lambda x: [b.text for b in htmltext.blocks(x)]
    assert text("<p>a <b class=ad>x <b>y</b> z</b> c</p><p>d</p>") == ["a c", "d"]
    assert text("<p>a <i class='ad'>open</p><p>b</i> c</p>") == ["a", "b c"]
    assert text("<p><em class='note'>kept</em> <span class='comment'>kept</span> <span hidden>no</span></p>") == ["kept kept"]
