"""Nothing of a page but scripts, styles and titles is kept from the labeller."""

from cellweave.llm import html_extract


def test_text_inside_embedded_elements():
    texts = lambda page: [t for t, _, _ in html_extract.blocks(page)]
    assert texts("<p>where <math><mi>x</mi></math> is</p>") == ["where x is"]
    for tag in "math svg object canvas audio video iframe noscript template".split():
        assert texts(f"<article><p>one</p><{tag}><p>two</p></{tag}><p>three</p></article>") == ["one", "two", "three"]
        assert texts(f"<article><p>one</p><{tag}><p>two</p><p>three</p></article><p>four") == ["one", "two", "three", "four"]
    assert texts("<head><title>t<body><p>one")[-1].endswith("one")


def test_whole_tag_path():
    deep = lambda tag: f'<{tag}>{"<div><span>" * 9}<p>text</p>{"</span></div>" * 9}</{tag}><p>after</p>'
    for tag in ("nav", "article"):
        (_, inside, _), (_, after, _) = html_extract.blocks(deep(tag))
        assert tag in inside and tag not in after and "div" not in after
