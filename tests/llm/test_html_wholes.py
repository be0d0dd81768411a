from __future__ import annotations

import pytest

from tessera.llm.html_text import main_text

P = ["The first paragraph of the article is long enough to count as text.", "The second paragraph, long as well, tells how the matter went on."]
ARTICLE = f"<p>{P[0]}</p><p>{P[1]}</p>"
NAV = "<nav><a href=/a>One</a><a href=/b>Two</a></nav>"


@pytest.mark.parametrize("wrapper", ["div class='content no-sidebar'", "div class='site has-sidebar'", "div class=comments-open", "div class=elementor-widget-container", "div id=social-issues", "form", "div class=widget"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_wrappers_are_not_cut(wrapper, inner):
    assert main_text(f"<body>{NAV}<{wrapper}>{inner.format(ARTICLE)}</{wrapper.split()[0]}><footer>us</footer></body>") == "\n\n".join(P)


def test_article_header_stays():
    assert main_text(f"<body>{NAV}<article><div class=article-header><p>{P[0]}</p></div><p>{P[1]}</p></article></body>") == "\n\n".join(P)


@pytest.mark.parametrize("name", ["sidebar", "sidebar-2", "site-header", "cookie-notice", "social-links", "left_sidebar"])
def test_boxes_are_cut(name):
    assert main_text(f"<body><div class={name}><p>Some words of a box that no one reads.</p></div>{ARTICLE}</body>") == "\n\n".join(P)


def test_long_comments_are_cut():
    comments = f"<div class=comments><article class=comment><p>{'I like it a lot. ' * 30}</p></article></div>"
    assert main_text(f"<body><div>{ARTICLE}</div>{comments}</body>") == "\n\n".join(P)


def test_bare_body_text_stays():
    page = "<body>Long article text of a body without any blocks<br><br>more <b>text</b> of it<ul><li>a few words</li><li>a few words</li></ul>closing text</body>"
    assert main_text(page) == "Long article text of a body without any blocks more text of it\n\na few words\n\na few words\n\nclosing text"


MANY = "".join(f"<p>Paragraph {k} of the article tells more of the matter, and at some length.</p>" for k in range(8))


def test_every_article_of_a_child_is_taken():
    got = main_text(f"<body>{NAV}<div><article>{MANY}</article><article><p>{P[0]}</p></article></div></body>")
    assert got.count("Paragraph") == 8 and P[0] in got


def test_link_rich_child_keeps_its_blocks():
    links = "".join(f"<a href=/{k}>some linked words that are many</a> " for k in range(40))
    got = main_text(f"<body><div><div>{MANY}</div><div>{links}</div><div><p>{P[0]}</p></div></div></body>")
    assert got.count("Paragraph") == 8 and P[0] in got and "linked" not in got
