"""Pages whose articles hold what looks like a page's surroundings: each with its whole text."""

import pytest

from ledgerwood.llm.html_text import main_text

SEAS, HILLS, TOWNS = (f"{n} carry water from the hills to the sea, and towns grew up along their banks where boats could land in summer and in winter. " * 3 for n in ("Rivers", "Canals", "Streams"))
A, B, C = SEAS.strip(), HILLS.strip(), TOWNS.strip()
AROUND = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav>"
END = "<footer><p>Copyright of the publisher, all rights reserved.</p></footer>"

PAGES = {
    "a section whose id is made of its heading": (f"<article><p>{A}</p><p>{B}</p><section id='related-work'><h2>Related work</h2><p>{C}</p></section><p>{A}</p></article>", [A, B, "Related work", C, A]),
    "ids that hold a mark": (f"<article><p>{A}</p><p id='form-of-government'>{B}</p><div id='notice-period'><p>{C}</p></div></article>", [A, B, C]),
    "a long part whose id is a mark": (f"<article><p>{A}</p><section id='notice'><h2>Notice</h2><p>{B}</p></section><p>{C}</p></article>", [A, "Notice", B, C]),
    "a brief part whose id is a mark": (f"<article><p>{A}</p><div id='share'>Share this</div><p>{C}</p></article>", [A, C]),
    "references as links": (f"<article><p>{A}</p><ul><li><a href=a>Smith 2001, On rivers</a></li><li><a href=b>Jones 2002, On seas</a></li></ul><p>{B}</p></article>", [A, "Smith 2001, On rivers", "Jones 2002, On seas", B]),
    "links at the end": (f"<article><p>{A}</p><p>{B}</p><ul><li><a href=a>Another article</a></li><li><a href=b>One more</a></li></ul></article>", [A, B]),
    "whom a quotation is of": (f"<article><p>{A}</p><blockquote><p>{B}</p><footer>Jane Doe, 1999</footer></blockquote><footer>Posted in Rivers</footer></article>", [A, B, "Jane Doe, 1999"]),
    "title and end in boxes of their own": (f"<div class=page><div class=title-wrap><h1>My title</h1></div><div class=entry><p>{A}</p><p>{B}</p><p>{C}</p></div><div class=end><p>Short end.</p></div></div>", ["My title", A, B, C, "Short end."]),
    "a lead beside the body": (f"<div class=page><div class=lead>Lead.</div><div class=body><p>{A}</p><p>{B}</p></div></div>", ["Lead.", A, B]),
    "a class that mentions a mark": (f"<article><p>{A}</p><div class='form-of-rule'><p>{B}</p></div><div class='advert'>Buy a boat today</div></article>", [A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_article(name):
    html, want = PAGES[name]
    assert main_text(f"<html><body>{AROUND}{html}{END}</body></html>").split("\n") == want


def test_a_sidebar_beside_the_article_stays_out():
    links = "".join(f"<p><a href={i}>Link {i} to another page</a></p>" for i in range(9))
    html = f"<body><div class=wrap><div class=text><h1>Title</h1><p>{A}</p><p>{B}</p></div><div class=right>{links}</div></div></body>"
    assert main_text(html).split("\n") == ["Title", A, B]
