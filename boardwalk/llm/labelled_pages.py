"""Small labelled web pages: what is the article bears the attribute ``MARK``.

Pages are put together from layouts; texts are made-up words of given numbers, as only numbers and places matter.
"""

from __future__ import annotations

MARK = "data-main"


def w(n: int) -> str:
    return " ".join(["word"] * n)


def a(n: int) -> str:
    return f'<a href="/x">{w(n)}</a>'


def listed(sizes: list[int]) -> str:
    return "<ul>" + "".join(f"<li>{a(n)}</li>" for n in sizes) + "</ul>"


def kept(sizes: list[int], tag: str = "p") -> str:
    return "".join(f"<{tag} {MARK}>{w(n)}</{tag}>" for n in sizes)


def linked(n: int, links: int) -> str:
    """A paragraph of the article with some linked words."""
    return f"<p {MARK}>{w(n - links)} {a(links)}</p>"


LINES = ([60, 80, 40], [3, 120, 1, 2, 25], [1], [200], [7, 9, 4, 5, 6], [2, 2, 45, 12, 90, 150])


def with_article(sizes: list[int]) -> str:
    """Menu, advert, article, footer."""
    return f'<nav>{listed([1, 2, 1])}</nav><div class="ad">{w(9)}</div><article><h1 {MARK}>{w(8)}</h1>{kept(sizes)}</article><footer>{w(10)}</footer>'


def with_everything(sizes: list[int]) -> str:
    """Header, notice, sidebar, form and readers' comments around and inside the article."""
    return (
        f"<header><h2>{w(3)}</h2><p>{w(12)}</p></header><div id='cookie-notice'><p>{w(40)}</p><button>{w(1)}</button></div>"
        f"<main><article><header><h1 {MARK}>{w(6)}</h1></header>{kept(sizes[:2])}<aside><h3>{w(2)}</h3><p>{w(30)}</p></aside>"
        f"{linked(50, 6)}{kept(sizes[2:])}<div class='share'>{a(1)} {a(1)}</div></article>"
        f"<section class='comments'><h3>{w(2)}</h3><article><p>{w(35)}</p></article><article><p>{w(90)}</p></article></section>"
        f"<form><p>{w(15)}</p><label>{w(2)}</label></form></main><div class='sidebar'><h3>{w(2)}</h3><p>{w(60)}</p>{listed([5, 6, 7])}</div><footer><p>{w(20)}</p>{listed([1, 1])}</footer>"
    )


def with_strays(sizes: list[int]) -> str:
    """Blocks without a telling name around the article."""
    return (
        f"<div>{a(2)}</div><div>{w(5)}</div><p>{w(30)}</p><article><h2 {MARK}>{w(5)}</h2>{kept(sizes)}<ul {MARK}><li>{w(3)}</li><li>{w(9)}</li></ul>"
        f"<h3 {MARK}>{w(3)}</h3>{kept(sizes)}<p {MARK}>{a(9)}</p>{kept([30])}</article><div><p>{w(45)}</p><p>{a(6)}</p></div><p>{w(12)}</p>"
    )


def with_links_inside(sizes: list[int]) -> str:
    """Links to further pages at the end of an article."""
    return f"<article><h1 {MARK}>{w(6)}</h1>{kept(sizes)}{kept([50])}{listed([6, 7, 5, 8])}</article><div>{listed([4, 5])}</div>"


def with_byline(sizes: list[int], start: str = "<article>", end: str = "</article>") -> str:
    """A short title right after the menu, and short paragraphs that are mostly links."""
    return (
        f"<nav>{listed([1, 1, 1])}</nav>{start}<h1 {MARK}>{w(2)}</h1>{linked(3, 2)}{kept([4])}{kept(sizes)}{linked(2, 2)}{kept([1, 30])}"
        f"<p {MARK}>{a(4)}</p><h2 {MARK}>{w(1)}</h2>{linked(5, 4)}{kept([2])}{end}<footer>{a(1)} {w(2)}</footer>"
    )


def with_byline_in_main(sizes: list[int]) -> str:
    return with_byline(sizes, "<main>", "</main>")


def with_byline_in_named(sizes: list[int]) -> str:
    return with_byline(sizes, "<div class='article-body'>", "</div>")


def with_main(sizes: list[int]) -> str:
    return f"<div class='top'>{listed([1, 1, 2])}</div><main><h1 {MARK}>{w(7)}</h1>{kept(sizes)}<div class='related'>{listed([6, 8])}</div></main><div>{w(14)}</div><p>{w(35)}</p>"


def with_named(sizes: list[int]) -> str:
    """A container that only its class tells."""
    return (
        f"<div id='header'><h1>{w(2)}</h1><p>{w(8)}</p></div><div class='menu'>{listed([1, 2])}</div>"
        f"<div class='post-content'><h1 {MARK}>{w(9)}</h1>{kept(sizes, 'div')}</div><div>{w(25)}</div><div id='comments'><p>{w(50)}</p><p>{w(8)}</p></div><div class='footer'>{w(12)}</div>"
    )


def bare(sizes: list[int]) -> str:
    """No container tells anything: long texts and what stands between them are the article, links and short ends are not."""
    long = [n for n in sizes if n > 20] or [40]
    return (
        f"<div>{a(1)}</div><div>{a(2)}</div><div>{a(1)}</div><div>{w(3)}</div><div>{a(4)}</div>"
        f"<div><h1 {MARK}>{w(7)}</h1><p {MARK}>{w(60)}</p>{kept(long)}<h3 {MARK}>{w(4)}</h3>{kept([55, 6, 48])}{linked(40, 8)}{kept(long)}</div>"
        f"<div>{a(5)}</div><div>{a(6)}</div><div>{a(4)}</div><div>{w(2)}</div><div>{a(2)} {w(1)}</div><div>{w(6)}</div>"
    )


def bare_and_short(sizes: list[int]) -> str:
    """A short title right after links, and lone links around."""
    return f"<div>{a(1)}</div><div>{a(3)}</div><div><h1 {MARK}>{w(3)}</h1>{kept([60])}<h2 {MARK}>{w(2)}</h2>{kept([45, 80])}</div><div>{a(3)}</div><p>{w(3)}</p><div>{a(8)}</div>"


def table_layout(sizes: list[int]) -> str:
    long = [n for n in sizes if n > 20] or [70]
    return f"<table><tr><td>{a(1)}</td><td>{a(1)}</td><td>{a(2)}</td></tr><tr><td {MARK}>{kept(long)}</td></tr><tr><td>{a(2)}</td><td>{w(4)} {a(2)}</td></tr></table>"


LAYOUTS = (with_article, with_everything, with_strays, with_links_inside, with_byline, with_byline_in_main, with_byline_in_named, with_main, with_named, bare, bare_and_short, table_layout)
TEXTS = tuple(w(n) for n in (1, 4, 30)) + (f"{w(12)}<p>{w(5)}<p>{w(80)}",)
PAGES = [f"<html><body>{layout(sizes)}</body></html>" for layout in LAYOUTS for sizes in LINES] + [f"<div {MARK}>{text}</div>" for text in TEXTS]
