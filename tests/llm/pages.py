"""Made-up pages in many layouts, with the blocks of their main text, to measure extraction against."""

from __future__ import annotations

import random

SYLLABLES = "ba ko li mer no sta ri ven tu ga dor el ish am pe".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))


def phrase(r: random.Random, low: int, high: int) -> str:
    return " ".join(word(r) for _ in range(r.randrange(low, high))).capitalize()


def prose(r: random.Random, sentences: int) -> str:
    return " ".join(phrase(r, 5, 16) + r.choice(".....?!") for _ in range(sentences))


def page(seed: int) -> tuple[str, list[str]]:
    """(html, blocks of the main text in order). Half the layouts mark nothing: plain divs, no article, no telling names."""
    r = random.Random(seed)
    marked = r.random() < 0.3
    wrap = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>']) if marked else r.choice(["<div>{}</div>", '<div class="c7"><div>{}</div></div>', "<table><tr><td>{}</td></tr></table>"])
    gold: list[str] = []

    def kept(text: str) -> str:
        gold.append(text)
        return text

    body = [f"<h1>{kept(phrase(r, 4, 9))}</h1>"]
    for _ in range(r.randrange(4, 10)):
        kind = r.random()
        if kind < 0.5:
            body.append(f"<p>{kept(prose(r, r.randrange(2, 6)))}</p>")
        elif kind < 0.62:
            body.append(f"<p>{kept(phrase(r, 1, 4))}</p>")
        elif kind < 0.74:
            body.append(f"<h3>{kept(phrase(r, 2, 5))}</h3>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>{kept(phrase(r, 1, 6))}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
        elif kind < 0.93:
            body.append(f"<p>{kept(phrase(r, 1, 3) + '.')}</p>")
        else:
            text = phrase(r, 2, 4)
            body.append(f'<p><a href="/x">{kept(text)}</a></p>')
    body.append(f"<p>{kept(prose(r, 3))}</p>")
    names = ['<div class="nav">{}</div>', "<nav>{}</nav>", "<div>{}</div>", '<div class="t3">{}</div>']
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{phrase(r, 1, 4)}</a></li>' for k in range(n)) + "</ul>"
    teaser = lambda: f'<div><a href="/t"><h4>{phrase(r, 3, 8)}</h4></a><span>{phrase(r, 4, 9)}.</span></div>'
    top = r.choice(names).format(links(r.randrange(3, 8)))
    side = r.choice(['<aside>{}</aside>', '<div class="sidebar">{}</div>', "<div>{}</div>", '<div class="k2">{}</div>']).format(links(4) + "".join(teaser() for _ in range(r.randrange(0, 4))) + links(3))
    related = r.choice(['<div class="related">{}</div>', "<div>{}</div>"]).format("".join(teaser() for _ in range(r.randrange(2, 6))))
    foot = r.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', "<div>{}</div>"]).format(links(3) + f"<p>&copy; {phrase(r, 1, 3)} {r.randrange(1999, 2030)}</p>" + links(2))
    main = wrap.format("".join(body))
    parts = [main, side] if r.random() < 0.6 else [side, main]
    html = f"<html><head><title>{phrase(r, 2, 5)}</title></head><body>{top}<div>{parts[0]}{parts[1]}</div>{related}{foot}</body></html>"
    return html, gold
