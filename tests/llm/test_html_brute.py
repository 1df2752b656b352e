"""Main-text extraction against a second version that builds a tree with the standard library's parser, and pages whose article stands in an element named after something else."""

import os
import random
from html.parser import HTMLParser

import pytest

from brindle.llm import html_extract as he

GOOD = "The people of the town went out to see what was there, and they had not known that it was the end of a long road. "


@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<p>{}</p>", "<main><div><p>{}</p></div></main>"])
@pytest.mark.parametrize("name", ["id=page class='right-sidebar'", "class='sidebar-left'", "class='post-share-wrapper'", "class='social-post'", "class='column side'", "id='comments-and-article'"])
def test_article_in_an_element_with_a_layout_name(name, inner):
    article = (GOOD * 3).strip()
    noise = "".join(f"<div class={c}><p>{GOOD * 4}</p></div>" for c in ("comments", "newsletter", "cookie-notice"))
    page = f"<html><body><nav><a href=/>Home</a></nav><div {name}>{inner.format(article)}{noise}</div><aside><p>{GOOD * 9}</p></aside><footer>All rights</footer></body></html>"
    assert he.extract_text(page) == article


@pytest.mark.parametrize("content", ["<div class=content><p>{}</p></div>", "<article><p>{}</p></article>"])
def test_longer_comments_and_sidebars_are_not_revived(content):
    article = (GOOD * 2).strip()
    page = f"<html><body>{content.format(article)}<div class=sidebar><p>{GOOD * 5}</p></div><section id=post-comments>{('<p>' + GOOD * 2 + '</p>') * 20}</section><div class=related><article><p>{GOOD * 3}</p></article></div></body></html>"
    assert he.extract_text(page) == article


def test_a_page_of_a_notice_alone_has_no_text_of_it():
    assert he.extract_text(f"<body><div class=cookie-notice><p>{GOOD * 4}</p></div></body>") == ""


class Node:
    def __init__(self, tag, name="", up=None):
        self.tag, self.name, self.up, self.parts = tag, name, up, []

    def path(self):
        return [self, *(self.up.path() if self.up else [])]


class Tree(HTMLParser):
    """A page as a tree; parts of a node are nodes, strings and (string, in a link)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")
        self.skip, self.link = 0, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in he.RAW_TAGS or tag == "button":
            self.skip += 1
        elif tag == "a":
            self.link += 1
        elif tag == "br":
            self.at.parts.append((" ", False))
        elif tag == "hr":
            self.at.parts.append(Node("hr", up=self.at))
        elif tag in he.BLOCK_TAGS:
            if self.at.tag == tag and tag in ("p", "li", "td", "tr", "th", "dd", "dt", "option") or self.at.tag == "p" != tag:
                self.at = self.at.up  # the end tag may be left out
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.at.parts.append(node := Node(tag, names, self.at))
            self.at = node

    def handle_endtag(self, tag):
        if tag in he.RAW_TAGS or tag == "button":
            self.skip -= 1
        elif tag == "a":
            self.link -= 1
        elif tag in he.BLOCK_TAGS and tag != "hr":
            at = next((n for n in self.at.path() if n.tag == tag), None)
            self.at = at.up if at else self.at

    def handle_data(self, data):
        if not self.skip:
            self.at.parts.append((data, bool(self.link)))


def unwanted(node):
    if node.tag in he.DROPPED_TAGS:
        return True
    for name in node.name.split() if node.tag not in ("html", "body", "main") else ():
        words = [w.lower().rstrip("0123456789") for w in he._PART.split(name)]
        marks = [w for w in words if he.MARK.fullmatch(w)]
        rest = [w for w in words if w and w not in marks and w not in he.NEUTRAL]
        if not he.STATE.fullmatch(name.lower()) and len(marks) > len(rest):
            return True
    return False


def leaves(node, out):
    """(text, characters in links, node) for every stretch of text between block tags."""
    held = []

    def close():
        text = " ".join("".join(x for x, _ in held).split())
        if text:
            out.append((text, sum(len(x.strip()) for x, linked in held if linked), node))
        held.clear()

    for part in node.parts:
        if isinstance(part, Node):
            close()
            leaves(part, out)
        else:
            held.append(part)
    close()
    return out


def brute(page):
    """For pages whose article stands outside all unwanted elements."""
    blocks = leaves(Tree(page).root, [])
    bad = [any(map(unwanted, node.path())) for _, _, node in blocks]
    words = [w for (text, _, _), b in zip(blocks, bad) if not b for w in he.WORDS.findall(text.lower())]
    foreign = len([w for w in words if w in he.STOP_WORDS]) < 0.03 * len(words)
    labels = ["bad" if b else he.classify(text, linked, short=70, long=200, max_link_density=0.5, low_stop=0.12, foreign=foreign) for (text, linked, _), b in zip(blocks, bad)]

    def section(k):
        return next((n for n in blocks[k][2].path() if n.tag in he.MAIN_TAGS or unwanted(n)), None)

    def edge(k):
        return "good" if any(n.tag in he.MAIN_TAGS for n in blocks[k][2].path()) else "bad"

    kept = []
    for k, label in enumerate(labels):
        if label in ("near", "ambiguous"):
            told = []
            for step in (-1, 1):
                j = k + step
                while 0 <= j < len(blocks) and section(j) is section(k) and labels[j] not in ("good", "bad"):
                    j += step
                told.append((abs(j - k), labels[j] if 0 <= j < len(blocks) and section(j) is section(k) else edge(k)))
            if label == "near" and "good" in (told[0][1], told[1][1]):
                label = "good"
            elif told[0][1] == told[1][1] or told[0][0] <= told[1][0]:
                label = told[0][1]
            else:
                label = told[1][1]
        if label == "good":
            kept.append(blocks[k][0])
    if not kept:
        kept = [text for (text, _, _), label in zip(blocks, labels) if label in ("near", "ambiguous") and he.reads_as_sentence(text)]
    return "\n\n".join(kept)


def made_page(r):
    """A well-formed page of nested, named elements around an article."""
    say = lambda n: "".join(r.choice([GOOD, "Der Weg in die Stadt ist mit dem Zug nicht weit. ", "La ville est au bord de la mer. ", "Short. ", "Buy now "]) for _ in range(n)).strip()

    def block(depth):
        kind = r.random()
        if kind < 0.4 or depth > 3:
            return f"<p>{say(r.randint(1, 4))}</p>"
        if kind < 0.55:
            return f"<ul>{''.join(f'<li><a href=#>{say(1)}</a></li>' for _ in range(r.randint(1, 4)))}</ul>"
        if kind < 0.65:
            return f"<h2>{say(1)[:30]}</h2>"
        tag = r.choice(["div", "section", "aside", "footer", "nav", "header"])
        name = r.choice(["", " class=content", " class='cookie-notice'", " id=comments", " class='related-posts'", " class=story", " class='social-policy'"])
        return f"<{tag}{name}>{''.join(block(depth + 1) for _ in range(r.randint(1, 4)))}</{tag}>"

    article = f"<article><h1>{say(1)[:40]}</h1>{''.join(f'<p>{GOOD * r.randint(2, 4)}</p>' + block(2) for _ in range(r.randint(1, 5)))}</article>"
    return f"<html><head><title>T</title><script>if(a<b)x()</script></head><body>{block(0)}{article}{block(0)}<br>{say(2)}</body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_made_pages(seed):
    page = made_page(random.Random(seed))
    assert he.extract_text(page) == brute(page)


DATA = os.environ.get("BRINDLE_TEST_DATA", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_given_pages():
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{DATA}/pages.parquet", columns=["html"])["html"].to_pylist()
    assert [he.extract_text(p) for p in pages] == [brute(p or "") for p in pages]
