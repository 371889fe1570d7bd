"""The block rules decide by themselves: without marked containers, in other languages, and inside articles."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ndspark.llm import html_text
from ndspark.llm.html_text import BOILER, OPEN, TEXT

FOLDER = "/root/testdata/sf0.01"
NAV = "<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"
FOOT = "<footer>&copy; example 2024</footer>"

OTHERS = {
    "ru": ["Вчера вечером в старом городе открылась выставка молодых художников, и первые посетители пришли ещё до начала.", "Организаторы говорят, что подготовка заняла почти два года.", "Вход свободный."],
    "it": ["La mattina seguente il vecchio pescatore scese verso il porto, guardando le barche che tornavano lentamente dalla notte.", "Nessuno parlava, perché tutti conoscevano già la notizia.", "Poi cominciò a piovere."],
    "zh": ["昨天晚上，老城区举行了青年艺术家的展览开幕式，许多观众在开始之前就已经到达现场，等待第一批作品的展示。", "组织者说，准备工作花了将近两年的时间，参加的艺术家来自十二个国家和地区。", "免费入场。"],
}


@pytest.mark.parametrize("lang", sorted(OTHERS))
@pytest.mark.parametrize("tag", ["article", "div"])
def test_other_languages_keep_their_text(lang, tag):
    blocks = "".join(f"<p>{t}</p>" for t in OTHERS[lang])
    page = f"<html><body>{NAV}<div class=ad>{OTHERS[lang][0]}</div><{tag}>{blocks}</{tag}>{FOOT}</body></html>"
    assert html_text.main_text(page) == "\n".join(OTHERS[lang])


def test_lists_of_links_inside_articles_go():
    page = f"<article><p>One.</p><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><p>Two, with <a href=3>a link</a>.</p><p><a href=4>A paragraph that is a link.</a></p><ul><li>First point</li><li><a href=5>Second</a></li></ul></article>{FOOT}"
    assert html_text.main_text(page).split("\n") == ["One.", "Two, with a link.", "A paragraph that is a link.", "First point", "Second"]


def test_short_pages_and_headings():
    assert html_text.main_text(f"{NAV}<div><h1>Title</h1><p>Short text.</p></div>{FOOT}") == "Title\nShort text."
    long = "It is the story of the man that was in the house and of the dog that was with him. " * 3
    page = f"{NAV}<div class=ad>Buy it.</div><div><h1>Title</h1><p>{long}</p><p>End.</p><p>Really.</p></div>{FOOT}"
    assert html_text.main_text(page) == f"Title\n{long.strip()}\nEnd.\nReally."
    # long, no stop words, no end of a sentence: a list of keywords
    words = " ".join(f"keyword{i}" for i in range(30))
    assert words not in html_text.main_text(f"<div><p>{long}</p></div><div><p>{words}</p></div>")


def plain_second_pass(labels, places, default):
    """Every open block looks at all decided ones."""
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            sides = []
            for pool in ([k for k, x in enumerate(labels) if x != OPEN and places[k] == places[i]], [k for k, x in enumerate(labels) if x != OPEN] if TEXT in labels else []):
                if pool and not sides:
                    near = min(abs(k - i) for k in pool)
                    sides = [labels[k] for k in pool if abs(k - i) == near]
            label = (TEXT if TEXT in sides else BOILER) if sides else default
        out.append(label)
    return out


def test_labels_are_those_of_a_plain_search():
    r = random.Random(7)
    for _ in range(3000):
        n = r.randrange(12)
        labels, places = r.choices([TEXT, BOILER, OPEN, OPEN], k=n), r.choices([1, 1, 2, 3], k=n)
        assert html_text._second_pass(labels, places, TEXT) == plain_second_pass(labels, places, TEXT)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
def test_rules_find_the_article_without_its_mark(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    unmarked = pages.withColumn("html", F.regexp_replace("html", r"(</?)(article|main)\b", "$1div"))
    marked = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    found = {r["page_id"]: r["text"] for r in html_text.extract(unmarked).collect()}
    assert sum(marked[i] == found[i] for i in marked) >= 0.95 * len(marked)
    # with the mark, all of the article's blocks and nothing else
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if inner and not re.search(r"<(form|aside|nav|ul|div|section)\b", inner[1]):
            assert marked[r["page_id"]] == html_text.main_text(f"<main>{inner[1]}</main>")
