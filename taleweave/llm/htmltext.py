"""Main text of web pages: a recurrent labeller over the page's blocks."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm import bytetext
from taleweave.llm.blocklstm import padded, scores, train
from taleweave.llm.htmlblocks import Block, blocks, features

#: Pages that the labeller is trained on, composed ones for each of them and at least; longer pages are not taken for that.
SAMPLE_PAGES, COMPOSED, LEAST_COMPOSED, MOST_SAMPLE_CHARS = 240, 4, 900, 100_000
ROUNDS = 16


def structural_label(block: Block) -> float:
    """Distant supervision: text inside article or main, and in nothing that is set aside within."""
    return float(block.element.inside and not block.element.aside)


_ASIDE_WORDS = ["ad", "advert", "banner", "sponsored", "promo", "widget", "teaser", "box", "extra"]
_NOTICES = ["cookie notice", "notice", "newsletter", "alert", "consent", "popup", "message"]
_REMARKS = ["comment", "reply", "response", "discussion", "reader", "feedback", "post", "entry"]
_BOXES = ["<article>{}</article>", "<article class='{c}'>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='{c}'>{}</div>", "<div id='{c}'><div class='inner'>{}</div></div>", "<section class='{c}'>{}</section>", "<div>{}</div>", "<div><div>{}</div></div>", "<center>{}</center>", "<td>{}</td>", "<td class='{c}'>{}</td>", "{}"]
_BOX_NAMES = ["content", "main-content", "post", "entry", "body", "story", "text", "single", "page", "article-body", "left", "column"]
#: Plain sentences are put together from these, so that neither main text nor what is around it is known by its language.
_WHO = "the old man,a young woman,two children,our team,the council,this river,every train,the small shop,a good cook,my sister,the north,some birds,the museum,nobody,most readers,the second part".split(",")
_DOES = "opened,walked to,found,will close,took,saw,kept near,asked about,came back from,was built by,is beside,may need,lost,reads,paid for,turned into".split(",")
_WHAT = "the bridge,a warm meal,the station,an empty house,three eggs,a new road,the meeting,bread and salt,the last letter,cold water,their friends,a long winter,the garden,a small fee,the evening news,your name".split(",")
_WHEN = ["", "", " today", " in the morning", " last year", ", and went home", " with a little help", " for the first time", " on Friday", ", as it was late"]
#: Calls and notices around main text are put together from these.
_CALL = "sign up for,subscribe to,get,log in for,follow,share,accept,we use,learn more about,download,join,don't miss,click here for,manage,support,register for".split(",")
_CALLED = "our newsletter,all cookies,our letter,ten percent off,the app,your account,us on social media,this page,personal offers,cookies to improve your visit,free delivery,our partners,members' benefits,your settings,more stories,a free trial".split(",")
_CALL_TAIL = ["", "", " now", " today", " and save", ".", " for free", "!", " and get ten percent off", " - it takes a minute."]
_NOISE_NAMES = ["x1", "q7", "k3", "css-1a2b", "c-09", "w", "u12", "zz", "row", "b2"]


def composed_pages(texts: list[str], n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Training pages in many layouts, and where in each the main text's source lies: known paragraphs
    amid menus, notices, adverts and comments, in named elements, plain boxes and tables."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    plain = False

    def sentence() -> str:
        own = f"{pick(_WHO)} {pick(_DOES)} {pick(_WHAT)}{pick(_WHEN)}"
        return own[0].upper() + own[1:] + pick([".", ".", ".", "!", "?"])

    def phrase() -> str:
        own = pick([lambda: f"{pick(_DOES)} {pick(_WHAT)}", lambda: pick(_WHAT), lambda: pick(_WHO), lambda: f"{pick(_WHO)}: {pick(_WHAT)}", lambda: sentence()[:-1]])()
        return own[0].upper() + own[1:]

    def call() -> str:
        own = f"{pick(_CALL)} {pick(_CALLED)}{pick(_CALL_TAIL)}"
        return html.escape(own[0].upper() + own[1:])

    say = lambda: html.escape(" ".join(sentence() for _ in range(rng.integers(1, 6))) if plain else pick(texts))
    few = lambda most=9: html.escape(" ".join((phrase() if plain else pick(texts)).split()[: rng.integers(1, most)]))
    line = lambda: html.escape(pick([sentence, phrase])()) if plain else few(12)
    some = lambda low, high, make: "".join(make() for _ in range(rng.integers(low, high)))

    def menu() -> str:
        link = lambda: f"<a href='/{few(3)}'>{few(5)}</a>"
        return pick([
            lambda: f"<nav class='{pick(['menu', 'nav', 'top', ''])}'><ul>{some(2, 8, lambda: f'<li>{link()}</li>')}</ul></nav>",
            lambda: f"<div class='{pick(['menu', 'navigation', 'links', 'bar'])}'>{some(2, 8, link)}</div>",
            lambda: f"<div>{some(3, 8, lambda: link() + ' | ')}</div>",
            lambda: f"<table><tr>{some(3, 7, lambda: f'<td>{link()}</td>')}</tr></table>",
            lambda: f"<ul>{some(3, 9, lambda: f'<li>{link()}')}</ul>",
        ])()

    def remark() -> str:
        who, day = few(3), f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.20{rng.integers(10, 25)}"
        return pick([
            lambda: f"<div class='{pick(_REMARKS)}'><b>{who}</b><p>{say()}</p></div>",
            lambda: f"<li class='comment'><p>{say()}</p><p>{say()}</p></li>",
            lambda: f"<div><b>{who}</b> {day}<br>{say()}</div>",
            lambda: f"<div><div>{who} wrote on {day}:</div><div>{say()}</div></div>",
            lambda: f"<dl><dt>{who}, {day}<dd>{say()}</dl>",
            lambda: f"<li{pick(['', ' class=odd', ' class=even'])}><b>{who}</b> {pick([day, 'said', 'on ' + day, ''])}<p>{say()}</p></li>",
            lambda: f"<li>{who} wrote:<br>{say()}",
            lambda: f"<article class='{pick(_REMARKS)}'><h5>{who}</h5><p>{say()}</p></article>",
        ])()

    def remarks() -> str:
        title = pick(["Comments", "{} comments", "Replies", "Responses ({})", "Readers say", "Discussion", "Kommentare", "Commentaires", few()]).format(rng.integers(1, 90))
        box = pick(["<section id='comments'><h3>{}</h3>{}</section>", "<ol class='commentlist comments'><li>{}</li>{}</ol>", "<div class='comments'><h4>{}</h4>{}</div>", "<div><h3>{}</h3>{}</div>", "<h3>{}</h3>{}", "<div class='thread'><p>{}</p>{}</div>", "<div class='replies'><h4>{}</h4><ul>{}</ul></div>", "<h4>{}</h4><ol>{}</ol>", "<div id='discussion'><h2>{}</h2><ol>{}</ol></div>"])
        return box.format(title, some(1, 5, remark))

    def aside() -> str:
        return pick([
            menu,
            lambda: f"<div class='{pick(_ASIDE_WORDS)}'><p>{few()}</p>{few()}</div>",
            lambda: f"<div class='{pick(_NOTICES)}'>{few()}<button>{few(4)}</button></div>",
            lambda: f"<aside class='{pick(['sidebar', 'related', 'widget', ''])}'><h3>{few(5)}</h3><ul>{some(2, 5, lambda: f'<li><a href=/>{few()}</a></li>')}</ul><p>{say()}</p></aside>",
            lambda: f"<form><label>{few()}</label><select><option>{few()}<option>{few()}</select><button>{few(4)}</button></form>",
            lambda: f"<footer><p>{few()}</p>&copy; {few()}</footer>",
            lambda: f"<div class='{pick(['footer', 'bottom', 'legal'])}'>&copy; 20{rng.integers(10, 25)} {few()} {few()}</div>",
            lambda: f"<header><a href='/'>{few(4)}</a><div>{few()}</div></header>",
            lambda: f"<div class='{pick(_NOISE_NAMES)}'>{call()}</div>",
            lambda: f"<div>{call()}{pick(['', ' ' + call(), f'<button>{few(3)}</button>'])}</div>",
            lambda: f"<p>{call()}</p>",
            lambda: f"<div class='{pick(_NOISE_NAMES + ['', 'see-also'])}'><h{rng.integers(2, 6)}>{few()}</h2><ul>{some(2, 6, lambda: f'<li><a href=/>{few()}</a></li>')}</ul></div>",
            lambda: f"<table><tr><td>{few()}</td></tr></table>",
            lambda: f"<footer><p>{pick(['All rights reserved', 'Terms and privacy', 'Imprint', 'Contact'])} 20{rng.integers(10, 26)}</p></footer>",
        ])()

    def listed() -> str:
        kind, end = pick(["ul", "ol"]), pick(["", "</li>"])
        return f"<{kind}>" + some(1, 7, lambda: f"<li>{line()}{end}") + f"</{kind}>"

    def passage() -> str:
        return pick([
            lambda: f"<p>{say()}</p>", lambda: f"<p>{say()}</p>", lambda: f"<p>{say()}</p>", lambda: f"<div>{say()}</div>", lambda: f"{say()}<br><br>", lambda: f"<p class=text>{say()} <a href='/'>{few(4)}</a> {say()}",
            lambda: f"<ul><li>{few()}<li>{say()}</ul>", listed, lambda: f"<h{rng.integers(2, 5)}>{few(6)}</h2><p>{line()}</p>", lambda: f"<p>{line()}</p>", lambda: f"<h2>{few()}</h2><p>{say()}</p>", lambda: f"<blockquote>{say()}</blockquote>", lambda: f"<table><tr><th>{few(4)}<th>{few(4)}<tr><td>{few(4)}<td>{few()}</table><p>{say()}</p>",
        ])()

    pages = []
    for _ in range(n):
        plain, short = bool(rng.random() < 0.4), bool(rng.random() < 0.15)
        body: list[tuple[str, bool]] = [(pick([f"<h1>{few()}</h1>"] * 4 + [f"<div class='title'>{few()}</div>", ""]), True)]
        same = passage if rng.random() < 0.6 else None
        kind = pick(["<p>{}</p>", "<div>{}</div>", "{}<br><br>", "<p>{}"])
        if short:  # an article of a line or two, with or without a heading, or of a list
            body = [*(body if rng.random() < 0.5 else []), *((pick([lambda: kind.format(line()), listed])(), True) for _ in range(rng.integers(1, 3)))]
        for _ in range(0 if short else rng.integers(1, 9)):
            body.append((same() if same else kind.format(say()), True))
            if rng.random() < 0.08:
                body.append((aside(), False))
        box = pick(_BOXES[:7] if short else _BOXES)
        before, after = box.replace("{c}", pick(_BOX_NAMES + _NOISE_NAMES * (not short))).split("{}")
        cell = "<td" in box
        first, then = [("<table><tr><td>" * cell, False), *((aside() if rng.random() < 0.7 else menu(), False) for _ in range(rng.integers(1, 4))), ("</td>" * cell, False)], []
        then = [("<tr><td>" * cell, False), *((aside(), False) for _ in range(rng.integers(0, 4))), ("</table>" * cell, False)]
        talk = [(remarks(), False)] if rng.random() < 0.65 else []
        inside = talk if rng.random() < 0.4 else []
        parts = [(f"<html><head><title>{few()}</title></head><body>", False), *first, (before, False), *body, *inside, (after, False), *([] if inside else talk), *then, ("</body></html>", False)]
        page, spans = "", []
        for source, main in parts:
            if main and source:
                spans.append((len(page), len(page) + len(source)))
            page += source
        pages.append((page, spans))
    return pages


def composed_labels(page: list[Block], spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each block's source ends inside one of the spans of main text."""
    return np.array([any(a < b.at <= z for a, z in spans) for b in page], np.float32)


def learn_from(pages: DataFrame, n: int = SAMPLE_PAGES) -> dict:
    """Trains on ``n`` pages at most, taken by the hash of page_id, and on ``COMPOSED`` times as many composed of their text and of plain sentences.

    The classes come from the pages' structure where they have an article or main element. The
    sample is of pages shorter than ``MOST_SAMPLE_CHARS``: it bounds what the driver holds, not
    what is labelled. Pages without text train nothing; with none at all only composed pages are used.
    """
    usable = pages.where(F.length("html") < MOST_SAMPLE_CHARS)
    total = usable.count()
    draw = F.pmod(F.xxhash64(F.col("page_id"), F.lit(29)), F.lit(1 << 40))
    # about twice as many as wanted leave their tasks, however many tasks there are
    drawn = usable.select("page_id", "html", draw.alias("draw")).where(F.col("draw") <= min(1 << 40, (1 << 40) * 2 * n // max(total, 1)))
    rows = drawn.orderBy("draw", "page_id").limit(n).collect()
    own = [blocks(r["html"]) for r in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"]))]
    own = [p for p in own if any(structural_label(b) for b in p)]
    texts = [b.text for p in own for b in p if structural_label(b) and len(b.text) > 20] or ["some words of a page that has a story to tell"]
    composed = [(blocks(page), spans) for page, spans in composed_pages(texts, max(COMPOSED * len(own), LEAST_COMPOSED))]
    labels = [np.array([structural_label(b) for b in p], np.float32) for p in own] + [composed_labels(*x) for x in composed]
    return train([features(p) for p in own] + [features(p) for p, _ in composed], labels, rounds=ROUNDS)


def main_text(pages: DataFrame, model: dict) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_blocks, n_kept)``, a row each.

    The page's blocks in order that the labeller takes for main text, joined by \\n; references
    decoded, white space inside a block single. Null or empty html: empty text, no blocks.
    Other columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.slices(batches, 2, 4 << 20):
            found = [blocks(x) if x else [] for x in batch.column(2).to_pylist()]
            kept: list[list[str]] = [[] for _ in found]
            order = sorted((i for i, p in enumerate(found) if p), key=lambda i: len(found[i]))
            k = 0
            while k < len(order):
                # pages of similar length, some 20,000 blocks with the padding
                size = len(found[order[k]])
                part = order[k : k + max(1, min(256, 20_000 // size))]
                part = [i for i in part if len(found[i]) <= 1.5 * size + 8]
                k += len(part)
                p = scores(shipped.value, *padded([features(found[i]) for i in part]))
                for column, i in enumerate(part):
                    kept[i] = [b.text for b, s in zip(found[i], p[:, column]) if s >= 0.5]
            columns = [batch.column(0), batch.column(1), pa.array(["\n".join(x) for x in kept], pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array([len(x) for x in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_blocks", "n_kept"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks long, n_kept long")
