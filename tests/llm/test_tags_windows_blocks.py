"""Scanning of broken pages, windows of any length, and buckets of many classes."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from soilspark.llm import bagminhash, decontaminate, html_extract

WEIGHT = {"#word": 1.0, "#tag": -0.5}


@pytest.mark.parametrize("end", ["", ">"])
@pytest.mark.parametrize("form", ["<a ", '<a href="', "<a b='", '<a "> "', "<", "</", "<!", "<!--", "<script>", "<script", "<style ", "<a b=\"'>", '<div class="', "<?", "<p", "</a/<"])
def test_broken_pages_take_linear_time(form, end):
    page = form * (2_000_000 // len(form)) + end
    began = time.perf_counter()
    html_extract.extract(page, WEIGHT)
    assert time.perf_counter() - began < 5


def test_tags_end_where_their_quotes_let_them():
    assert html_extract.tokens('a<p x=">">b<i y=\'"\'>c<u z="q>d') == [("", "a", False), ("p", ' x=">"', True), ("", "b", False), ("i", " y='\"'", True), ("", "c", False), ("u", ' z="q', True), ("", "d", False)]
    assert html_extract.tokens("1 < 2 </3> <SCRIPT a>x<b></script >y<!-- <b> -->z<br/></B c><x") == [
        ("", "1 < 2 </3> ", False), ("!", "", False), ("", "y", False), ("!", "", False), ("", "z", False), ("br", "/", False), ("/b", " c", False), ("", "<x", False),
    ]
    assert html_extract.tokens("x<!-- never closed <p>") == [("", "x", False), ("!", "", False)] and html_extract.tokens("<a <!-- b") == [("", "<a ", False), ("!", "", False)]


@pytest.mark.parametrize("name", ["ad-slot", "adbox", "adSlot", "newsletter-signup", "related-posts", "relatedPosts", "site-footer", "share-buttons", "comment-list", "social-icons", "cookie-banner"])
def test_adverts_and_the_like_go(name):
    page = f'<html><body><article><p>One two three four.</p><div class="{name}"><p>Buy this now.</p></div><p>Five six seven.</p></article></body></html>'
    assert html_extract.extract(page, WEIGHT) == "One two three four.\n\nFive six seven."


@pytest.mark.parametrize("name", ["share-price", "has-sidebar", "cookie-recipe", "social-science", "adventure", "address", "no-comments", "related-article", "content"])
def test_what_only_sounds_like_them_stays(name):
    page = f'<html><body><article><p>One two three four.</p><div class="{name}"><p>Keep this here.</p></div><p>Five six seven.</p></article></body></html>'
    assert html_extract.extract(page, WEIGHT) == "One two three four.\n\nKeep this here.\n\nFive six seven."


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("limit", [0, decontaminate.MAX_BROADCAST_WINDOWS])
@pytest.mark.parametrize("window", [2, 3, 10, 20])
def test_windows_of_any_length_on_either_path(spark, window, limit):
    rng = random.Random(window)
    some = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(n)]
    items = [(f"i{k}", some(rng.choice([1, 2, 4, 9, 10, 11, 25, 40]))) for k in range(14)]
    docs = [(k, some(rng.randint(0, 60))) for k in range(15)]
    docs += [(20 + k, some(rng.randint(0, 12)) + words[rng.randrange(len(words)) // 2 :] + some(rng.randint(0, 9))) for k, (_, words) in enumerate(items)]
    docs += [(50, items[7][1] + items[7][1]), (51, items[3][1][:-1])]
    want = {}
    for i, w in docs:
        hit, found = set(), set()
        for item, b in items:
            n = min(window, len(b))
            own = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in own:
                    hit |= set(range(s, s + n))
                    found.add(item)
        want[i] = (len(w), len(hit), len(found))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(df, asked, window, limit).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 20
    clean = {r["doc_id"] for r in decontaminate.clean(df, asked, window, limit).collect()}
    assert clean == {i for i, (_, n, _) in want.items() if not n}


def test_overlaps_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    whole = bagminhash.overlaps(pa.array(texts))
    pieces = bagminhash.chunks
    monkeypatch.setattr(bagminhash, "chunks", lambda t: pieces(t, 100))
    assert np.array_equal(bagminhash.overlaps(pa.array(texts)), whole)


def test_a_bucket_of_single_rows_is_cut_into_bounded_groups(spark):
    n = 3 * bagminhash.BLOCK
    rows = spark.range(n).selectExpr("id", "1L AS bucket", "id AS root")
    sizes = {(r["i"], r["j"]): r["count"] for r in bagminhash._dealt(rows).groupBy("i", "j").count().collect()}
    blocks = -(-(n - 1) // bagminhash.BLOCK)
    assert max(sizes.values()) <= 2.6 * bagminhash.BLOCK and len(sizes) == blocks * (blocks + 1) // 2 + blocks
