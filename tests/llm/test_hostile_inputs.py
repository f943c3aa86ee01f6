"""Texts made to be slow, marks that are no letters, and columns named like the operators' own."""

import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_corpus import odd

from casewright.functions.columns import unused
from casewright.llm import decontaminate, exact_dedup, html_extract, language_id, near_dedup, secrets


def text_of(html):
    return [b.text() for b in html_extract.blocks(html)]


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>", "<![CDATA[", "<!x", "<a href='x' ", "<p><div class=ad>", "<!--", "</p>", "<b></i>"])
def test_a_megabyte_of_markup_takes_seconds(part):
    began = time.time()
    html_extract.blocks(part * (1_000_000 // len(part)), {})
    assert time.time() - began < 15


def test_comments_and_unclosed_tags():
    assert text_of("<p>a</p><!--><p>b</p>") == ["a", "b"] == text_of("<p>a</p><!---><p>b</p>") == text_of("<p>a</p><!-- <p>x</p> --><p>b</p>")
    assert text_of("<p>a</p><!-- never closed <p>b</p>") == ["a"]
    assert text_of("a <b 1 < 2 > \"x") == ['a <b 1 < 2 > "x'] and text_of("<p title='a>b'>x</p>") == ["x"] and text_of('<p>1 <a href="x>y') == ['1 <a href="x>y']


def test_deep_elements_keep_their_text():
    deep = "<div>" * 1000 + "core" + "</div>" * 1000 + "<p>after</p>"
    assert text_of(deep) == ["core", "after"]
    assert html_extract.blocks(deep)[0].path.count("/") == html_extract.DEEPEST


def test_secrets_take_linear_time_and_skip_what_patterns_found():
    text = 'token: "abcdef123456" ' * 10000 + " auth zzzzzzzzzzzzzzz1zzzzzzzzzzzz" * 10000
    began = time.time()
    base = secrets.base_spans(text)
    found = secrets.novel_spans(text, base)
    assert time.time() - began < 10 and len(base) == 10000
    text = "key=" + "9f8a7b6c5d4e3f2a1b0c9d8e" + " secret Zx9Kq2Lw8Pv5Tn3Rb7Ym1Jc4 token=abcDEF123456789012"
    base = secrets.base_spans(text)
    spans = [(s, e) for s, _, e in secrets.novel_spans(text, base)]
    assert all(not (b[0] < e and s < b[2]) for s, e in spans for b in base) and found is not None


def test_marks_are_no_letters():
    assert language_id.keys_of(["́̂", "áb", "", "1 2", "\U0001d165", "\U00010400"])[2].tolist() == [0, 2, 0, 0, 0, 1]


def test_columns_named_like_the_operators_own(spark):
    taken = {c: F.lit("x") for c in ("copy_id", "copy_digest", "near_id", "near_digest", "found_id", "found_digest", "_copy_id", "_copy_digest", "_near_id", "_near_digest", "_found_id", "_found_digest", "kept", "digest")}
    docs, plain = odd(spark).withColumns(taken), odd(spark)
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, benchmark)):
        got = drop(docs)
        assert got.columns == docs.columns and sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, drop(plain).collect()))
    assert unused(docs, "copy_id") == ["copy_id_"]
