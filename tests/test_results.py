"""Result pages of four engines."""

import json

import pytest

from lectern.sources import results


def test_pages():
    page = """<html><div class="result"><a class=result__a href="/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1">A <b>title</b></a><script>no</script>
    <div class="extra"><span class="result__snippet">one\n two</span></div></div>
    <div class="result result--ad"><a class="result__a" href="https://ad.example">Ad</a></div>
    <div class="result"><p>no link</p></div><div class="result"><a class="result__a" href="https://html.duckduckgo.com/x">own</a></div>
    <div class="result"><a class="result__a" href="javascript:x">bad</a></div><div class="result"><a class="result__a" href="https://notduckduckgo.com/">ok<div class="result__snippet">open"""
    assert results.hits_of("ddg", page) == [(1, "https://a.example/x?y=1", "A title", "one two", None), (2, "https://notduckduckgo.com/", "okopen", "open", None)]
    bing = '<li class="b_algo"><h2>no</h2></li><li class="x b_algo"><h2><a href="https://b.example/">B</a></h2><p class="b_lineclamp2">clamped</p></li><li class="b_algo"><h2><a href="https://c.example/">C</a></h2><div class="b_caption">whole</div></li><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1!!!">x</a></h2></li>'
    assert results.hits_of("bing", bing) == [(1, "https://b.example/", "B", "clamped", None), (2, "https://c.example/", "C", "whole", None)]


def test_answers():
    one = {"results": [{"url": "https://a/", "title": "T &amp; <b>u</b>", "content": None, "publishedDate": "2024"}, {"title": "x"}, "y", {"url": "https://b/"}]}
    assert results.hits_of("searxng", json.dumps(one)) == [(1, "https://a/", "T & u", "", "2024"), (2, "https://b/", "", "", None)]
    assert results.hits_of("brave", json.dumps({"web": one})) == [(1, "https://a/", "T & u", "", None), (2, "https://b/", "", "", None)]
    for broken in (None, "", "{", "[]", "5", '{"results": 3}', '{"web": []}'):
        assert results.hits_of("searxng", broken) == results.hits_of("brave", broken) == []
    assert results.hits_of("ddg", None) == results.hits_of("bing", "") == []
    with pytest.raises(ValueError):
        results.hits_of("other", "")
    assert results.hits_of("ddg", "<div class=result>" * 2000)[:1] == []
