"""Block detection and the normal text of a page against plain Python."""

import itertools
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.operators import blocks, quality

PAD = "<p>" + "words of an ordinary page " * 60 + "</p>"
CASES = [
    (200, "", None, "http://a/x", ""),
    (None, None, None, None, ""),
    (200, "an article about captcha, akamai and datadome" + PAD, {}, "http://a/", ""),
    (200, "", {"CF-Mitigated": "Challenge"}, "", "cloudflare"),
    (200, "<title>Just a moment...</title>cloudflare", {}, "", "cloudflare"),
    (200, "<title>Just a moment...</title>", {}, "", ""),
    (503, "<div class=cf-chl-x>", {}, "", "cloudflare"),
    (200, "<div class=cf-chl-x>", {}, "", ""),
    (200, "<title>Access Denied</title> Reference &#35;1 errors.edgesuite.net", {}, "", "akamai"),
    (200, "<h1>Access Denied</h1>" + PAD, {}, "", ""),
    (200, "bm-verify", {}, "", "akamai"),
    (200, "bm-verify" + PAD * 10, {}, "", ""),
    (403, "no", {"server": "AkamaiGHost"}, "", "akamai"),
    (200, "x", {"X-DataDome": "1"}, "", "datadome"),
    (200, PAD * 10, {"X-DataDome": "1"}, "", ""),
    (429, PAD * 10, {"set-cookie": "datadome=1"}, "", "datadome"),
    (200, '<iframe src="https://geo.captcha-delivery.com/c">', {}, "", "datadome"),
    (200, "Press &amp; Hold", {}, "", "perimeterx"),
    (403, "px-cloud.net", {}, "", "perimeterx"),
    (200, "px-cloud.net", {}, "", ""),
    (200, "Type the characters you see", {}, "", "captcha"),
    (200, '<div class="x g-recaptcha">', {}, "", "captcha"),
    (200, '<div class="x g-recaptcha">' + PAD, {}, "", ""),
    (200, "Type the characters you see" + "x" * 60_000, {}, "", ""),
    (200, "", {}, "https://a.b/account/login?next=/", "login"),
    (200, "", {}, "https://a.b/login-tips", ""),
    (200, "", {}, "https://a.b/x?to=/login", ""),
    (200, "<title> Iniciar sesión | Tienda</title>", {}, "", "login"),
    (200, "<title>How to log in</title>", {}, "", ""),
    (401, PAD, {}, "", "login"),
    (403, PAD, {}, "", "http_403"),
    (429, PAD, {}, "", "http_429"),
    (502, PAD, {}, "", "http_5xx"),
    (404, PAD, {}, "", ""),
]


def test_detected_blocks(spark):
    rows = [(i, s, h, d, u) for i, (s, h, d, u, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, status int, html string, headers map<string,string>, url string")
    found = df.select("i", blocks.detected_block(F.col("status"), F.col("html"), F.col("headers"), F.col("url")).alias("r"))
    assert {r["i"]: r["r"] for r in found.collect()} == {i: c[-1] for i, c in enumerate(CASES)}


def brute_normal(text):
    out = []
    for raw in (text or "").splitlines():
        line = unicodedata.normalize("NFKC", raw).casefold()
        line = " ".join(re.sub("[​‌﻿]", "", line).split())
        if not line or re.match(quality.VOLATILE_LINE, line, re.I):
            continue
        for shape in quality.VOLATILE:
            line = re.sub(shape, " ", line, flags=re.I)
        if line.strip():
            out.append(" ".join(line.split()))
    return "\n".join(out)


def test_normal_texts(spark):
    lines = ["Price 10,50 €", "Hace 5 minutos", "Quedan 3 horas para el fin", "faltan 2 d\xedas", "Hoy es lunes", "Actualizado hace poco", "Updated 3 mins ago", "Last updated: just now", "\xa9 2024 Them", "(c) x", "Copyright y", "copyrighted z", "at 10:32 pm and 2024-01-02T10:11:12Z", "token 0123456789abcdef0 here", "ﬁne ① ＡＢ Stra\xdfe ​zero", "  ", "tab\tand\x0bline", "a b", "just now", "3 hours left", "12:5 7:45am"]
    texts = ["\n".join(p) for p in itertools.permutations(lines, 2)] + [None, "", "\r\n".join(lines)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r["i"]: r["n"] for r in df.select("i", quality.normalise_for_hash(F.col("text")).alias("n")).collect()}
    assert found == {i: brute_normal(t) for i, t in enumerate(texts)}


def test_normal_texts_of_the_table(spark):
    from lectern import plans

    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r["doc_id"]: r["text"] for r in plans.QUERIES["m19_normalised_text"](spark, folder).collect()}
    assert found == {i: brute_normal(t) for i, t in texts.items()}
