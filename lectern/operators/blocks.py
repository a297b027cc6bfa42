"""Pages that stand in for the page that was asked for: challenges, captchas, log-in
walls, error pages.

Words alone say nothing (an article may speak of captchas), so a sign is a header, a
title, an address or a piece of markup, and markup counts on small pages only. All
is said in Column expressions: ``signs`` names what a response shows, ``RULES`` which
signs together give which reason, and the first rule that holds decides.

Defined results: a null status, page, address or header map shows nothing; header
names are read in any case; a page of any length is measured whole, of a large one
no markup is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markup import decode_entities, strip_tags

# Sizes of pages in characters, and of the text of an empty one.
SMALL_PAGE, TINY_PAGE, BARE_TEXT = 60_000, 12_000, 800
#: Part of a page in which its title is looked for.
TITLE_CHARS = 40_000
# What stands in the markup, titles and addresses of such pages.
CLOUDFLARE_MARKERS = ("challenges.cloudflare.com", "challenge-platform", "cf-chl", "cf-turnstile", "__cf_chl", "cdn-cgi/styles/cf.errors")
CLOUDFLARE_TITLE = r"(?i)just a moment|un momento|attention required!? \| cloudflare|checking your browser|verificando"
AKAMAI_ERRORS = ("reference #", "errors.edgesuite.net", "akamai")
AKAMAI_CHECKS = ("bm-verify", "/_sec/verify", "triggerinterstitialchallenge")
DATADOME_FRAMES = ("captcha-delivery.com", "geo.captcha-delivery")
PERIMETERX_MARKERS = ('id="px-captcha"', "id='px-captcha'", "press & hold", "pulsa y mantén")
ROBOT_CHECKS = ("validatecaptcha", "robot check", "introduce los caracteres que ves", "type the characters you see", "enter the characters you see below", "introduce los caracteres que aparecen")
CAPTCHA_WIDGET = r'class="[^"]*\b(?:g-recaptcha|h-captcha|cf-turnstile)\b|data-sitekey='
LOGIN_PATH = r"(?i)/(?:login|log-in|signin|sign-in|sign_in|iniciar-?sesion|acceso|ap/signin|account/login|customer/account/login)(?:[/?#.]|$)"
LOGIN_TITLE = r"(?i)^\s*(?:inicia(?:r)?\s+sesi[oó]n|acceso\s+de\s+clientes|identif[ií]cate|sign\s*in|log\s*in|login|iniciar sesi[oó]n en .*)\s*(?:[|\-–—:].*)?$"


def signs(status: Column, html: Column, headers: Column, url: Column) -> dict[str, Column]:
    """What a response shows, by name; each is true or false."""
    page = F.coalesce(html, F.lit(""))
    size = F.length(page)
    small, tiny = size < SMALL_PAGE, size < TINY_PAGE
    body = F.lower(decode_entities(F.when(small, page).otherwise("")))
    title = F.trim(decode_entities(F.regexp_replace(F.regexp_extract(F.substring(F.when(small, page).otherwise(""), 1, TITLE_CHARS), r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", "")))
    told = F.coalesce(F.transform_keys(headers, lambda k, v: F.lower(k)), F.create_map().cast("map<string,string>"))
    header = lambda name: F.lower(F.coalesce(F.element_at(told, name), F.lit("")))
    cookies = F.concat_ws(" ", header("set-cookie"), header("cookie"))
    any_of = lambda marks: reduce(or_, (body.contains(m) for m in marks))
    state = F.coalesce(status, F.lit(0))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    visible = F.length(F.trim(F.regexp_replace(strip_tags(page), r"\s+", " ")))
    return {
        "tiny": tiny,
        "refused": state.isin(403, 429),
        "unavailable": state.isin(403, 429, 503),
        "unauthorised": state == 401,
        "forbidden": state == 403,
        "too many": state == 429,
        "server error": state.between(500, 599),
        "cloudflare header": header("cf-mitigated") == "challenge",
        "cloudflare title": title.rlike(CLOUDFLARE_TITLE),
        "cloudflare marker": any_of(CLOUDFLARE_MARKERS),
        "cloudflare named": any_of(("cloudflare", *CLOUDFLARE_MARKERS)),
        "denied": F.lower(title).contains("access denied") | body.contains("<h1>access denied</h1>"),
        "akamai error": any_of(AKAMAI_ERRORS),
        "akamai check": any_of(AKAMAI_CHECKS),
        "akamai server": header("server").contains("akamai"),
        "datadome header": F.map_contains_key(told, "x-datadome") | F.map_contains_key(told, "x-dd-b") | cookies.contains("datadome="),
        "datadome frame": any_of(DATADOME_FRAMES),
        "perimeterx": any_of(PERIMETERX_MARKERS),
        "perimeterx script": body.contains("px-cloud.net"),
        "robot check": any_of(ROBOT_CHECKS),
        "captcha widget": body.rlike(CAPTCHA_WIDGET),
        "bare": small & (visible < BARE_TEXT),
        "login path": path.rlike(LOGIN_PATH),
        "login title": (title != "") & title.rlike(LOGIN_TITLE),
    }


#: (reason, signs that must all be there), the first that holds decides.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("cloudflare", ("cloudflare header",)),
    ("cloudflare", ("cloudflare title", "cloudflare named")),
    ("cloudflare", ("unavailable", "cloudflare marker")),
    ("akamai", ("denied", "akamai error")),
    ("akamai", ("tiny", "akamai check")),
    ("akamai", ("refused", "akamai server", "tiny")),
    ("datadome", ("datadome header", "refused")),
    ("datadome", ("datadome header", "tiny")),
    ("datadome", ("datadome frame",)),
    ("perimeterx", ("perimeterx",)),
    ("perimeterx", ("perimeterx script", "refused")),
    ("captcha", ("robot check",)),
    ("captcha", ("captcha widget", "bare")),
    ("login", ("login path",)),
    ("login", ("login title",)),
    ("login", ("unauthorised",)),
    ("http_403", ("forbidden",)),
    ("http_429", ("too many",)),
    ("http_5xx", ("server error",)),
)


def detected_block(status: Column, html: Column, headers: Column, url: Column) -> Column:
    """cloudflare, akamai, datadome, perimeterx, captcha, login, http_403, http_429,
    http_5xx, or '' for a page that looks fine."""
    shown = signs(status, html, headers, url)
    holds: Callable[[tuple[str, ...]], Column] = lambda names: reduce(and_, (shown[n] for n in names))
    return F.coalesce(*[F.when(holds(names), reason) for reason, names in RULES], F.lit(""))
