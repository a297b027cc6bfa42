"""Amounts, reference numbers and periods of paperwork, by labels.

A text is folded once and read line by line: what stands on a line (numbers,
currencies, labels) is listed by place, and a label takes the first number behind it
that is one by itself. Of labelled amounts the strongest label wins, of equal ones
the first; without one the largest amount that no word of tax or deduction precedes.

Tables of labels are fixed values; the rest is per text, so ``facts_of`` runs over
Arrow batches without a shuffle. Defined results: a null or empty text has no facts;
texts of any length are read whole; an amount is a decimal of two places at most,
from 0 up to a thousand million; equal labels or references are told once a place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame

from .extraction import fold, mapped, number

# How a currency is written, and its code.
CURRENCIES = {"€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "usd": "USD", "$": "USD", "£": "GBP", "gbp": "GBP"}
# Labels of amounts, the strongest first, with their worth.
TOTALS = (
    (10, r"total\s+a\s+pagar|importe\s+total\s+a\s+pagar|total\s+a\s+ingresar|importe\s+a\s+pagar|importe\s+a\s+cargar|amount\s+due|total\s+due|importe\s+de\s+la\s+sancion|importe\s+de\s+la\s+multa|importe\s+de\s+la\s+deuda|importe\s+a\s+ingresar|total\s+deuda|importe\s+de\s+la\s+liquidacion"),
    (9, r"importe\s+total|total\s+factura|total\s+de\s+la\s+factura|total\s+recibo|prima\s+total|total\s+prima|total\s*\(\s*iva\s+incluido\s*\)|total\s+iva\s+incluido|importe\s+del\s+recibo|total\s+amount|total\s+invoice|total\s+importe|total\s+pedido|total\s+de\s+la\s+compra|total\s+compra"),
    (7, r"importe\s+de\s+la\s+prima|cuota\s+total|prima\s+anual|prima\s+del\s+seguro|total\s+cuota|importe\s+anual|cuota\s+mensual|cuota\s+anual|precio\s+total|precio\s+final|amount\s+paid|importe\s+pagado|total\s+pagado"),
    (5, r"(?<!\w)total(?!\w)|importe(?!\w)|amount(?!\w)|prima(?!\w)"),
)
# Words before which an amount is not the one to pay, words that turn a label into another one, and labels of a reduced fine.
OTHER_AMOUNTS = r"base\s+imponible|subtotal|sub-total|cuota\s+iva|\biva\b|\bvat\b|\btax\b|impuesto|descuento|recargo|bonificacion|gastos\s+de\s+envio|envio|propina|cambio|entregado|devuelto|consumo|exento|retencion|irpf|base\s+i\.?\s*v\.?\s*a|neto|prima\s+neta|cuota\s+neta"
OTHER_BEHIND = r"\s*(?:de\s+)?(?:descuento|iva|impuesto|base|bonificacion|recargo|envio)"
REDUCED = r"(?:con\s+)?(?:la\s+)?reduccion\s+(?:del\s+)?50\s*%?|importe\s+reducido|pronto\s+pago|50\s*%\s+de\s+reduccion|reducida|importe\s+con\s+descuento\s+del\s+50"
# How far a number may be from its label, what a line of a number alone holds at most, and how much around an amount speaks of it.
REACH, ALONE, WEAK, IGNORED_NEAR, BEFORE, BEHIND, LARGEST = 60, 24, 5, 30, 80, 60, 1_000_000_000

_CURRENCY = r"(?:€|eur(?:os?)?|usd|\$|£|gbp)"
_MONEY = re.compile(rf"(?:(?P<pre>{_CURRENCY})\s*)?(?P<n>\d{{1,3}}(?:[.,\s]\d{{3}})+(?:[.,]\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?)(?!\d)(?:\s*(?P<post>{_CURRENCY}\b|€))?")
_TOTALS = [(worth, re.compile(shape)) for worth, shape in TOTALS]
#: Every label of an amount has one of these words.
TOTAL_WORDS = ("total", "importe", "amount", "prima", "cuota", "precio")
_OTHER, _BEHIND, _REDUCED = re.compile(OTHER_AMOUNTS), re.compile(OTHER_BEHIND), re.compile(REDUCED)


@dataclass(frozen=True)
class Amount:
    start: int
    end: int
    value: Decimal
    currency: str
    label: str = ""
    worth: int = 0


class Line:
    """A line of a folded text: its place and the numbers on it."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.found = list(_MONEY.finditer(text, start, end))
        self.money = [m for m in self.found if m["pre"] or m["post"]]
        single = [m for m in self.found if self._stands_alone(m)]
        self.starts, self.single = [m.start() for m in single], single

    def _stands_alone(self, m: re.Match) -> bool:
        """Not a part of a date, a time, a share or a word."""
        before = self.text[m.start() - 1] if m.start() > self.start else ""
        behind = self.text[m.end() : min(m.end() + 2, self.end)]
        return not (before and (before in "/-:" or before.isalpha() and before != "€")) and behind[:1] not in ("/", ":") and not behind.strip().startswith("%")

    def behind(self, place: int) -> re.Match | None:
        """The first number by itself from ``place`` on."""
        at = bisect_left(self.starts, place)
        return self.single[at] if at < len(self.single) else None


def _amount(m: re.Match, label: str = "", worth: int = 0) -> Amount | None:
    value = number(m["n"])
    if value is None or not 0 <= value < LARGEST:
        return None
    return Amount(m.start(), m.end(), value, CURRENCIES.get(m["pre"] or m["post"] or "", "EUR"), label, worth)


def _lines(folded: str) -> list[Line]:
    ends = [m.start() for m in re.finditer("\n", folded)] + [len(folded)]
    return [Line(folded, a, b) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends)]


def amounts(text: str) -> tuple[list[Amount], list[Amount], list[Line]]:
    """(labelled, with a currency, lines) of a text."""
    folded = fold(text)
    lines = _lines(folded)
    taken: dict[int, Amount] = {}
    said = [(i, line) for i, line in enumerate(lines) if any(folded.find(w, line.start, line.end) >= 0 for w in TOTAL_WORDS)]
    for worth, shape in _TOTALS:
        for i, line in said:
            for label in shape.finditer(folded, line.start, line.end):
                if worth <= WEAK and _OTHER.search(folded[max(line.start, label.start() - IGNORED_NEAR) : label.start()]) or _BEHIND.match(folded[label.end() : label.end() + 14]):
                    continue
                m = line.behind(label.end())
                if m is None and i + 1 < len(lines) and len(folded[lines[i + 1].start : lines[i + 1].end].strip()) <= ALONE:
                    m = lines[i + 1].behind(0)
                    m = m if m is not None and m.start() - lines[i + 1].start <= 3 else None
                elif m is not None and m.start() - label.end() > REACH:
                    m = None
                hit = m and _amount(m, text[label.start() : label.end()].strip(), worth)
                if hit:
                    taken.setdefault(hit.start, hit)  # stronger labels come first
    money = [a for line in lines for m in line.money if (a := _amount(m))]
    return sorted(taken.values(), key=lambda a: a.start), money, lines


def chosen(text: str) -> tuple[Amount | None, Amount | None]:
    """(the amount to pay, the reduced one of a fine)."""
    labelled, money, lines = amounts(text)
    folded = lines[0].text
    starts, ends = [a.start for a in money], sorted(a.end for a in money)
    first_of = [line.start for line in lines]

    def speaks_of(a: Amount) -> str:
        """What stands around an amount up to its neighbours and the sentence's end."""
        line = lines[bisect_right(first_of, a.start) - 1]
        i, j = bisect_right(ends, a.start), bisect_left(starts, a.end)
        left = max(line.start, ends[i - 1] if i else 0, a.start - BEFORE)
        right = min(line.end, starts[j] if j < len(starts) else line.end, a.end + BEHIND)
        return folded[left : a.start] + " " + re.split(r"[.;|]\s|\s{2,}", folded[a.end : right], maxsplit=1)[0]

    reduced = next((a for a in [*money, *labelled] if _REDUCED.search(speaks_of(a))), None)
    other = [a for a in labelled if reduced is None or a.start != reduced.start]
    best = min(other, key=lambda a: (-a.worth, a.start), default=None)
    if best is None:
        free = [a for a in money if (reduced is None or a.start != reduced.start) and not _OTHER.search(folded[lines[bisect_right(first_of, a.start) - 1].start : a.start])]
        best = max(free, key=lambda a: a.value, default=None)
    return best, None if reduced is not None and best is not None and reduced.value >= best.value else reduced


# How "number" is written; labels of references, what each names, and
# whether it stays the same from period to period.
_NO = r"(?:n\.?\s*[ºo°]\.?|num\.?|numero|nro\.?|no\.?|number|#)"
_GAP = r"\s*[:.\-–]?\s*"
_DIGIT = r"(?=[a-z0-9\-/]*\d)"
REFERENCES = (
    ("policy", True, (rf"{_NO}\s+de\s+poliza", rf"poliza\s+{_NO}", rf"policy\s+{_NO}")),
    ("policy", True, (rf"poliza{_GAP}{_DIGIT}", rf"policy{_GAP}{_DIGIT}")),
    ("contract", True, (rf"{_NO}\s+de\s+contrato", rf"contrato\s+{_NO}", r"referencia\s+del\s+contrato", rf"contract\s+{_NO}", rf"{_NO}\s+de\s+abonado")),
    ("customer", True, (rf"{_NO}\s+de\s+cliente", r"codigo\s+de\s+cliente")),
    ("supply", True, (r"\bcups\b",)),
    ("invoice", False, (rf"{_NO}\s+de\s+factura", rf"factura(?:\s+de\s+[a-z]+)?\s+{_NO}", rf"{_NO}\s+factura", rf"invoice\s+{_NO}", rf"factura{_GAP}{_DIGIT}", rf"{_NO}\s+de\s+recibo")),
    ("bulletin", False, (rf"{_NO}\s+de\s+boletin", rf"boletin(?:\s+de\s+denuncia)?{_GAP}(?:{_NO}{_GAP})?{_DIGIT}")),
    ("expedient", False, (rf"{_NO}\s+de\s+expediente", rf"expediente{_GAP}(?:{_NO}{_GAP})?{_DIGIT}")),
    ("reference", False, (rf"referencia{_GAP}{_DIGIT}",)),
    ("order", False, (rf"{_NO}\s+de\s+pedido", rf"order\s+{_NO}", rf"pedido{_GAP}{_DIGIT}")),
)
# Every label of a reference has one of its words.
REFERENCE_WORDS = {"policy": ("poliza", "policy"), "contract": ("contrato", "contract", "abonado"), "customer": ("cliente",), "supply": ("cups",), "invoice": ("factura", "invoice", "recibo"), "bulletin": ("boletin",), "expedient": ("expediente",), "reference": ("referencia",), "order": ("pedido", "order")}
# Which reference is a document's own, by kind, and for other kinds.
PREFERRED = {
    "insurance": ("policy", "contract", "reference"), "contract": ("contract", "policy", "customer", "reference"), "invoice": ("invoice", "order", "reference"), "bill": ("invoice", "contract", "supply", "customer"),
    "receipt": ("order", "invoice", "reference"), "fine": ("bulletin", "expedient", "reference"), "official": ("expedient", "reference", "bulletin"), "tax": ("reference", "expedient", "invoice"),
    "subscription": ("contract", "customer", "invoice", "order"), "warranty": ("order", "invoice", "reference"), "vehicle": ("reference",),
}
PREFERRED_ELSE = ("policy", "contract", "invoice", "expedient", "bulletin", "reference", "customer", "order")
SERIES = ("policy", "contract", "supply")
_REFERENCES = [(what, stable, re.compile(rf"(?<![a-z0-9])(?:{'|'.join(labels)}){_GAP}(?P<said>[a-z0-9][a-z0-9\-/._]{{3,34}})")) for what, stable, labels in REFERENCES]
_MARKET_ORDER = re.compile(r"(?<!\d)\d{3}-\d{7}-\d{7}(?!\d)")


@dataclass(frozen=True)
class Reference:
    start: int
    value: str
    what: str
    stable: bool


def references(text: str) -> list[Reference]:
    """All labelled references in order, one a place."""
    folded, found = fold(text), {}
    for what, stable, shape in _REFERENCES:
        if not any(w in folded for w in REFERENCE_WORDS[what]):
            continue
        for m in shape.finditer(folded):
            value = text[m.start("said") : m.end("said")].rstrip(".-_/")
            if len(value) >= 4 and any(c.isdigit() for c in value):
                found.setdefault(m.start("said"), Reference(m.start("said"), value, what, stable))
    return [found[at] for at in sorted(found)]


def own_reference(found: list[Reference], kind: str) -> tuple[Reference | None, Reference | None]:
    """(the document's reference, the one that its series keeps)."""
    place = {what: i for i, what in enumerate(PREFERRED.get(kind, PREFERRED_ELSE))}
    own = min(found, key=lambda r: (place.get(r.what, len(place)), r.start), default=None)
    if own is None or own.stable:
        return own, own
    return own, next((r for r in found if r.stable and r.what in SERIES), None)


def order_reference(text: str, found: list[Reference] | None = None) -> str:
    """A labelled order number, else one in a large market's form, else ''; ``found``:
    the text's references, if they are known."""
    labelled = next((r.value for r in (references(text) if found is None else found) if r.what == "order"), None)
    market = _MARKET_ORDER.search(text)
    return labelled or (market[0] if market else "")


# Numbers as words; what a period is for, with the characters by which
# a purpose counts as nearer; and from when it runs.
NUMBERS = {w: n for n, words in enumerate("|un uno una one|dos two|tres three|cuatro four|cinco five|seis six|siete seven|ocho eight|nueve nine|diez ten|once|doce twelve|trece|catorce fourteen|quince fifteen|dieciseis|diecisiete|dieciocho|diecinueve|veinte twenty|veintiun veintiuno veintiuna|veintidos|veintitres|veinticuatro|veinticinco|veintiseis|veintisiete|veintiocho|veintinueve".split("|")) for w in words.split()} | {"treinta": 30, "thirty": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "sixty": 60, "noventa": 90, "ninety": 90}
PURPOSES = (
    ("fine_pay", 40, r"pronto\s+pago|reduccion\s+del\s+50|pago\s+voluntario|periodo\s+voluntario|con\s+la\s+reduccion"),
    ("appeal", 0, r"alegacion|recurso|reposicion|alzada|recurrir|impugn|reclamacion|audiencia|contestar|responder|subsan|aportar|requerimiento|presentar|comparecer|allegations|appeal|respond"),
    ("pay", 0, r"\bpagar|\bpago|ingreso|ingresar|abonar|abono|liquidar|payment|pay\b"),
    ("permanence", 25, r"permanencia|compromiso"),
    ("warranty", 25, r"garantia|warranty"),
    ("cancel", 10, r"\bbaja\b|cancelar|cancelacion|preaviso|desistir|desistimiento|rescindir|notice\s+period"),
)
BASES = (
    ("notified", r"notificacion|notificado|recepcion|recibo\s+de\s+la\s+presente|puesta\s+a\s+disposicion|dia\s+siguiente\s+al\s+de\s+la\s+notif"),
    ("effect", r"fecha\s+de\s+efecto|entrada\s+en\s+vigor|efecto\s+del\s+contrato|alta\s+del\s+servicio|activacion"),
    ("issue", r"fecha\s+de\s+(?:firma|contrato|emision|compra)|firma\s+del\s+contrato|desde\s+la\s+firma"),
    ("delivery", r"entrega|delivery"),
)
WORKING = ("habiles", "laborables", "working", "business")
NATURAL = ("naturales", "calendario", "calendar", "natural")
AROUND_BEFORE, AROUND_BEHIND, LONGEST = 160, 200, 120

_WORDS = "|".join(sorted(NUMBERS, key=len, reverse=True))
_PERIOD = re.compile(
    rf"(?<![\w/.,-])(?P<n>\d{{1,3}}|(?:{_WORDS})(?:\s+y\s+(?:{_WORDS}))?)(?:\s*\(\s*\d{{1,3}}\s*\))?\s*(?:(?P<pre>{'|'.join(WORKING[2:] + NATURAL[2:])})\s+)?"
    rf"(?P<unit>dias?|meses|mes|anos?|years?|months?|days?|semanas?|weeks?)\b(?:\s*(?P<post>{'|'.join(WORKING + NATURAL[:3])}))?"
)
#: Every unit of a period begins with one of these.
UNIT_WORDS = ("dia", "mes", "ano", "year", "month", "day", "semana", "week")
_UNIT = {"d": ("day", 1), "m": ("month", 1), "a": ("year", 1), "y": ("year", 1), "s": ("day", 7), "w": ("day", 7)}
_PURPOSES = [(name, near, re.compile(shape)) for name, near, shape in PURPOSES]
_BASES = [(name, re.compile(shape)) for name, shape in BASES]


def periods(text: str) -> Iterator[tuple[int, int, str, bool | None, str, str]]:
    """(start, number, unit, working days or not or unsaid, purpose, base): the
    purpose is the nearest of the paragraph around, the base the first that it names."""
    folded = fold(text)
    if not any(w in folded for w in UNIT_WORDS):
        return
    breaks = [m.start() for m in re.finditer("\n\n", folded)]
    for m in _PERIOD.finditer(folded):
        words = [m["n"]] if m["n"].isdigit() else re.split(r"\s+y\s+", m["n"])
        n = sum(int(w) if w.isdigit() else NUMBERS[w] for w in words)
        unit, times = _UNIT[m["unit"][0]]
        if not 0 < n <= LONGEST:
            continue
        said = m["post"] or m["pre"]
        above, below = bisect_left(breaks, m.start()), bisect_left(breaks, m.end())
        left = max(0, m.start() - AROUND_BEFORE, breaks[above - 1] if above else 0)
        right = min(len(folded), m.end() + AROUND_BEHIND, breaks[below] if below < len(breaks) else len(folded))
        near = [(abs(x.start() - m.start()) - bonus, i) for i, (_, bonus, shape) in enumerate(_PURPOSES) for x in shape.finditer(folded, left, right)]
        purpose = _PURPOSES[min(near)[1]][0] if near else "generic"
        base = next((name for name, shape in _BASES if shape.search(folded, left, right)), "")
        yield m.start(), n * times, unit, None if said is None else said in WORKING, purpose, base


def facts_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, amount, label, reduced, ref, ref_kind, stable_ref, order_ref, n_periods,
    first_period, purpose, base) of every text; kinds of documents are not looked at."""

    def make(k, body):
        body = body or ""
        best, reduced = chosen(body)
        refs = references(body)
        own, stable = own_reference(refs, "")
        found = list(periods(body))
        _, n, unit, _, purpose, base = found[0] if found else (0, None, None, None, None, None)
        yield k, best and float(best.value), best and best.label, reduced and float(reduced.value), own and own.value, own and own.what, stable and stable.value, order_reference(body, refs), len(found), n and f"{n} {unit}", purpose, base

    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, amount double, label string, reduced double, ref string, ref_kind string, stable_ref string, order_ref string, n_periods bigint, first_period string, purpose string, base string"
    return mapped(rows, [key, text], schema, make)
