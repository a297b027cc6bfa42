"""Labelled amounts, references and periods on written cases and over the orders."""

import pytest

from lectern import plans
from lectern.operators import facts

AMOUNTS = [
    ("Base imponible: 100,00 €\nIVA: 21,00 €\nTotal factura: 121,00 €", "121.00", None),
    ("Total: 50,00 €\nTotal a pagar: 45,00 €", "45.00", None),
    ("Importe total a pagar\n1.234,56 €", "1234.56", None),
    ("Importe: 100,00 €. Importe con reducción del 50%: 50,00 €", "100.00", "50.00"),
    ("Multa de 200 €; pronto pago: 100 €", "200", "100"),
    ("Total descuento: 5,00 €\nTotal: 20,00 €", "20.00", None),
    ("Subtotal 80 €\n99,90 € en todo\nIVA 300 €", "99.90", None),
    ("amount due: $1,234.56", "1234.56", None),
    ("Total a pagar antes del 12/10/2026: 33,10 €", "33.10", None),
    ("Total 21 % de 500", "500", None),
    ("Prima anual 300 EUR, prima 20 EUR", "300", None),
    ("Gastos de envío, importe: 9 €", None, None),
    ("Total a pagar " + "." * 70 + " 5 €", "5", None),
    ("nothing 12 here", None, None),
    ("", None, None),
]


@pytest.mark.parametrize("text, best, reduced", AMOUNTS)
def test_chosen_amounts(text, best, reduced):
    a, b = facts.chosen(text)
    assert (None if a is None else str(a.value), None if b is None else str(b.value)) == (best, reduced)


def test_references():
    text = "Nº de póliza: AB-1234\nFactura nº 2024/001.\nExpediente: X-77/2024\nNúmero de cliente 99887\nPedido 123\nReferencia: sin\npedido: P-4455 y contrato número C.00.12-"
    found = facts.references(text)
    assert [(r.value, r.what, r.stable) for r in found] == [("AB-1234", "policy", True), ("2024/001", "invoice", False), ("X-77/2024", "expedient", False), ("99887", "customer", True), ("P-4455", "order", False), ("C.00.12", "contract", True)]
    own = lambda kind: tuple(r and r.value for r in facts.own_reference(found, kind))
    assert own("fine") == ("X-77/2024", "AB-1234") and own("contract") == ("C.00.12", "C.00.12") and own("") == ("AB-1234", "AB-1234") and own("vehicle") == ("AB-1234", "AB-1234")
    assert facts.own_reference([], "fine") == (None, None) and facts.order_reference(text) == "P-4455"
    assert facts.order_reference("sent 123-1234567-1234567 to you") == "123-1234567-1234567" and facts.order_reference("1123-1234567-1234567") == ""


PERIODS = [
    ("Puede presentar alegaciones en el plazo de diez (10) días hábiles desde la notificación.", (10, "day", True, "appeal", "notified")),
    ("permanencia de 12 meses desde el alta del servicio", (12, "month", None, "permanence", "effect")),
    ("La garantía es de tres años desde la entrega", (3, "year", None, "warranty", "delivery")),
    ("cancel with a notice period of 30 calendar days", (30, "day", False, "cancel", "")),
    ("two weeks to respond", (14, "day", None, "appeal", "")),
    ("treinta y un días naturales para el pago", (31, "day", False, "pay", "")),
    ("20 días con pronto pago, o pagar después", (20, "day", None, "fine_pay", "")),
    ("within 5 working days", (5, "day", True, "generic", "")),
    ("garantía\n\n2 meses\n\nrecurso", (2, "month", None, "generic", "")),
]


@pytest.mark.parametrize("text, expected", PERIODS)
def test_periods(text, expected):
    assert [p[1:] for p in facts.periods(text)] == [expected]


def test_no_periods():
    assert list(facts.periods("el 5/10 días, 200 dias, 0 meses, and 12.5 days")) == []


def test_facts_of_every_order(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["o_orderkey"]: r for r in plans.QUERIES["nx_paper_facts"](spark, folder).collect()}
    prices = {r["o_orderkey"]: r["o_totalprice"] for r in spark.read.parquet(f"{folder}/orders.parquet").collect()}
    assert found.keys() == prices.keys()
    for key, r in found.items():
        n = key % 5
        assert r["ref"] == (f"{'FPXO'[n]}-{key}" if n < 4 and key >= 10 else None)
        assert (r["amount"] is None) == (n == 4) and (n == 4 or abs(r["amount"] - prices[key]) < 0.006)
        assert r["first_period"] == {2: "20 day", 3: "36 month"}.get(n) and r["purpose"] == {2: "fine_pay", 3: "warranty"}.get(n)
        assert r["ref_kind"] == ((None, "policy", "expedient", "order", None)[n] if n else "invoice") or key < 10


def test_words_of_labels_miss_no_label():
    """a text without a label's words is not searched for it."""
    for what, _, labels in facts.REFERENCES:
        for label in (labels,) if isinstance(labels, str) else labels:
            assert any(w in label for w in facts.REFERENCE_WORDS[what]), label
    assert all(any(w in label for w in facts.TOTAL_WORDS) for _, shape in facts.TOTALS for label in shape.split("|"))
    for unit in "dia dias mes meses ano anos year years month months day days semana semanas week weeks".split():
        assert [p[1:3] for p in facts.periods(f"plazo de 3 {unit}")], unit


def _searches(monkeypatch, module, name):
    calls = []
    monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name): calls.append(a) or f(*a))
    return calls


def test_each_rule_reads_a_text_once(monkeypatch):
    """references and dates are found once, a text is folded once."""
    from lectern.operators import extraction

    made = {}
    keep = lambda rows, columns, schema, make: made.setdefault("make", make)
    monkeypatch.setattr(facts, "mapped", keep)
    monkeypatch.setattr(extraction, "mapped", keep)
    monkeypatch.setattr(extraction, "classified", lambda rows, *a, **k: rows)
    rows = type("Rows", (), {"dtypes": [("k", "int")]})()
    text = "Factura nº: F-123\nFecha de emisión: 01/02/2024\nTotal a pagar: 10,00 €"
    calls = _searches(monkeypatch, facts, "references")
    facts.facts_of(rows, "k", "t")
    assert len(list(made.pop("make")(1, text))) == 1 and len(calls) == 1
    calls = _searches(monkeypatch, extraction, "dates_in")
    extraction.extract_documents(rows, "k", "t")
    extraction.fold.cache_clear()
    assert len(list(made.pop("make")(1, text, "invoice", 9))) == 1 and len(calls) == 1 and extraction.fold.cache_info().misses == 1
