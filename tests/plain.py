"""Independent, row-at-a-time versions of the rules, for comparison only."""

import re

from sievemark import fixed_values as V
from sievemark.functions.rules import RULES
from sievemark.functions.spans import FORM_RULES

_DOCUMENT = [(rule, re.compile(rule.pattern)) for rule in RULES]
_FORM = [(rule, re.compile(rule.pattern)) for rule in FORM_RULES]
_NEEDS_DIGIT = {"fax", "passport", "drivers_license", "id_card"}


def usable(value):
    value = value.strip()
    if 0 < len(value) <= 200 and re.search("[A-Za-z0-9]", value):
        return value
    return None


def _digits(value):
    return len(re.sub(r"\D", "", value))


def _allowed(rule, value):
    labelled = "(?P<val>" in rule.pattern
    if rule.category in _NEEDS_DIGIT or (rule.category == "phone" and labelled):
        return _digits(value) > 0
    if rule.category == "phone":
        return _digits(value) >= 7
    if rule.category == "credit_card":
        return _digits(value) in (13, 15, 16)
    if rule.category == "iban":
        return len(value) >= 15
    if rule.category == "name":
        words = [w.lower().strip(".") for w in value.split()]
        return "@" not in value and not _digits(value) and not all(
            w in V.ROLE_WORDS for w in words)
    return True


def _hits(rules, text):
    for rule, pattern in rules:
        group = "val" if "(?P<val>" in rule.pattern else 0
        for match in pattern.finditer(text):
            snippet = usable(match.group(group))
            if snippet and _allowed(rule, match.group(group)):
                yield rule, match.start(group), match.end(group), snippet


def document_findings(text):
    if not text.strip():
        return []
    out = {}
    for rule, _, _, snippet in _hits(_DOCUMENT, text):
        out.setdefault((rule.category, snippet), rule.pattern)
    return [(c, s, p, "regex") for (c, s), p in out.items()]


def form_spans(text):
    if not text.strip():
        return []
    return [(r.category, a, b, s, r.confidence) for r, a, b, s in _hits(_FORM, text)]


TRICKY = [
    "", "   \n\t ", "no data here", "Tel: 1\n\nFax:\n\n 22 \n",
    "Müller Östergasse 12, 70173 Köln", "\x1c Phone:\x1d 12345678\x85", "TELEFAX: 0",
    "Naïve Name: Émile Zola-Ünal\r\nTel: ١٢٣٤٥٦٧٨٩", "a@b.com.x_y@z.org a@@b.cc",
    "home address: Weg 3\naddress: Bstr. 4 70173 Stuttgart", "billing address: Hauptweg 12",
    "Mobİle: 5    útel: 7 4111-1111-1111-1111-5500 0000 0000 0004",
    "Passport No.: X123 passport no.9 Führerschein: A1-2/3 fÜhrerschein 77a",
    "Berlin → Rom, trip to Paris photo ID x.jpg a .png", "address: Hauptstr. 5 Weg 9",
    "Name: Team Lead\nname: anna k. o'neil X Y Z\nOwner - J. Keller", "💡 tel: 99 💡 Fax: 88 💡",
    "teĺ: 5 cafétel: 12345 ²A-12345 B-12345² C-123456́",
    "::1 2001:db8::1 fe80::1%eth0 1:2:3:4:5:6:7:8 ::ffff:1.2.3.4",
    "1.2.3.4.5 256.1.1.1 0.0.0.0 +49 (711) 123-4567/89 000-12-3456 123 45 6789",
    "Signature: " + "x" * 201 + "\nsigned by: ______\nLogin: a",
    "Paſſport: A1234 ſignature: Bob\nfaX: 3 ſigned by: 4\nKontakt: 5 uſer name: k İD card 123",
    "a.b@c.de.f@g.hi%j@k.lm,@x.yz a@b @c.de x@y.z1 " + "Q" * 3000 + " é@a.bc",
    "phone: 1 phone: 2\nphone: phone: 3\nUser Name:\tx  \x0b\ny",
]
