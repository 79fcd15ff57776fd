"""The forms corpus: one labelled text per customer, supplier and order.

The given texts hold almost no labelled data, so the label rules run on forms whose every line
is computed from a key. The expressions are plain SQL that Spark and DuckDB read alike; names
and streets stay ASCII because the DuckDB side matches ASCII words only.
"""

_NL = "chr(10)"


def _pick(words: str, key: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', CAST({key} % {n} + 1 AS INT))"


def _pad(key: str, digits: int) -> str:
    return f"lpad(CAST({key} % {10 ** digits} AS STRING), {digits}, '0')"


FIRST = _pick("Anna,Bruno,Clara,David,Elena,Felix,Greta,Hugo", "k")
LAST = _pick("Fischer,Keller,Wagner,Braun,Schmid,Vogt,Lang", "k")
CITY = _pick("Stuttgart,Hamburg,Leipzig,Bremen,Dresden", "k")


def _line(modulus: int, cases: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {rest} THEN {text} || {_NL}" for rest, text in cases.items())
    return f"CASE k % {modulus} {whens} ELSE '' END"


_LINES = [
    f"'Record sheet' || {_NL}",
    _line(4, {
        0: f"'Name: ' || {FIRST} || ' ' || {LAST}",
        1: "'Owner: Team Lead'",
        2: f"'Manager: ' || {FIRST} || ' ' || {LAST}",
    }),
    _line(9, {
        0: f"'Email: ' || lower({FIRST}) || '.' || lower({LAST}) || k || '@example.com'",
        3: "'Email: nobody at localhost'",
        6: f"'write to ' || lower({LAST}) || '+hr@mail.example.org please'",
    }),
    _line(5, {
        0: f"'Phone: +49 711 ' || {_pad('k', 6)}",
        1: f"'Tel - 089 ' || {_pad('k', 5)} || ' ext'",
        2: "'Mobile: not listed'",
        3: f"'call (030) 55' || {_pad('k', 5)} || ' now'",
    }),
    _line(6, {
        0: f"'Fax number: +49 30 ' || {_pad('k', 6)}",
        1: f"'Telefax:' || {_NL} || '  0711 ' || {_pad('k', 6)}",
        2: "'Fax: none'",
    }),
    _line(7, {
        0: "'Username: user' || k",
        1: "'Username: ______'",
        2: f"'Badge E-' || {_pad('k', 5)} || ' issued'",
        3: "'Login: ' || repeat('x', 220)",
        4: f"'Account: acc-' || {_pad('k', 4)}",
    }),
    _line(8, {
        0: f"'Signature: ' || substring({FIRST}, 1, 1) || '. ' || {LAST}",
        1: f"'Signed by: ' || {FIRST}",
        2: "'Signature: ________'",
    }),
    _line(10, {
        0: f"'Passport No: C' || {_pad('k', 7)}",
        1: "'Passport: pending'",
        2: f"'Reisepass T22' || {_pad('k', 6)}",
    }),
    _line(11, {
        0: f"'Driver' || chr(39) || 's license: D' || {_pad('k', 6)}",
        1: f"'ID card no 7' || {_pad('k', 8)}",
        2: f"'Tax ID: DE' || {_pad('k', 9)}",
        3: f"'Personalausweis: L' || {_pad('k', 6)}",
        4: f"'Driving licence lost'",
    }),
    _line(13, {
        0: "'server 10.1.' || (k % 256) || '.7 is up'",
        1: "'server 256.1.2.3 is down'",
        2: "'node 2001:db8:0:0:0:0:0:' || (k % 10) || ' ok'",
        3: "'node fe80::1 ok'",
    }),
    _line(12, {
        0: f"'card 4111 1111 1111 ' || {_pad('k', 4)} || ' on file'",
        1: "'card 4111 1111 1111 on file'",
        2: f"'amex 3714496353' || {_pad('k', 5)} || ' on file'",
    }),
    _line(14, {
        0: f"'IBAN DE44' || {_pad('k', 9)} || {_pad('k', 9)}",
        1: "'IBAN DE441234'",
    }),
    _line(15, {
        0: f"'SSN 123-45-' || {_pad('k', 4)}",
        1: "'SSN 900-12-3456'",
        2: "'SSN 000-12-3456'",
        3: f"'social security 665 12 ' || {_pad('k', 4)}",
    }),
    _line(16, {
        0: "'DOB: 12/03/' || (1950 + k % 50)",
        1: "'Date of birth: ' || (1950 + k % 50) || '-03-12'",
        2: "'Born: 7.11.' || (1950 + k % 50)",
        3: "'Born: in spring'",
    }),
    _line(17, {
        0: f"'Home address: Lindenstr. ' || (k % 90 + 1) || ', 70173 ' || {CITY}",
        1: "'Billing address: Hauptweg ' || (k % 90 + 1)",
        2: "'meet at Rosenallee ' || (k % 90 + 1) || ' today'",
        3: f"'office in 80331 ' || {CITY}",
        4: "'Shipping address: dock ' || (k % 9)",
    }),
    _line(19, {
        0: f"'booked a round trip for {'{'}0{'}'}'".replace("{0}", "two"),
        1: f"'flight LH' || (100 + k % 900) || ' confirmed'",
        2: f"'she travelled to ' || {CITY} || ' once'",
        3: f"'route ' || {CITY} || ' -> Madrid'",
        4: "'no itinerary yet, one-way'",
    }),
    _line(18, {
        0: "'headshot kept on file'",
        1: "'passport photo missing'",
        2: "'video of the employee stored'",
    }),
    "'end of sheet'",
]

# Keys of the three tables overlap, so the path carries the kind and the table's letter.
SOURCES = f"""
SELECT {_pick("intake,training,internal_memo", "c_custkey")} AS kind, 'c' AS origin,
       CAST(c_custkey AS BIGINT) AS k FROM customer
UNION ALL SELECT 'supplier', 's', CAST(s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT {_pick("expense,it_access,incident,notes", "o_orderkey")}, 'o',
       CAST(o_orderkey AS BIGINT) FROM orders
"""
TEXT = (
    "CASE WHEN kind = 'internal_memo' AND k % 5 <> 0 THEN 'plain memo without details' ELSE "
    + " || ".join(_LINES) + " END"
)
PATH = "'/share/' || kind || '/' || kind || '_' || origin || k || '.txt'"
COLUMNS = ["kind", "origin", "k", f"{PATH} AS path", f"{TEXT} AS text"]
FORMS = f"SELECT {', '.join(COLUMNS)} FROM ({SOURCES}) AS src"
