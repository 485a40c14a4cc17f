import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kinlink.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The strict rules by the patterns themselves."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("a1.@-_9 2+()é", max_size=40))
def test_base_equals_the_patterns(text):
    assert pii.find_base(text) == plain(text)


def test_base_on_known_values():
    text = "card 4111 1111 1111 1111 and 4111-1111-1111-1112, call +1 (212) 555-0123, ip 10.0.0.255 or 10.0.0.256, a@b.co"
    assert [k for k, *_ in pii.find_base(text)] == ["email", "ip", "card", "phone"]


def test_model_adds_and_leaves_alone():
    d = pii.fit()
    texts = ["call me at (212) 555-1234 please", "mail: joe (at) site (dot) com", "iban DE89370400440532013000 ok", "ssn 123-45-6789", "order 123-456-7890", "version 1.2.3.4000", "plain words only", None, ""]
    added = [[s[0] for s in more] for _, more in d.find(texts)]
    assert added == [["phone"], ["email"], ["iban"], ["ssn"], [], [], [], [], []]


#: Lines written by hand, apart from the training sentences: kind, whether it is personal, text with the item in ‹›.
BY_HAND = """
email 1 For a copy of the slides drop a line to ‹maria (at) uni-koeln (dot) de› or stop by.
email 1 Reporter: ‹j.smith [at] dailypost.com›, London
email 1 Si tienes dudas, mándalas a ‹ayuda (at) tienda (dot) es› sin problema
email 1 Mon adresse reste ‹claire [at] exemple [dot] fr› pour l'instant
email 1 The maintainer, ‹hugo (at) openmaps (dot) org›, merged it yesterday.
email 1 Anfragen bitte an ‹info @ werkstatt.de› richten
email 0 Let us meet ‹downtown @ the.corner› as we always do
email 0 Coffee ‹break (at) noon. Lunch› follows an hour later
phone 1 Need a plumber? Ask for Joe, ‹(415) 555-0134›, day or night - just call.
phone 1 For reservations please phone ‹212-555-0187› after six.
phone 1 Mein Handy ‹0049 171 5550123› ist immer an
phone 1 Our fax machine answers at ‹303.555.0119› around the clock.
phone 1 Llame al ‹(091) 555 12 34› para pedir cita
phone 1 Text STOP to ‹646-555-0172› to end these messages
phone 1 Grandma's new telephone: ‹718 555 0144›
phone 1 Il faut appeler le ‹0033 155 5501234› avant midi
phone 0 rows of numbers like ‹0054994038693466› in plain prose
phone 0 and then 81 33 ‹004 118 2204› 77 12 in the table
phone 0 Please quote invoice ‹555-210-8841› in all letters.
phone 0 The bolt, SKU ‹302-118-4470›, fits both frames.
phone 0 Your ticket ‹800-221-9034› has been merged with another one.
phone 0 ISBN ‹978-306-4061› belongs to the older edition
phone 0 Shipment under order ‹404-871-2290› left the dock.
phone 0 Die Rechnung ‹069-118-2204› ist bezahlt
phone 0 Refer to case ‹217-556-0091› when you write back.
card 1 He read out his credit card, ‹4111. 1111. 1111. 1111›, over the line.
card 1 Paid with Mastercard ‹5500/0000/0000/0004› yesterday
card 1 Die Kreditkarte ‹4012. 8888. 8888. 1881› wurde gesperrt.
card 1 Use debit ‹6011_0009_9013_9424› for the deposit
card 1 the payment went through on ‹4222  2222  2222  2220› last night
card 0 Serial ‹4111. 1111. 1111. 1112› is stamped on the frame.
card 0 Library entry ‹1234/5678/9012/3456› was withdrawn
card 0 The order ‹9876. 5432. 1098. 7654› is late.
ssn 1 Applicant's social security no. ‹219-09-9999› was checked.
ssn 1 SSN: ‹078-05-1120›
ssn 1 For payroll we still need ‹457-55-5462› confirmed by the employee's security file.
ssn 1 the taxpayer id on file, ‹536-22-1147›, is hers
ssn 0 The washer, part ‹212-48-3310›, is no longer made.
ssn 0 Catalog ‹118-22-7400› lists the blue one.
ssn 0 social security ‹000-12-3456› cannot be right
ssn 0 batch ‹330-14-8821› failed the test
iban 1 Kindly wire the balance to ‹GB82 WEST 1234 5698 7654 32› this week.
iban 1 Mein Konto: ‹DE89370400440532013000›
iban 1 Virement sur ‹FR1420041010050500013M02606› merci
iban 1 The club's account, ‹NL91 ABNA 0417 1643 00›, is open for gifts.
iban 1 Donations: ‹AT61 1904 3002 3457 3201›
iban 0 The machine, model ‹GB12 WEST 1234 5698 7654 32›, is loud.
iban 0 Ticket ‹DE00370400440532013000› was closed
iban 0 Container ‹FR7620041010050500013M02606› arrived empty.
ip 1 Our gateway now answers on ‹2001:db8:85a3:8d3:1319:8a2e:370:7348› only.
ip 1 failed ssh login from ‹fe80:0:0:0:202:b3ff:fe1e:8329› at dawn
ip 1 The node ‹2001:0db8:0000:0042:0000:8a2e:0370:7334› left the ring
ip 0 He finished in ‹02:14:33:20›, a record.
ip 0 Firmware ‹10.4.300.1187› fixes the bug.
ip 0 They upgraded to version ‹2.16.840.1133› last week
ip 0 The timer showed ‹11:22:33:44› and rang
""".strip().splitlines()


#: Lines written after the model was settled, measured once; nothing was changed for them.
FRESH = """
email 1 Job applications: ‹hr (at) northwind-tools (dot) com›, no calls.
email 1 ping ‹t.okafor[at]lab[dot]edu› if the cluster is down
email 1 Escríbeme a ‹lucia @ correo.es› cuando llegues
email 0 The seminar starts ‹promptly (at) eleven. Bring› a pen
phone 1 Taxi from the station: ‹(030) 555 44 21›
phone 1 Emergency? Dial ‹555-867-5309› now
phone 1 You may leave word with my sister at ‹617.555.0163›.
phone 1 Sekretariat, Telefon ‹0049 228 5550199›, nur vormittags
phone 1 Whatsapp me: ‹917 555 0128›
phone 0 Form ‹204-775-3381› must be signed twice.
phone 0 The catalogue number is ‹415-220-9917›.
phone 0 He scored ‹120 344 9921› points in the game
phone 0 order ref ‹0047 118 2204331› was cancelled
card 1 The hotel charged ‹5105/1051/0510/5100› twice, please refund.
card 1 my amex-like card reads ‹3530. 1113. 3330. 0000›
card 0 Batch ‹5105/1051/0510/5101› was scrapped.
ssn 1 Her SSN, ‹321-54-9876›, was leaked.
ssn 1 Please enter your Social Security Number (‹210-11-3344›) below
ssn 0 Revision ‹321-54-9876› of the drawing is void.
iban 1 Refund goes to ‹ES91 2100 0418 4502 0005 1332› within days
iban 1 Bankverbindung: ‹CH9300762011623852957›
iban 0 Article ‹ES00 2100 0418 4502 0005 1332› is out of stock.
ip 1 traceroute stops at ‹2001:db8:0:1:1:1:1:1›
ip 0 Lap times were ‹01:12:44:09› and slower
""".strip().splitlines()


def by_hand(lines=BY_HAND):
    """For each kind how many items are found rightly, found wrongly and missed."""
    d, out = pii.fit(), {}
    for line in lines:
        kind, label, text = line.split(" ", 2)
        a, b = text.index("‹"), text.index("›") - 1
        base, more = d.find([text.replace("‹", "").replace("›", "")])[0]
        found = any(x < b and a < y for _, x, y in base + more)
        n = out.setdefault(kind, [0, 0, 0])
        n[0 if found and label == "1" else 1 if found else 2] += found or label == "1"
    return out


def test_lines_written_by_hand():
    """Lines that the features and training sentences were worked on with: not an untouched measure. README has the figures."""
    got = by_hand()
    hit, wrong, missed = map(sum, zip(*got.values(), strict=True))
    assert hit / (hit + wrong) >= 0.9, got
    assert hit / (hit + missed) >= 0.8, got
    assert all(h > m for h, _, m in got.values()), got


def test_lines_written_after_the_model_was_settled():
    hit, wrong, missed = map(sum, zip(*by_hand(FRESH).values(), strict=True))
    assert hit + missed == 15 and hit >= 12 and wrong <= 1


def test_training_sentences_do_not_decide_alone():
    """The words that the features look for aren't drawn from the label: items of both labels stand without any of their kind."""
    import random

    rng, seen = random.Random(3), set()
    for _ in range(3000):
        text, (kind, a, b), label = pii._example(rng)
        seen.add((kind, label, bool(pii.CUES[kind] & set(text.lower().split()))))
    for kind in pii.KINDS + pii.EXTRA_KINDS:
        assert {(kind, 1, True), (kind, 1, False), (kind, 0, False)} <= seen


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4000, 8000):
        text = "\n".join(f"{k} Jo Doe, a{k}@b.co, 10.0.{k % 250}.1, please call (212) 555-{k % 9000 + 1000} any day" for k in range(n))
        began = time.perf_counter()
        base, more = pii.fit().find([text])[0]
        took.append(time.perf_counter() - began)
        assert len(base) == 2 * n and len(more) >= 0.9 * n
    assert took[1] < 4 * took[0]


def test_query(spark, odd, save):
    rows = pii.op1_pii(spark, save(documents=odd)).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[4].n_email == 1 and by[1].spans == by[2].spans == ""
    texts = {r.doc_id: r.text for r in odd.collect()}
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[4]))
    assert by[4].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_operator_redacts(spark, make_docs, empty):
    docs = make_docs([(1, "to a@b.co now"), (2, None)])
    got = {r.doc_id: r.redacted for r in pii.detect(docs).collect()}
    assert got == {1: "to [EMAIL] now", 2: None}
    assert pii.detect(empty).count() == 0


def test_long_runs_are_linear():
    pii.find_base("1" * 200_000 + " " + "a" * 200_000 + "@" + "1.1" * 50_000)
