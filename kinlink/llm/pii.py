"""Personal data: candidate generators, boosted trees on format and context, calibrated thresholds.

Generators of high recall propose overlapping spans; a boosted-tree model scores each by its format and
its context; a threshold for each kind, picked on held-out rows for its precision, selects what is
redacted. Spans that satisfy the strict rules of find_base() are always kept; the model adds others that
overlap none of them.

The training lines are sentences of SENTENCES with generated items. Their wording is independent of the
word lists that the features look for, and many sentences go with both labels, where only the item's
format tells. What the model is worth is measured in the tests on lines that were written by hand.

Edge cases: a null text has no spans, as an empty one; repeated rows give repeated results; texts of
any length are read whole, in time linear in their length but for a logarithm in the number of their spans.
Other columns aren't read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.boosting import BoostedTrees
from kinlink.llm.common import Spans, map_rows, schema

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the model finds come after the strict ones.
EXTRA_KINDS = ("ssn", "iban")
ORDER = {k: n for n, k in enumerate(KINDS + EXTRA_KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From each @ to the left: linear where the plain pattern starts again at every character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    """A chain of numbers and dots is taken four numbers at a time."""
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        if len(parts) < 4:
            continue
        start = chain.start()
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", start, start + size
            start += size + 1


def find_base(text: str) -> list[Span]:
    """Spans of the strict rules, leftmost and non-overlapping in each kind, by kind and start."""
    out = list(_emails(text))
    out += _ips(text)
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Generators of candidates (fixed values): kind, first characters that must occur, pattern.
GENERATORS = (
    ("email", "@", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}[ ]?@[ ]?[\w-]{1,63}(?:[ ]?\.[ ]?[A-Za-z]{2,24}){1,4}")),
    ("email", "atAT", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}[ ]?[(\[{<][ ]?(?:at|AT|At)[ ]?[)\]}>][ ]?[\w-]{1,63}(?:[ ]?(?:\.|[(\[{<][ ]?(?:dot|DOT|Dot)[ ]?[)\]}>])[ ]?[A-Za-z]{2,24}){1,4}")),
    ("ip", ":", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", ".", re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w.])")),
    ("ssn", "-", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", "", re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{1,7}(?!\w)")),
    ("phone", "", re.compile(r"(?<![\w.+-])(?:00[1-9][0-9 ().-]{6,18}[0-9]|\([0-9]{2,5}\)[ ]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?!\w)")),
)
_ANY_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Words whose presence near a candidate speaks for its kind (fixed values).
CUES = {
    "email": frozenset("mail email mails e contact write reach address correo courriel adresse schreiben schreib escribe écrire send inbox".split()),
    "ip": frozenset("ip ipv6 host server login client gateway router address from connection node ping peer".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte tarjeta carte paid charge charged expires cvv".split()),
    "phone": frozenset("phone call calls called calling tel telephone mobile cell fax whatsapp sms text telefon telefonisch anruf rufen handy llame llama teléfono móvil téléphone appelez dial ring hotline voicemail reach".split()),
    "ssn": frozenset("ssn social security taxpayer insurance payroll benefits sozialversicherung".split()),
    "iban": frozenset("iban bank account transfer konto überweisung compte virement cuenta transferencia wire deposit".split()),
}
#: Words that speak against all kinds (fixed values).
AGAINST = frozenset("version release isbn issn doi order orders invoice serial model part parts build section chapter page pages ratio score scores table id ref reference sku ticket case lot batch tracking catalogue catalog article item rev revision patent bestellung bestellnummer rechnung rechnungsnummer pedido factura commande numéro artikel".split())


#: Ends of domain names that are taken for such (fixed values); others speak against an address.
DOMAINS = frozenset("com org net edu gov info io co de es fr uk it nl at ch be pt pl se no dk fi eu us ca mx ar br ru jp cn in au nz".split())


def propose(text: str) -> list[Span]:
    """Every generator's spans; they may overlap."""
    digits = bool(_ANY_DIGIT.search(text))
    out = []
    for kind, needs, pattern in GENERATORS:
        if needs == "atAT":
            if not any(c + w in text for c in "([{<" for w in ("at", "AT", "At", " at", " AT", " At")):
                continue
        elif kind == "email" or kind == "ip" and needs == ":":
            if needs not in text:
                continue
        elif not digits:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def features(text: str, span: Span, window: int = 48) -> list[float]:
    """Format and context of a candidate, of a fixed width."""
    kind, a, b = span
    body = text[a:b]
    before, after = text[max(0, a - window) : a], text[b : b + window]
    digits = _NOT_DIGIT.sub("", body)
    letters = sum(c.isalpha() for c in body)
    near = {w.lower() for w in _WORD.findall(before)[-6:] + _WORD.findall(after)[:3]}
    last = [w.lower() for w in _WORD.findall(before)[-2:]]
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    parts = body.split(".")
    flat = re.sub(r"[^A-Za-z0-9]", "", body)
    return [
        float(ORDER[kind]),
        len(body),
        len(digits),
        letters,
        len(body) - len(digits) - letters,
        len(set(digits)) / max(1, len(digits)),
        float(bool(digits) and luhn(digits)),
        float(len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)),
        float(kind == "iban" and flat.isascii() and _mod97(flat.upper())),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(bool(near & CUES[kind])),
        float(bool(set(last) & CUES[kind])),
        float(bool(near & AGAINST)),
        float(bool(set(last) & AGAINST)),
        sum(c.isdigit() for c in before + after) / max(1, len(before) + len(after)),
        float(" at" in body.lower() or "(at" in body.lower() or "[at" in body.lower()),
        len(groups),
        max(groups, default=0),
        float(before[-1:] in ("#", "$", "=", "/")),
        float(after[:1] in ("%", "/", "=", "#")),
        float(body.count(" ")),
        float(_WORD.findall(body)[-1].lower() in DOMAINS if kind == "email" else 0),
        float(body.count(":")),
    ]


_FILL = "the of and to in is that for with was on are by this from be it as an at le la de und der que los".split()

#: Training sentences by kind: for personal items, for others, and for both (fixed values). {} is the item.
SENTENCES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "email": (
        ("please write to {} before Friday", "you can reach our editor under {}", "questions go to {} at any time", "Contact: {}", "schreiben Sie uns an {} bitte", "escribe a {} para saber más", "send the signed form to {} today", "{} wrote on Monday"),
        ("we had lunch {} and left early", "the talk {} was long", "they scored 3 {} in the end", "see the notes {} of the meeting"),
        ("{}", "it says {} here", "then {} and so on", "and {} too"),
    ),
    "ip": (
        ("the server at {} did not answer", "blocked login from {} again", "ping {} before you restart", "der Host {} ist weg", "peer {} closed the connection", "your address is {} now"),
        ("the race ended in {} for him", "the film runs from {} on", "at {} the clock stopped", "firmware release {} is out", "the ratio was {} in this mix", "chapter {} tells more"),
        ("{}", "it shows {} here", "value {} was seen", "then {} and so on"),
    ),
    "card": (
        ("she paid with {} at the desk", "my Visa {} was charged twice", "the card number is {} and it expires soon", "bitte die Karte {} belasten", "tarjeta {} caducada", "charge {} for the room"),
        ("your order {} has shipped", "serial {} is on the back", "tracking {} says delivered", "part {} fits this model", "invoice {} is still open", "the batch {} was recalled"),
        ("{}", "it reads {} here", "see {} for more", "then {} and so on", "the number {} was on it"),
    ),
    "phone": (
        ("call me at {} tonight", "his phone is {} I think", "rufen Sie an unter {} bis acht", "teléfono {} de la oficina", "text {} when you land", "fax {} or write", "you can ring us on {} all day", "my mobile: {}", "dial {} and ask for Ann", "leave a message on {} please", "the hotline {} is busy"),
        ("order {} has shipped", "part no {} is sold out", "invoice {} is open", "the serial {} is worn off", "ticket {} was closed", "Bestellung {} ist da", "item {} of the list", "tracking {} says delivered", "see patent {} for this", "model {} is newer", "lot {} was recalled", "pedido {} enviado", "reference {} in the file", "scores of {} in the league"),
        ("{}", "it reads {} here", "then {} and so on", "and {} too", "the number {} was on it"),
    ),
    "ssn": (
        ("her social security number is {} as filed", "SSN {} on the payroll form", "taxpayer {} filed late", "the benefits office has {} for him", "social: {}"),
        ("part {} is sold out", "order {} has shipped", "catalogue {} lists it", "lot {} was recalled", "invoice {} is open", "the serial {} is worn off", "case {} was closed", "see patent {} for this"),
        (),
    ),
    "iban": (
        ("please transfer the rent to {} by May", "IBAN {} of the landlord", "Überweisung auf {} bis Freitag", "our bank account is {} as before", "cuenta {} del club", "wire it to {} today"),
        ("order {} has shipped", "serial {} is on the back", "the model {} is newer", "ticket {} was closed", "batch {} was recalled"),
        ("{}", "it reads {} here", "see {} for more", "the code {} was on it"),
    ),
}


def _item(rng: random.Random, kind: str, good: bool) -> str:
    """An item that one of the generators proposes; good ones satisfy the kind's own checks."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice(("an", "er", "on", "ka", "mi", "lo", "re", "ti")) for _ in range(rng.randint(2, 4)))

    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", ".")))
        return name() + at + name() + dot + rng.choice(("com", "org", "net", "de", "es", "fr", "edu") if good else ("meeting", "handles", "seminar", "noon", "today"))
    if kind == "ip":
        if rng.random() < 0.5:
            return ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if good else ":".join(digits(2) for _ in range(rng.randint(4, 5)))
        return ".".join(str(rng.randrange(256)) for _ in range(4)) if good else ".".join(str(n) for n in rng.sample([rng.randint(0, 20), rng.randint(0, 99), rng.randint(256, 9999), rng.randint(0, 400)], 4))
    if kind == "card":
        while True:
            d = rng.choice("3456") + digits(15)
            if luhn(d) == good:
                return rng.choice((". ", ".", "/", "  ", "- ", "_")).join(d[n : n + 4] for n in range(0, 16, 4))
    if kind == "phone":
        if not good:
            return rng.choice((f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"00{rng.randint(1, 9)}{digits(rng.randint(7, 15))}"))
        return rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{rng.randint(1, 9)}{digits(rng.randint(7, 12))}", f"0049 {digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"(0{digits(2)}) {digits(3)} {digits(2)} {digits(2)}"))
    if kind == "ssn":
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else f"{rng.choice(('000', '666', '9' + digits(2)))}-{digits(2)}-{digits(4)}"
    country, body = rng.choice(("DE", "FR", "ES", "GB", "NL", "AT")), digits(18)
    check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
    iban = f"{country}{(check if good else (check + rng.randint(1, 90)) % 97):02d}{body}"
    return iban if rng.random() < 0.5 else " ".join(iban[n : n + 4] for n in range(0, len(iban), 4))


def _example(rng: random.Random) -> tuple[str, Span, int]:
    """A training line, the span in it and its label.

    An address is personal by its form, a telephone number by its sentence (and where that is for both, if it
    has brackets). Numbers of cards, insurances and
    accounts have to satisfy their checks and to stand in a sentence for personal items or for both; those
    that satisfy them also stand in the other sentences, and those that don't in all.
    """
    kind, good = rng.choice(KINDS + EXTRA_KINDS), rng.random() < 0.7
    role = rng.choice([n for n in range(3) if SENTENCES[kind][n] and not (n == 1 and good and kind in ("email", "ip"))])
    head, _, tail = rng.choice(SENTENCES[kind][role]).partition("{}")
    word = lambda: str(rng.randrange(10 ** rng.randint(1, 5))) if rng.random() < numbers else rng.choice(_FILL)
    fill = lambda most: " ".join(word() for _ in range(rng.randint(0, most)))
    numbers = rng.choice((0, 0, 0.2, 0.6))  # how many of the words around are numbers
    head = f"{fill(8)}{rng.choice(('. ', ', ', ' ', '; '))}{head}"
    if rng.random() < 0.3:
        head = head.rstrip() + rng.choice((" no. ", ": ", " = ", " # ", " number "))
    item = _item(rng, kind, good)
    personal = role == 0 or role == 2 and "(" in item if kind == "phone" else good and role != 1
    return f"{head}{item}{tail} {fill(6)}", (kind, len(head), len(head) + len(item)), int(personal)


@dataclass(frozen=True)
class Detector:
    """A fitted model and a threshold for each kind."""

    trees: BoostedTrees
    thresholds: dict[str, float]
    window: int

    def find(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """For each text its strict spans and those that the model adds."""
        base, pool, rows, taken = [], [], [], []
        for n, text in enumerate(texts):
            base.append(find_base(text) if text else [])
            taken.append(Spans((s, e) for _, s, e in base[n]))
            if text:
                for span in propose(text):
                    if not taken[n].overlap(span[1], span[2]):
                        pool.append((n, span))
                        rows.append(features(text, span, self.window))
        added: list[list[Span]] = [[] for _ in texts]
        if pool:
            p = self.trees.probability(np.array(rows))
            for k in np.lexsort((np.arange(len(p)), -p)):
                n, span = pool[k]
                if p[k] >= self.thresholds[span[0]] and not taken[n].overlap(span[1], span[2]):
                    added[n].append(span)
                    taken[n].add(span[1], span[2])
        return list(zip(base, added, strict=True))


@lru_cache(maxsize=4)
def fit(examples: int = 6000, precision: float = 0.98, window: int = 48, seed: int = 7) -> Detector:
    """Trees on two thirds of the generated lines, calibration and thresholds on the others."""
    rng, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(examples):
        text, planted, label = _example(rng)
        for span in propose(text):
            same = span[0] == planted[0] and span[1] < planted[2] and planted[1] < span[2]
            x.append(features(text, span, window))
            y.append(label if same else 0)
            kinds.append(span[0])
    x, y, kinds = np.array(x), np.array(y, float), np.array(kinds)
    held = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, thresholds = trees.probability(x[held]), {}
    for kind in ORDER:
        own = kinds[held] == kind
        order = np.argsort(-p[own])
        good = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        enough = np.nonzero(good >= precision)[0]
        thresholds[kind] = max(0.5, float(p[own][order][enough[-1]])) if len(enough) else 1.01
    return Detector(trees, thresholds, window)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """text with each span as its kind in brackets; what overlaps becomes one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


RESULT = schema(
    doc_id=T.LongType(),
    base=T.ArrayType(T.StringType()),
    added=T.ArrayType(T.StringType()),
    redacted=T.StringType(),
)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True, **fitted) -> DataFrame:
    """doc_id, base and added spans (kind:start:end) and the redacted text of each row of docs."""
    detector = fit(**fitted)

    def rows(batches):
        for b in batches:
            found = detector.find(b["text"])
            yield {
                "doc_id": b["doc_id"],
                "base": [[f"{k}:{s}:{e}" for k, s, e in base] for base, _ in found],
                "added": [[f"{k}:{s}:{e}" for k, s, e in sorted(more, key=lambda x: (ORDER[x[0]], x[1]))] for _, more in found],
                "redacted": [redact(t, base + more) if redacted and t is not None else None for t, (base, more) in zip(b["text"], found, strict=True)],
            }

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, RESULT)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Digests of all spans of documents, by detect()."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), redacted=False)
    kind = lambda k: F.size(F.filter("base", lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.split_part(s, F.lit(":"), F.lit(1)))
    key = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(rank(s).alias("k"), F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("a"), F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("b"), s.alias("s")),
    )
    return found.select(
        "doc_id",
        *[kind(k) for k in KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(key), lambda x: x["s"]), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
