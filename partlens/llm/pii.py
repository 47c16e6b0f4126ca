"""Personal data by aggregating weak supervision.

Candidate spans come from strict patterns (the base) and looser ones. Labelers vote on each candidate, for,
against or not at all: the pattern's own check, a gazetteer of prefixes and endings, cue words in the
context before it, and the characters at its edges. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is personal data; these
likelihoods are the soft labels on which a logistic span classifier over shape and votes is trained.
Base spans always stay; a looser candidate is added where the classifier accepts it.

Texts are only touched by built-in functions. What reaches the driver is a table of counts by vote and
shape, whose size is bounded by the number of patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, text_of
from .spans import digest, listed, matches

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds without a base pattern: names beside titles, street addresses, account and national numbers.
KINDS = (*BASE_KINDS, "name", "address", "id")

# Each base pattern finds what the plain one finds: classes that cannot give characters back are
# possessive, and a match cannot start inside a run that would have matched from its start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# looser ones
_LABEL = r"[A-Za-z0-9-]++"
EMAIL_SPELT = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?(?:\(at\)|\[at\])\x20?" + _LABEL + r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?" + _LABEL + r")++"
    r"|\x20(?:at|AT)\x20" + _LABEL + r"(?:\x20(?:dot|DOT)\x20" + _LABEL + r")++)"
)
IPV6 = r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"
CARD_LOOSE = r"(?<![0-9A-Za-z.+-])(?:[0-9]{4}[\x20.-]){2,3}[0-9]{3,7}(?![0-9A-Za-z-])|(?<![0-9A-Za-z.+-])[0-9]{13,19}+(?![0-9A-Za-z-])|(?<![0-9A-Za-z.+-])3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z-])"
PHONE_LOCAL = (
    r"(?<![0-9+.A-Za-z-])(?:(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-][0-9]{3,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20-]?[0-9]{2,4}){3,4})(?![0-9.A-Za-z-])"
)
TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Dear", "Sincerely,", "Regards,", "named")
STREETS = (
    " St", " Ave", " Road", " Rd", " Lane", " Ln", " Dr", " Boulevard", " Blvd", " Court", " Way", "straße ", "strasse ", "gasse ", "weg ", "allee ", "platz ",
    "rue ", "avenue ", "boulevard ", "calle ", "avenida ", "plaza ",
)
_CAPITAL = r"\p{Lu}[\p{Ll}'-]++"
NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Dear|Sincerely,|Regards,|named)\.?[\x20\n]" + _CAPITAL + r"(?:\x20(?:(?:de|von|van|la)\x20)?" + _CAPITAL + r"){0,2}"
ADDRESS = (
    r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?\x20(?:" + _CAPITAL + r"\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way)\b\.?"
    r"|(?<![\p{L}])\p{Lu}\p{Ll}{1,30}(?:straße|strasse|gasse|weg|allee|platz)\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])"
    r"|(?<![\p{L}0-9])(?:[0-9]{1,4},?\x20)?(?:rue|avenue|boulevard|calle|avenida|plaza)\x20(?:(?:de|du|des|la|del|los)\x20){0,2}" + _CAPITAL + r"(?:,?\x20[0-9]{1,4})?"
)
ID = r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])"

# Gazetteers and cue words of the labelers.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "at", "ch", "eu", "us", "ca", "au")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "55", "61", "81", "86", "91")
COUNTRIES = ("DE", "FR", "ES", "IT", "NL", "AT", "CH", "GB", "IE", "BE", "PT", "PL", "SE", "NO", "DK", "FI")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)"
GIVEN = (
    "james", "john", "robert", "michael", "william", "david", "mary", "patricia", "jennifer", "linda", "elizabeth", "susan", "sarah", "anna", "emma",
    "hans", "peter", "klaus", "wolfgang", "ursula", "monika", "petra", "jean", "pierre", "marie", "michel", "françoise", "luc", "jose", "josé", "maria", "maría",
    "carmen", "juan", "antonio", "ana", "luis", "carlos", "paul", "thomas", "julia", "laura", "martin", "daniel", "alice", "grace",
)
NOT_NAMES = r"\x20(?:President|Minister|Sir|Madam|All|Team|Customer|Reader|Friends?|The|This|After|In|Is|Was|And|For|To)\b"
CUES = {
    "email": r"mail|contact|correo|kontakt|write to",
    "ip": r"\bip\b|server|host|address|login|adresse|servidor",
    "card": r"card|visa|credit|carte|karte|tarjeta|payment",
    "phone": r"phone|\btel|call|fax|mobile|handy|tél|teléfono|anruf",
    "name": r"\bname|contact|signed|patient|dear|regards|sincerely|by\x20$|from\x20$|with\x20$|mit\x20$|avec\x20$",
    "address": r"address|\blives?\b|\bat\x20$|\bin\x20(?:der\x20)?$|ship|deliver|located|resid|adresse|wohn|habite|vive|dirección",
    "id": r"iban|account|konto|cuenta|compte|\bssn\b|social|passport|\bid\b|tax",
}
AGAINST = r"version|isbn|issn|\bdoi\b|order|invoice|page|\bv\.?$|[$€£#]\s*$"
CONTEXT = 32

LABELERS = ("check", "gazetteer", "context", "edges")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one)
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def account_rest(m: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters last and letters as two digits; 1 if it is right."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))


def _base_ok(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _octets_ok(m),
        "card": lambda: F.when(n.between(16, 19), luhn(_digits(m))).otherwise(F.lit(False)),
        "phone": lambda: n.between(8, 15),
    }[kind]()


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


SHAPES = 6


def _side(x: Column, end: str) -> Column:
    """What stands beside a match: nothing 0, white space 1, a letter or digit 2, else 3."""
    at = (lambda c: c + "$") if end == "$" else (lambda c: "^" + c)
    return F.when(x == "", 0).when(x.rlike(at(r"\s")), 1).when(x.rlike(at(r"[\p{L}0-9]")), 2).otherwise(3)


def _candidates(text: Column, kind: str, found: Column, base: bool) -> Column:
    """Struct of place, votes and shape of each match; base matches that fail their check are dropped."""

    def describe(m: Column) -> Column:
        hit, digits = m["text"], _digits(m["text"])
        before = F.lower(F.substring(text, F.greatest(F.lit(1), m["start"] - CONTEXT + 1), F.least(m["start"], F.lit(CONTEXT))))
        after = F.substring(text, m["end"] + 1, F.lit(1))
        gazetteer = {
            "email": lambda: _vote(F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS), F.lower(hit).rlike(r"\.[0-9-]+$")),
            "ip": lambda: _vote(hit.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-2][0-9])\.|:"), hit.rlike(r"^0+\.|^255\.")),
            "card": lambda: _vote(digits.rlike(ISSUERS), digits.rlike(r"^(?:0|1|7|8|9)")),
            "phone": lambda: _vote(F.substring(digits, 1, 2).isin(*CALLING) | F.substring(digits, 1, 1).isin("0", "1", "7"), digits.rlike(r"^(?:00|99)")),
            "name": lambda: _vote(F.lower(F.regexp_extract(hit, r"[.\x20\n](" + _CAPITAL + ")", 1)).isin(*GIVEN), hit.rlike(NOT_NAMES)),
            "address": lambda: _vote(hit.rlike(r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|straße|strasse|rue|calle)"), hit.rlike(NOT_NAMES)),
            "id": lambda: _vote(F.substring(hit, 1, 2).isin(*COUNTRIES) | hit.rlike(r"^[0-8][0-9]{2}-"), hit.rlike(r"^(?:000|666|9[0-9]{2})-")),
        }[kind]()
        n = F.length(digits)
        check = {
            "email": lambda: _vote(hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@|\x20?[(\[]at)"), hit.rlike(r"\.\.")),
            "ip": lambda: _vote(_octets_ok(hit) | hit.contains(":"), F.lit(True)),
            "card": lambda: _vote(n.between(12, 19) & luhn(digits), F.lit(True)),
            "phone": lambda: _vote(n.between(8, 15), F.lit(True)),
            "name": lambda: _vote(hit.rlike(r"^[^\x20\n]+[\x20\n]" + _CAPITAL + r"\x20"), F.lit(False)),
            "address": lambda: _vote(n.between(1, 5), F.lit(True)),
            "id": lambda: _vote(F.when(hit.rlike("^[A-Z]"), account_rest(hit) == 1).otherwise(~hit.rlike(r"-00-|-0000$")), F.lit(True)),
        }[kind]()
        context = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
        edges = _vote(before.rlike(r"(?:^|[\s(\[<,;:'\"])$") & after.rlike(r"^(?:$|[\s)\]>,;:.!?'\"])"), before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("nth"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.array(check, gazetteer, context, edges).alias("votes"),
            F.array(F.least(F.floor(F.length(hit) / 8), F.lit(3)), F.floor(F.try_divide(n * 3, F.length(hit))), F.least(F.regexp_count(hit, F.lit(r"[^A-Za-z0-9]+")), F.lit(4)),
                    F.least(F.regexp_count(hit, F.lit(r"\p{Lu}")), F.lit(3)), _side(before, r"$"), _side(after, "^")).cast("array<int>").alias("shape"),
        )

    kept = F.filter(found, lambda m: _base_ok(kind, m["text"])) if base else found
    return F.transform(kept, describe)


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the parts stands in the text: what a pattern needs to match at all, found without it."""
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(text, F.lit(x))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates of each row's whole text; loose ones that overlap a base span are left out."""
    text = F.col("text")
    rows = plain(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    has_digits = text.rlike("[0-9]{3}")
    strict = F.concat(
        _candidates(text, "email", matches(text, EMAIL, F.contains(text, F.lit("@"))), True),
        _candidates(text, "ip", matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), True),
        _candidates(text, "card", matches(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9]")), True),
        _candidates(text, "phone", matches(text, PHONE, F.contains(text, F.lit("+"))), True),
    )
    loose = F.concat(
        _candidates(text, "email", matches(text, EMAIL_SPELT, text.rlike(r"[(\[]at[)\]]|\x20(?:at|AT)\x20[A-Za-z0-9-]+\x20(?:dot|DOT)\x20")), False),
        _candidates(text, "ip", matches(text, IPV6, text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")), False),
        _candidates(text, "card", matches(text, CARD_LOOSE, text.rlike("[0-9]{4}[\\x20.-]?[0-9]{4}|3[47][0-9]{2}[\\x20-][0-9]{6}")), False),
        _candidates(text, "phone", matches(text, PHONE_LOCAL, has_digits), False),
        _candidates(text, "name", matches(text, NAME, _has_any(text, TITLES)), False),
        _candidates(text, "address", matches(text, ADDRESS, _has_any(text, STREETS)), False),
        _candidates(text, "id", matches(text, ID, has_digits), False),
    )
    out = rows.select("doc_id", strict.alias("strict"), loose.alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("strict", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    # of loose candidates that overlap, the first in the order of kinds stays
    apart = F.aggregate(free, F.filter(free, lambda c: F.lit(False)), lambda s, c: F.when(F.exists(s, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"])), s).otherwise(F.concat(s, F.array(c))))
    return out.select("doc_id", F.concat("strict", apart).alias("spans"))


@dataclass(frozen=True)
class Pattern:
    """Candidates of one kind that got the same votes and have the same shape."""

    kind: str
    votes: tuple[int, ...]
    shape: tuple[int, ...]
    n: int


def reliabilities(patterns: list[Pattern], turns: int = 60) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Prior, (share right on personal data, share right on the rest) of each labeler, and the likelihood of
    each vote pattern, by expectation-maximisation. A vote of 0 says nothing."""
    count: dict[tuple[int, ...], int] = {}
    for p in patterns:
        count[p.votes] = count.get(p.votes, 0) + p.n
    prior, right = 0.5, [(0.8, 0.8)] * len(LABELERS)
    likely: dict[tuple[int, ...], float] = {}
    for _ in range(turns):
        for votes in count:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (sure, safe) in zip(votes, right, strict=True):
                if v:
                    yes += math.log(sure if v > 0 else 1 - sure)
                    no += math.log(1 - safe if v > 0 else safe)
            likely[votes] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(count.values())
        prior = min(0.99, max(0.01, (sum(n * likely[v] for v, n in count.items()) + 1) / (total + 2)))
        # counts of 4 and 1 keep a labeler that never votes where it started
        right = [
            (
                (4 + sum(n * likely[v] for v, n in count.items() if v[j] > 0)) / (5 + sum(n * likely[v] for v, n in count.items() if v[j])),
                (4 + sum(n * (1 - likely[v]) for v, n in count.items() if v[j] < 0)) / (5 + sum(n * (1 - likely[v]) for v, n in count.items() if v[j])),
            )
            for j in range(len(LABELERS))
        ]
    return prior, right, likely


def _features(p: Pattern) -> list[str]:
    return [f"kind:{p.kind}", *(f"vote{j}:{v}" for j, v in enumerate(p.votes)), *(f"shape{j}:{p.kind}:{v}" for j, v in enumerate(p.shape))]


def train(patterns: list[Pattern], likely: dict[tuple[int, ...], float], turns: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier over votes and shape, from soft labels; by gradient steps scaled to each
    feature's share."""
    total = max(1, sum(p.n for p in patterns))
    weight = {"": 0.0} | {f: 0.0 for p in patterns for f in _features(p)}
    share = {f: sum(p.n for p in patterns if f == "" or f in _features(p)) / total for f in weight}
    rows = [(["", *_features(p)], p.n / total, likely[p.votes]) for p in patterns]
    for _ in range(turns):
        step = dict.fromkeys(weight, 0.0)
        for names, n, y in rows:
            z = sum(weight[f] for f in names)
            g = n * (1 / (1 + math.exp(-max(-30, min(30, z)))) - y)
            for f in names:
                step[f] += g
        for f in weight:
            weight[f] -= rate * (step[f] / (share[f] + 1e-3) + decay * weight[f])
    return weight


def classifier(weight: dict[str, float], span: Column) -> Column:
    """Likelihood that a candidate is personal data."""

    def part(prefix: str, value: Column) -> Column:
        known = [(f, w) for f, w in weight.items() if f.startswith(prefix)]
        if not known:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(x) for f, w in known for x in (f[len(prefix) :], float(w))])
        return F.coalesce(F.try_element_at(table, value), F.lit(0.0))

    z = F.lit(float(weight.get("", 0.0))) + part("kind:", span["kind"])
    for j in range(len(LABELERS)):
        z = z + part(f"vote{j}:", F.get(span["votes"], F.lit(j)).cast("string"))
    for j in range(SHAPES):
        z = z + part(f"shape{j}:", F.concat_ws(":", span["kind"], F.get(span["shape"], F.lit(j)).cast("string")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def find_pii(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """doc_id and spans (nth kind, start, end, kind, base, votes, shape) of every row, by kind, then start.

    Null text counts as empty and has no spans. Repeated rows are searched each; other columns are not
    looked at; an empty table gives none. Spans of different kinds may overlap where both are base.
    """
    found = materialize(candidates(docs), "pii")
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count().collect()
    patterns = [Pattern(r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in counts]
    if not patterns:
        return found
    _, _, likely = reliabilities(patterns)
    weight = train(patterns, likely)
    kept = F.filter("spans", lambda s: s["base"] | (classifier(weight, s) >= accept))
    return found.select("doc_id", F.sort_array(kept).alias("spans"))


def op3_pii(docs: DataFrame) -> DataFrame:
    out = find_pii(docs).withColumn("strict", F.filter("spans", lambda s: s["base"]))

    def n(kind: str) -> Column:
        return F.size(F.filter("strict", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[n(k) for k in BASE_KINDS], digest(listed(F.col("strict"))).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
