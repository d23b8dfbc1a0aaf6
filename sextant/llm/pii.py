"""Personal data by weak supervision (operator 5), with built-in expressions only.

Candidates are spans of strict patterns (the base: email, ip, card, phone) and of looser ones
(written-out emails, phones without a country code, keys and secrets). Five labelers vote on
each candidate: the strict pattern, the format check, a gazetteer (top-level domains, country
codes, card issuers, key names), cue words before the span, and the span's borders. Expectation
maximisation over the table of vote patterns estimates how reliable each labeler is and the
probability of each pattern; with these as soft labels a naive Bayes classifier over span
features is trained, which decides which looser candidates become spans. Base spans stay.

Only the counts of vote and feature patterns (at most ``3**5 * features`` rows, whatever the
corpus) reach the driver; the trained weights go back as literals of one expression.

Patterns are written so that each attempt starts where a run of characters starts and never
backtracks; they match what the plain patterns match, in linear time on long texts.

Edge cases: a null text is empty and has no span (base_sha256 is that of the empty string);
without any candidate nothing is trained. Rows are judged alone, so repeated rows get equal
results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import keep, table
from sextant.llm.native import let, matches

#: The base kinds in order, then the kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?i:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?i:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])"
AT_SIGN = r"(?i:[(\[]at[)\]])"
#: What names a secret, up to its value; a value runs to its end.
NAMED = r"(?i:(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|pwd)(?:[_-]?key)?)[\x20\t]*+[=:][\x20\t]*+[\"']?"
SECRET = rf"\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}+|(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{{16,}}+)\b|{NAMED}[A-Za-z0-9_/+=-]{{16,}}+"
#: What each text with a secret holds.
SECRET_SIGN = rf"AKIA|gh[pousr]_|[sp]k_(?:live|test)_|{NAMED}"

# Gazetteers of the labelers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "example", "biz", "co", "it", "nl", "ch", "at")
ISSUERS = ("4", "5", "34", "37", "6")
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
CUES = r"(?i)(mail|contact|tel|phone|call|fax|mobil|ip|host|server|address|card|visa|iban|account|token|secret|key|password|courriel|correo|telefon|kontakt|llam)[^\n]{0,16}$"
CONTEXT = 40
ROUNDS = 50
PRIOR = 10.0
LABELERS = ("strict", "format", "gazetteer", "cue", "border")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def of(d: Column) -> Column:
        n = F.length(d)
        value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
        twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
        return F.aggregate(parts, F.lit(0), lambda a, v: a + v) % 10 == 0

    return let(digits, of)


def _octets(m: Column) -> Column:
    low = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(low(p)) <= 3) & (F.coalesce(F.when(F.length(low(p)) <= 3, low(p)).try_cast("int"), F.lit(0)) <= 255))


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _if(test: Column, spans: Column) -> Column:
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(test, spans).otherwise(none)


def base_spans(text: Column, digit: Column) -> dict[str, Column]:
    """The base spans by kind; ``digit``: whether the text holds a digit."""
    return {
        "email": _if(F.contains(text, F.lit("@")), matches(text, EMAIL)),
        "ip": _if(digit & F.contains(text, F.lit(".")), F.filter(matches(text, IP), lambda x: _octets(x["m"]))),
        "card": _if(digit, F.filter(matches(text, CARD), lambda x: _card(x["m"]))),
        "phone": _if(digit & F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))),
    }


def loose_spans(text: Column, digit: Column) -> dict[str, Column]:
    """Candidates of looser patterns, by the kind that they would have."""
    return {
        "email": _if(F.rlike(text, F.lit(AT_SIGN)), matches(text, LOOSE_EMAIL)),
        "phone": _if(digit, matches(text, LOOSE_PHONE)),
        "secret": _if(F.rlike(text, F.lit(SECRET_SIGN)), F.transform(matches(text, SECRET), _value)),
    }


def _value(x: Column) -> Column:
    """A match of SECRET without the name before the value."""
    skip = F.length(F.regexp_extract(x["m"], f"^{NAMED}", 0))
    return F.struct((x["s"] + skip).alias("s"), x["e"].alias("e"), F.substr(x["m"], skip + 1, F.length(x["m"])).alias("m"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _labelled(kind: str, strict: bool, text: Column, spans: Column) -> Column:
    """array<struct<kind, s, e, is_base, votes.., length, digits>> of the candidates of a kind."""
    at = KINDS.index(kind)

    def of(x: Column) -> Column:
        m = x["m"]
        digits = F.length(_digits(m))
        before = F.substr(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
        last, following = F.substr(text, F.greatest(x["s"], F.lit(1)), F.when(x["s"] > 0, 1).otherwise(0)), F.substr(text, x["e"] + 1, F.lit(1))
        same = F.rlike(_digits(m), F.lit(r"^([0-9])\1*$"))
        tld = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
        form = {
            "email": _vote(F.rlike(m, F.lit(r"[A-Za-z]{2,}$")) & F.rlike(m, F.lit(r"^[A-Za-z0-9]")), F.rlike(m, F.lit(r"[0-9]$"))),
            "ip": _vote(F.length(m) >= 9, F.rlike(m, F.lit(r"(^|\.)0[0-9]"))),
            "card": _vote(digits.between(15, 16), same),
            "phone": _vote(digits.between(10, 13), same),
            "secret": _vote((digits >= 2) & F.rlike(m, F.lit("[A-Za-z]")), digits < 2),
        }[kind]
        gazetteer = {
            "email": _vote(tld.isin(*TOP_LEVEL), F.length(tld) == 0),
            "ip": _vote(~F.rlike(m, F.lit(r"^0+\.")), F.rlike(m, F.lit(r"^0+\."))),
            "card": _vote(F.rlike(m, F.lit("^(" + "|".join(ISSUERS) + ")")), F.rlike(m, F.lit("^0"))),
            "phone": _vote(F.rlike(m, F.lit(r"^\+?\(?(" + "|".join(COUNTRY_CODES) + ")")), F.rlike(m, F.lit(r"^\(?[01]"))),
            "secret": _vote(F.rlike(m, F.lit("^(AKIA|gh[pousr]_|sk_|pk_)")), F.lit(False)),
        }[kind]
        border = _vote(~F.rlike(F.concat(last, following), F.lit("[A-Za-z0-9]")), F.rlike(last, F.lit("[A-Za-z0-9]")) & F.rlike(following, F.lit("[A-Za-z0-9]")))
        votes = (F.lit(1 if strict else 0), form, gazetteer, F.when(F.rlike(before, F.lit(CUES)), 1).otherwise(0), border)
        features = (F.least(F.floor(F.length(m) / 8), F.lit(5)).cast("int"), F.floor(4 * digits / F.length(m)).cast("int"))
        return F.struct(F.lit(at).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(strict).alias("is_base"), *(v.cast("int").alias(n) for n, v in zip((*LABELERS, "length", "digits"), (*votes, *features), strict=True)))

    return F.transform(spans, of)


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` with ``spans``: all candidates of each text with their votes and features."""
    text = F.col("_text")
    digit = F.rlike(text, F.lit("[0-9]"))
    base, loose = base_spans(text, digit), loose_spans(text, digit)
    each = [_labelled(k, True, text, v) for k, v in base.items()] + [_labelled(k, False, text, v) for k, v in loose.items()]
    held = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    # texts without a digit, "@", "(at)" or a sign of a secret are passed by at once
    any_sign = F.rlike(text, F.lit(rf"[0-9@]|{AT_SIGN}")) | F.rlike(text, F.lit(SECRET_SIGN))
    spans = F.concat(*each)
    return held.select(*carry, F.when(any_sign, spans).otherwise(F.array().cast(_SPANS)).alias("spans"))


_SPANS = "array<struct<kind:int,s:int,e:int,is_base:boolean," + ",".join(f"{x}:int" for x in (*LABELERS, "length", "digits")) + ">>"


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability that a candidate is personal data, for each (kind, votes) with its count.

    Labelers are independent given the truth; each has three outcomes, with rates shared by all
    kinds. A labeler's vote is first trusted at 0.8, and ``PRIOR`` votes of that kind stay with
    its counts, so that a class without candidates keeps its first meaning.
    """
    labelers = len(patterns[0][1]) if patterns else 0
    first = {(y, v): (0.8 if v == (1 if y else -1) else 0.1) for y in (0, 1) for v in (-1, 0, 1)}
    say = [dict(first) for _ in range(labelers)]
    prior: dict[int, float] = {k: 0.5 for k, _, _ in patterns}
    belief: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for k, votes, _n in patterns:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for x, v in zip(say, votes, strict=True):
                yes += math.log(x[1, v])
                no += math.log(x[0, v])
            belief[k, votes] = 1 / (1 + math.exp(min(500.0, max(-500.0, no - yes))))
        for k in prior:
            n = sum(c for kk, _, c in patterns if kk == k)
            prior[k] = (sum(c * belief[kk, v] for kk, v, c in patterns if kk == k) + 1) / (n + 2)
        for i, x in enumerate(say):
            for y in (0, 1):
                mass = {v: PRIOR * first[y, v] for v in (-1, 0, 1)}
                for k, votes, c in patterns:
                    mass[votes[i]] += c * (belief[k, votes] if y else 1 - belief[k, votes])
                total = sum(mass.values())
                for v, m in mass.items():
                    x[y, v] = m / total
    return belief


def train(spans: DataFrame) -> dict[str, dict[tuple[int, int], float]]:
    """Log odds of each feature value for each kind: the span classifier."""
    one = spans.select(F.explode("spans").alias("x")).select("x.*")
    names = (*LABELERS, "length", "digits")
    counted = one.groupBy("kind", *names).count().collect()  # a bounded table of patterns
    votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for r in counted:
        key = (r.kind, tuple(r[n] for n in LABELERS))
        votes[key] = votes.get(key, 0) + r["count"]
    belief = expectation_maximisation([(k, v, n) for (k, v), n in sorted(votes.items())])
    weights: dict[str, dict[tuple[int, int], float]] = {n: {} for n in ("", *names)}
    mass: dict[tuple[str, int, int, int], float] = {}
    total: dict[tuple[int, int], float] = {}
    for r in counted:
        p = belief[r.kind, tuple(r[n] for n in LABELERS)]
        for y, m in ((1, p * r["count"]), (0, (1 - p) * r["count"])):
            total[r.kind, y] = total.get((r.kind, y), 0.0) + m
            for n in names:
                mass[n, r.kind, r[n], y] = mass.get((n, r.kind, r[n], y), 0.0) + m
    for n, k, v, _ in list(mass):
        rate = [(mass.get((n, k, v, y), 0.0) + 1) / (total[k, y] + 6) for y in (0, 1)]
        weights[n][k, v] = round(math.log(rate[1] / rate[0]), 6)
    for k in {k for k, _ in total}:
        weights[""][k, 0] = round(math.log((total[k, 1] + 1) / (total[k, 0] + 1)), 6)
    return weights


def _score(x: Column, weights: dict[str, dict[tuple[int, int], float]]) -> Column:
    """Log odds of a candidate."""
    total = F.lit(0.0)
    for name, values in weights.items():
        if values:
            code = x["kind"] * 1000 + (x[name] if name else F.lit(0))
            known = F.create_map(*(F.lit(z) for (k, v), w in sorted(values.items()) for z in (1000 * k + v, w)))
            total = total + F.coalesce(F.try_element_at(known, code), F.lit(0.0))
    return total


def find(docs: DataFrame, carry: list[str] | None = None, least_odds: float = 0.0) -> DataFrame:
    """``carry`` with ``base`` and ``found``: arrays of (kind, s, e) by kind, then start.

    ``found`` holds the base spans and each looser candidate whose log odds reach ``least_odds``
    and that overlaps no base span; a secret only has to reach beyond the base spans in it, so that
    a run of its digits that passes for a card doesn't leave the rest.
    """
    carry = carry or ["doc_id"]
    spans = keep(candidates(docs, carry), "pii_spans")
    weights = train(spans)
    brief = lambda a: F.sort_array(F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    base = brief(F.filter("spans", lambda x: x["is_base"]))
    loose = F.filter("spans", lambda x: ~x["is_base"] & (_score(x, weights) >= least_odds))
    split = spans.select(*carry, base.alias("base"), brief(loose).alias("loose"))
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]) & ((x["kind"] != KINDS.index("secret")) | (b["s"] <= x["s"]) & (x["e"] <= b["e"]))))
    return split.select(*carry, "base", F.sort_array(F.concat("base", apart)).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; overlapping spans give one mark each, once."""

    def step(acc: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), x["kind"])), F.lit("]"))
        start = F.greatest(x["s"], acc["at"])
        piece = F.concat(F.substr(text, acc["at"] + 1, start - acc["at"]), mark)
        more = x["e"] > acc["at"]
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.when(more, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    out = F.aggregate(order, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
