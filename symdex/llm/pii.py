"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only.  Quantifiers are possessive and starts are limited to the first character of a run (or the end of
the previous match), which changes no match but keeps the work linear in the length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import CONTEXT, bind, find, named

#: Kinds in the order of the digest; the last is added by the method.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

# Length of an international account number by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: An account number of its country's length, so that a word in capitals after it isn't taken for a part of it.
IBAN = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in LENGTHS.items())

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
}
#: Score of a confirmed span in hundredths, words that raise it by ``NEAR`` when they stand shortly before, and words that lower it by ``OFF``.
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90}
NEAR, OFF = 10, 30
#: Spans of a lower score are not masked.
LEAST = 50
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
AGAINST = {"ip": "version|release|build|section", "phone": "order|invoice|serial|part", "card": "order|invoice|serial|isbn"}
MASKS = {k: f"<{k.upper()}>" for k in KINDS}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    add = lambda a, i: a + F.when((n - i) % 2 == 1, twice(d(i))).otherwise(d(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    code = lambda s, i: F.ascii(F.substring(s, i, F.lit(1)))
    value = lambda c, a: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return bind(moved, lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda a, i: value(code(s, i), a))) == 1


def confirmed(text: Column, kind: str) -> Column:
    """Spans of a kind that pass its test."""
    quick = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": text.rlike(r"\+[0-9]"),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    }[kind]
    spans = find(text, PATTERNS[kind], quick)
    if kind == "ip":
        return F.filter(spans, lambda s: F.forall(F.split(s["text"], r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$")))
    if kind == "card":
        return F.filter(spans, lambda s: bind(_digits(s["text"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(_digits(s["text"])).between(9, 15))
    if kind == "iban":
        return F.filter(spans, lambda s: mod97(F.translate(s["text"], " ", "")))
    return spans


def score(span: Column, kind: str) -> Column:
    """Hundredths, after the words before the span."""
    said = lambda words: F.lower(span["before"]).rlike(rf"(?:^|[^a-z])(?:{words})")
    out = F.lit(SCORES[kind]) + F.when(said(WORDS[kind]), F.lit(NEAR)).otherwise(F.lit(0))
    return out - F.when(said(AGAINST[kind]), F.lit(OFF)).otherwise(F.lit(0)) if kind in AGAINST else out


def found(text: Column) -> Column:
    """Per kind the confirmed spans, each with its score.  A null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_kind(k: str) -> Column:
        return F.transform(confirmed(text, k), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), score(s, k).alias("score")))

    return F.struct(*(of_kind(k).alias(k) for k in KINDS))


def findings(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start, stop, text, score) of every confirmed span; score is from 0 to 1."""
    def of_kind(k: str) -> Column:
        return F.transform(F.col("found")[k], lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), (s["score"] / 100).alias("score")))

    each = F.concat(*map(of_kind, KINDS))
    return documents.select("doc_id", found(F.col("text")).alias("found")).select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.*")


def report(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds per document, the digest of their spans, all spans as kind:start:stop, and these with their scores.

    A null or empty text has none.  Repeated rows are reported each by itself.
    """
    spans = documents.select(F.col("doc_id").cast("long").alias("doc_id"), found(F.col("text")).alias("found"))
    of = lambda kinds: F.array_join(F.concat(*(named(F.col("found")[k], k) for k in kinds)), ",")
    told = lambda k: F.transform(F.col("found")[k], lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["stop"].cast("string"), s["score"].cast("string")))
    counts = [F.size(F.col("found")[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(of(BASE), 256).alias("base_sha256"), of(KINDS).alias("spans"), F.array_join(F.concat(*map(told, KINDS)), ",").alias("scores"))


def masked(text: Column, spans: Column) -> Column:
    """text with every span of ``LEAST`` or more replaced by the mask of its kind; of overlapping spans that with the smaller start, then of the first kind.

    spans: ``found(text)``.
    """
    def of_kind(i: int) -> Column:
        return F.transform(F.filter(spans[KINDS[i]], lambda s: s["score"] >= LEAST), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))

    each = F.concat(*map(of_kind, range(len(KINDS))))
    masks = F.array(*(F.lit(MASKS[k]) for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        free = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        grown = F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(gap, masks[s["kind"]])).alias("out"))
        longer = F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))
        return F.when(free, grown).otherwise(longer)

    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))
    return F.when(F.size(each) > 0, F.aggregate(F.array_sort(each), start, step, rest)).otherwise(text)


def cleaned(documents: DataFrame) -> DataFrame:
    """documents with personal data masked in text, and n_chars (if there) brought up to date; other columns as they are."""
    name = "found"
    while name in map(str.lower, documents.columns):
        name += "_"
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(masked(F.col("text").cast("string"), F.col(name)))
    out = documents.withColumn(name, found(F.col("text"))).withColumn("text", text).drop(name)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in documents.columns else out
