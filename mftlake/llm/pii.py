"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, pick, position, read, unpacked

BASE = ("email", "ip", "card", "phone")
EXTRA = ("national", "ssn", "iban", "obfuscated", "name")
KINDS = BASE + EXTRA
LABELERS = ("rule", "gazetteer", "context", "shape")

#: Patterns by kind. Those of the base kinds find what the plain ones of the contract find, leftmost and non-overlapping, but start only where a
#: run starts or the last match ended and never give back, so that any text takes linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "obfuscated": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,10}(?![A-Za-z])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[\p{Lu}][\p{L}]{1,30}(?:\x20[\p{Lu}][\p{L}]{1,30})?",
}
#: what a text must hold for the pattern to be tried at all
GUARDS = {
    "email": "contains(t, '@')",
    "ip": "digits",
    "card": "digits",
    "phone": "contains(t, '+')",
    "national": "digits",
    "ssn": "digits",
    "iban": "digits",
    "obfuscated": "contains(t, '[at]') or contains(t, '(at)')",
    "name": r"t rlike '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\\.?\\x20'",
}
#: matches whose places are summed up in one go
PART = 256
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + if((length({_DIGITS}) - i) % 2 = 1,"
    f" int(substr('0246813579', int(substr({_DIGITS}, i, 1)) + 1, 1)), int(substr({_DIGITS}, i, 1)))) % 10 = 0"
)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: the remainder modulo 97 of an account number with its first four characters last and letters as numbers from 10 on
_MOD97 = (
    "aggregate(split(concat(substr(replace(x.m, ' ', ''), 5), left(replace(x.m, ' ', ''), 4)), ''), 0,"
    " (s, c) -> if(c between '0' and '9', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97))"
)
#: whether a match counts: the checks of the base kinds, a stricter form of the others
RULES = {
    "email": "true",
    "ip": rf"x.m rlike '^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$'",
    "card": f"if(length({_DIGITS}) between 13 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "national": r"x.m rlike '^(?:\\([0-9]{3}\\) |[0-9]{3}-)[0-9]{3}-[0-9]{4}$'",
    "ssn": "true",
    "iban": f"length(replace(x.m, ' ', '')) between 15 and 34 and {_MOD97} = 1",
    "obfuscated": r"x.m rlike '(?:dot)'",
    "name": r"x.m rlike ' .+ '",
}
#: gazetteers (fixed values): endings of mail domains, first octets of reserved addresses, card issuers, country codes, countries of IBANs, given names
TLDS = "com org net edu gov io info biz eu uk de fr es it nl ch at be pl se no fi dk pt us ca au jp cn in br ru"
RESERVED = "0 10 127 169 224 239 240 255"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-8]|6[0-9])"
COUNTRY_CODES = r"^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01])"
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK"
GIVEN = "James John Robert Michael William David Mary Anna Maria Peter Thomas Paul Hans Klaus Sophie Marie Jean Pierre Carlos Juan Jose Laura Sarah Emma"


def _among(value: str, names: str) -> str:
    return f"if({value} in ({', '.join(repr(n) for n in names.split())}), 1, -1)"


GAZETTEERS = {
    "email": _among("lower(substring_index(x.m, '.', -1))", TLDS),
    "ip": f"-({_among("substring_index(x.m, '.', 1)", RESERVED)})",
    "card": f"if(x.m rlike '{ISSUERS}', 1, -1)",
    "phone": f"if(x.m rlike '{COUNTRY_CODES}', 1, -1)",
    "national": r"if(x.m rlike '^\\(?[2-9]', 1, -1)",
    "ssn": "if(x.m rlike '^(?:000|666|9)', -1, 1)",
    "iban": _among("left(x.m, 2)", IBAN_COUNTRIES),
    "obfuscated": _among("lower(regexp_extract(x.m, '[A-Za-z]+$', 0))", TLDS),
    "name": f"if(exists(split(x.m, ' '), w -> {_among('w', GIVEN)} = 1), 1, 0)",
}
#: words shortly before a match that speak for its kind, and those that speak for something else (fixed values)
CUES = {
    "email": "mail|contact|write to|address|schreib|correo",
    "ip": r"\\bip\\b|host|server|address|login|addr",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|cell|anruf|contact",
    "national": "phone|tel|call|mobile|fax|cell|contact",
    "ssn": "ssn|social|security|insurance",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "obfuscated": "mail|contact|write",
    "name": "dear|name|contact|by|signed|patient",
}
AGAINST = r"version|\\bv$|release|section|page|isbn|issn|order|figure|table|chapter|line|build"


@dataclass(frozen=True)
class SpanModel:
    """The final classifier: a logit from the kind and the votes. ``accuracy``: what EM found each labeler to be worth."""

    bias: dict[str, float]
    weights: tuple[float, ...]
    accuracy: tuple[float, ...]


def _candidates(kind: str) -> str:
    """SQL for the candidates of a kind in the text ``t``: place, whether the rule holds, and the labelers' votes (1, 0, -1)."""
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    zipped = (
        f"zip_with(regexp_extract_all(t, '{pattern}', 0),"
        f" transform(split(t, '{pattern}', -1), g -> struct(length(g) as n, lower(right(g, 32)) as c)),"
        " (m, g) -> struct(m, g.n as n, g.c as c))"
    )
    # split has one part more than there are matches; places are summed up within parts of PART matches, which takes linear time
    step = "(s, z) -> struct(s.at + z.n + length(z.m) as at, concat(s.out, array(struct(z.m as m, z.c as c, s.at + z.n as a, s.at + z.n + length(z.m) as b))) as out)"
    parted = f"transform(sequence(0, cast((size(f) - 1) div {PART} as int)), i -> slice(f, i * {PART} + 1, {PART}))"
    begins = (
        "aggregate(transform(p, q -> aggregate(q, 0, (n, z) -> n + z.n + length(z.m))), struct(0 as at, cast(array() as array<int>) as out),"
        " (s, n) -> struct(s.at + n as at, concat(s.out, array(s.at)) as out), s -> s.out)"
    )
    placed = (
        f"flatten(transform(filter(array(filter({zipped}, z -> z.m is not null)), f -> size(f) > 0), f -> flatten(transform(array({parted}), p -> flatten(zip_with(p, {begins},"
        f" (q, at) -> aggregate(q, struct(at as at, cast(array() as array<struct<m: string, c: string, a: int, b: int>>) as out), {step}, s -> s.out)))))))"
    )
    vote = (
        f"struct('{kind}' as kind, x.a as a, x.b as b, {RULES[kind]} as holds,"
        f" {GAZETTEERS[kind]} as gazetteer,"
        f" if(x.c rlike '{AGAINST}', -1, if(x.c rlike '(?:{CUES[kind]})', 1, 0)) as context,"
        r" if(regexp_replace(x.m, '[^0-9A-Za-z]', '') rlike '^(.)\\1*$' or x.m rlike '0123456|1234567|9876543', -1, 0) as shape)"
    )
    none = "cast(array() as array<struct<kind: string, a: int, b: int, holds: boolean, gazetteer: int, context: int, shape: int>>)"
    return f"if({GUARDS[kind]}, transform({placed}, x -> {vote}), {none})"


def _voted(df: DataFrame) -> DataFrame:
    """``df`` (with ``_text``) plus ``_found``: all candidates with their votes, base kinds first."""
    text = df.withColumn("t", F.coalesce(F.col("_text").cast("string"), F.lit(""))).withColumn("digits", F.expr("t rlike '[0-9]'"))
    return text.withColumn("_found", F.expr(f"concat({', '.join(map(_candidates, KINDS))})")).drop("t", "digits")


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> SpanModel:
    """EM over (kind, votes, count): labelers' accuracies and each pattern's chance to be personal data; then the classifier.

    Every labeler votes independently given the truth, right with its own accuracy, or abstains (0). Accuracies start
    at 0.75 and each kind's prior at 0.5. The classifier is a logistic regression of those chances on kind and votes,
    fitted by weighted gradient steps. ``patterns`` has at most 9 kinds x 3**4 rows, whatever the corpus.
    """
    accuracy, prior = [0.75] * len(LABELERS), {k: 0.5 for k in KINDS}
    chance = []
    for _ in range(rounds):
        chance = []
        for kind, votes, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))
            chance.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for j in range(len(LABELERS)):
            right = sum(n * (c if v[j] > 0 else 1 - c) for (_, v, n), c in zip(patterns, chance) if v[j])
            total = sum(n for _, v, n in patterns if v[j])
            accuracy[j] = min(0.99, max(0.51, (right + 7.5) / (total + 10)))
        for k in prior:
            mass = sum(n * c for (kind, _, n), c in zip(patterns, chance) if kind == k)
            total = sum(n for kind, _, n in patterns if kind == k)
            prior[k] = min(0.98, max(0.02, (mass + 1) / (total + 2)))
    bias, weights = {k: 0.0 for k in KINDS}, [math.log(a / (1 - a)) for a in accuracy]
    size = sum(n for *_, n in patterns) or 1
    for _ in range(200):
        gb, gw = {k: 0.0 for k in KINDS}, [0.0] * len(LABELERS)
        for (kind, votes, n), c in zip(patterns, chance):
            z = bias[kind] + sum(w * v for w, v in zip(weights, votes))
            off = n / size * (c - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            gb[kind] += off
            for j, v in enumerate(votes):
                gw[j] += off * v
        bias = {k: b + gb[k] - 0.001 * b for k, b in bias.items()}
        weights = [w + g for w, g in zip(weights, gw)]
    return SpanModel(bias, tuple(weights), tuple(accuracy))


_VOTES = "array(if({x}.holds, 1, -1), {x}.gazetteer, {x}.context, {x}.shape)"


def _spans(voted: DataFrame) -> tuple[DataFrame, SpanModel]:
    """``voted`` with ``_base`` and ``_spans`` in place of ``_found``."""
    votes = voted.select(F.explode("_found").alias("x")).select("x.kind", F.expr(_VOTES.format(x="x")).alias("votes")).groupBy("kind", "votes").count()
    model = estimate([(r["kind"], tuple(r["votes"]), r["count"]) for r in votes.orderBy("kind", "votes").collect()])
    of_kind = "case x.kind " + " ".join(f"when '{k}' then {b!r}D" for k, b in model.bias.items()) + " end"
    logit = " + ".join([of_kind, *(f"{w!r}D * {v}" for w, v in zip(model.weights, ("if(x.holds, 1, -1)", "x.gazetteer", "x.context", "x.shape")))])
    base = "filter(_found, x -> x.holds and x.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    more = "filter(_found, x -> x.kind not in ({}) and {} >= 0 and not exists(_base, y -> y.a < x.b and x.a < y.b))".format(", ".join(f"'{k}'" for k in BASE), logit)
    thin = "transform({}, x -> struct(x.kind as kind, x.a as a, x.b as b))"
    return voted.withColumn("_base", F.expr(thin.format(base))).withColumn("_spans", F.expr(f"concat(_base, {thin.format(more)})")).drop("_found"), model


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_base``, ``_spans`` of every row of ``df``: arrays of (kind, a, b), code points, end exclusive.

    ``_base``: the four fixed kinds, matches that fail their check dropped. ``_spans``: those, and the candidates of other kinds
    that overlap none of them and that the classifier takes for personal data. Votes are counted over all texts.
    Null texts count as empty. Repeated rows get equal answers; an empty table gives no rows; other columns are not read.
    """
    voted = _voted(pick(df, _id=id_col, _text=text_col)).drop("_text")
    return _spans(cut(voted))[0]


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in angle brackets; a null text stays null."""
    names = df.columns
    rows = _spans(_voted(packed(df, _id=id_col, _text=text_col)))[0]
    hidden = F.expr(
        "aggregate(sort_array(transform(_spans, x -> struct(x.a as a, x.b as b, x.kind as kind))), struct(0 as at, '' as out),"
        " (s, x) -> if(x.a < s.at, s, struct(x.b as at, concat(s.out, substring(_text, s.at + 1, x.a - s.at), '<', x.kind, '>') as out)),"
        " s -> concat(s.out, substring(_text, s.at + 1)))"
    )
    return unpacked(rows.withColumn("_row", F.col("_row").withField(f"_c{position(df, text_col)}", hidden)), names)


def joined(spans: str) -> Column:
    """kind:a:b by kind as listed, then place, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(sort_array(transform({spans}, x -> struct(array_position(array({kinds}), x.kind) as k, x.a as a, x.b as b, x.kind as kind))),"
        " x -> concat_ws(':', x.kind, cast(x.a as string), cast(x.b as string))), ',')"
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"),
        *(F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_spans").alias("spans"),
    )
