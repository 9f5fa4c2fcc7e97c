"""Personal data: patterns propose spans, checksums confirm them, near words adjust the score.

Every kind has a pattern, a cheap condition on the whole text that spares most
texts the pattern, a check of the match, a score, and words that raise the score
when one begins shortly before or after the match. What a checksum or a form that nothing else has
confirms scores above LEAST_SCORE alone; the others start below it, so near words decide.
`find_pii` returns the spans that reach LEAST_SCORE, and those of the base list with
any score unless told otherwise; every span has its score. All of it is Spark SQL functions.

The patterns are the plain ones made linear: a look-behind forbids starts inside
a run that has been tried from its beginning, and possessive quantifiers forbid
giving back what nothing later could use. International account numbers have the
length of their country, and every country code with two digits is tried as a
beginning, also within what another one would take in; codes without a length
are no account numbers.

Defined results: null counts as empty text and has no spans; repeated rows are
searched each; a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.inputs import table
from pingtrace.llm.spans import joined, matches, none

LEAST_SCORE = 0.5
NEAR_WORDS = 0.35


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit of payment cards."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.length(digits) - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            2 * F.substring(digits, i, F.lit(1)).cast("int")
            - F.when(F.substring(digits, i, F.lit(1)) >= "5", 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an international account number leaves 1 when divided by 97 in its rearranged digits."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def digit(i: Column) -> Column:
        return F.substring(turned, i, F.lit(1))

    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: F.when(digit(i).between("0", "9"), (acc * 10 + digit(i).cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(digit(i)) - 55) % 97
        ),
    )
    return rest == 1


def _small_part(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    worth: Callable[[Column], Column]
    check: Callable[[Column], Column]
    score: float
    near: str
    base: bool = True
    group: int = 0


#: Characters of an account number by country: the registry, territories of its members, and countries in partial use.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "AX DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE GG IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BF BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(
    rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}+" for size, codes in IBAN_LENGTHS.items()
)
_WORD = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind(
        "email",
        rf"(?:(?<!{_WORD})|\G){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        0.9,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        lambda m: F.forall(F.split(m, "[.]"), _small_part),
        0.3,
        "ip|host|server|address|client",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
        lambda m: luhn(_digits(m)),
        0.7,
        "card|visa|credit|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda m: F.length(_digits(m)).between(9, 15),
        0.4,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
        lambda m: mod_97(F.replace(m, F.lit(" "), F.lit(""))),
        0.8,
        "iban|account|bank",
        base=False,
        group=1,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$"),
        0.3,
        "ssn|social|security",
        base=False,
    ),
)


def _near(kind: Kind, match: Column) -> Column:
    """Whether a word of the kind begins near the match."""
    word = rf"(?<![a-z])(?:{kind.near})"
    return F.lower(match["before"]).rlike(word) | F.lower(match["after"]).rlike(word)


def _scored(kind: Kind, rank: int, text: Column, whole_base: bool) -> Column:
    found = F.filter(matches(text, kind.pattern, kind.group), lambda m: kind.check(m["text"]))
    spans = F.transform(
        F.when(kind.worth(text), found).otherwise(none()),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            m["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(
                F.lit(1.0),
                F.lit(kind.score) + F.when(_near(kind, m), NEAR_WORDS).otherwise(0.0),
            ).alias("score"),
            m["text"].alias("text"),
        ),
    )
    return spans if kind.base and whole_base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", whole_base: bool = True) -> DataFrame:
    """`key` and, per kind, an array of (start, rank, end, kind, score, text); no shuffle.

    With `whole_base` spans of the base kinds are kept with any score, else the score decides for all.
    """
    whole = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return whole.select(
        key, *[_scored(kind, rank, F.col("_text"), whole_base).alias(kind.name) for rank, kind in enumerate(KINDS)]
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.concat(*[F.col(k.name) for k in KINDS if k.base])
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_join(F.transform(F.array_sort(every), lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size(F.filter(every, lambda s: s["score"] >= LEAST_SCORE)).cast("bigint").alias("n_likely"),
    )
