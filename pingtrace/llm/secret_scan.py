"""Secret scans through an inverted index of trigrams.

Each rule's regular expression yields a Boolean trigram query. The trigrams that
the queries name are indexed: a posting is (trigram, document). Postings are met
by alternative, group and rule, which leaves the candidate documents of each
rule; only these are searched with its expression. Rules without mandatory
trigrams search every document. All of it is DataFrame and SQL functions; the
result does not depend on the index, which only spares work.

Candidates are staged and counted. Up to BROADCAST_ROWS they are sent to the
texts, above that both sides are shuffled by id.

Defined results: null counts as empty text and has no spans; repeated rows are
searched each, rows of the same id share their candidates (which may only cost a
needless search); a null id is an id like any other; other columns, of any names, are kept by
`redact` and not read by `find_secrets`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.inputs import fresh_names, table
from pingtrace.llm.spans import joined, matches, none
from pingtrace.llm.trigrams import trigram_query
from pingtrace.sources.staging import staged

BROADCAST_ROWS = 200_000
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    check: Callable[[Column], Column] = lambda m: F.lit(True)
    base: bool = False


_ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A key goes to its END line if no other line of dashes comes first; else as far as its lines of base64 go, with the
# headers of an encrypted key before them. Lines may be quoted, indented or parted by a written \\n.
_PARTED = r"(?:[\s\"'+>|#*;,]|\\[nrt]?+)*+"
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_PARTED}(?:(?:Proc-Type|DEK-Info):\x20?+[A-Za-z0-9,-]++|(?:Version|Comment|Charset):[^\r\n\\]*+))*+"
    rf"(?:{_PARTED}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    rf"(?:(?<=[A-Za-z0-9+/]{{16}}){_PARTED}[A-Za-z0-9+/]++(?:={{1,2}}+|(?=[\x20\t\"',]*+(?:[\r\n\\]|$))))?+)"
)
RULES = (
    Rule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", base=True),
    Rule("forge", r"(?<![A-Za-z0-9])gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", _PRIVATE_KEY),
    Rule("login_in_url", r"[a-z]{3,10}://[^\s/:@]++:[^\s/@]++@"),
)


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index for the given trigrams: a row (trigram, key) for each text that holds one."""
    low = F.col("_low")
    held = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in trigrams]))
    return docs.select(key, F.lower(text).alias("_low")).select(key, F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the names of the rules (array) whose trigram query the text satisfies.

    Rules without mandatory trigrams are left out: they search every text.
    """
    alternatives, needed = [], {}
    for rule in rules:
        query = trigram_query(rule.pattern)
        for g, group in enumerate(query):
            for a, trigrams in enumerate(group):
                all_bits = (1 << len(trigrams)) - 1
                alternatives += [(rule.name, g, a, t, 1 << i, all_bits) for i, t in enumerate(sorted(trigrams))]
        if query:
            needed[rule.name] = (1 << len(query)) - 1
    # As many rows as the rules' queries have trigrams.
    names = ("rule", "part", "alternative", "trigram", "bit", "all_bits")
    rows = [
        F.struct(*[F.lit(v).cast("bigint" if n.endswith(("bit", "bits")) else "string" if isinstance(v, str) else "int").alias(n)
                   for n, v in zip(names, row, strict=True)])
        for row in alternatives
    ]
    lookup = docs.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    index = postings(docs, sorted({a[3] for a in alternatives}), key, text)
    met = (
        index.join(F.broadcast(lookup), "trigram")
        .groupBy(key, "rule", "part", "alternative", "all_bits")
        .agg(F.expr("bit_or(bit)").alias("bits"))
        .where("bits = all_bits")
        .select(key, "rule", F.expr("shiftleft(1L, part)").alias("part_bit"))
        .groupBy(key, "rule")
        .agg(F.expr("bit_or(part_bit)").alias("parts"))
    )
    enough = F.lit(False)
    for name, bits in needed.items():
        enough = enough | ((F.col("rule") == name) & (F.col("parts") == bits))
    # At most as many rules as there are in a group.
    return met.where(enough).groupBy(key).agg(F.collect_set("rule").alias("_secret_rules"))


def _with_spans(docs: DataFrame, name: str, rules, key: str, text: str) -> DataFrame:
    """`docs` with the column `name`: a struct with an array of (start, rank, end, kind) for each rule, by its name."""
    id_, held = fresh_names(docs, "key", "rules")
    chosen = staged(candidates(docs, rules, key, text), "secret-candidates").toDF(id_, held)
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    searched = docs.join(chosen, F.col(f"`{key}`").eqNullSafe(F.col(id_)), "left").drop(id_)
    whole = F.coalesce(F.col(text), F.lit(""))

    def spans(rank: int, rule: Rule) -> Column:
        found = F.filter(matches(whole, rule.pattern), lambda m: rule.check(m["text"]))
        if trigram_query(rule.pattern):
            found = F.when(F.array_contains(held, rule.name), found).otherwise(none())
        else:
            found = F.when(whole.rlike(rule.pattern), found).otherwise(none())
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(rule.name).alias("kind")
            ),
        ).alias(rule.name)

    every = F.struct(*[spans(rank, rule) for rank, rule in enumerate(rules)])
    return searched.withColumn(name, every).drop(held)


def find_secrets(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and, per rule, an array of (start, rank, end, kind), in code points, of every row."""
    taken = docs.select(key, text)
    (name,) = fresh_names(taken, "spans")
    return _with_spans(taken, name, rules, key, text).select(key, f"{name}.*")


def redact(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every span of a secret replaced by MASK; overlapping spans give one mask.

    Rows without spans are returned as they are.
    """
    (name,) = fresh_names(docs, "spans")
    found = _with_spans(docs, name, rules, key, text)
    spans = F.array_sort(F.concat(*[F.col(name)[r.name] for r in rules]))
    whole, state = F.col(text), F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        # A span that begins inside the last one lengthens its mask.
        between = F.when(
            (s["start"] > acc["at"]) | (acc["at"] == 0),
            F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK)),
        ).otherwise(acc["kept"])
        return F.struct(between.alias("kept"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(
        spans,
        state,
        cut,
        lambda acc: F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(whole)).drop(name)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.concat(*[F.col(r.name) for r in RULES if r.base])
    return found.select(
        "doc_id",
        *[F.size(r.name).cast("bigint").alias(f"n_{r.name}") for r in RULES if r.base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(*[F.col(r.name) for r in RULES])).alias("spans"),
    )
