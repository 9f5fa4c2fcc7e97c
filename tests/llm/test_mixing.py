import oracle
import pytest
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import mixing
from pingtrace.llm.mixing import Targets, leaf_budgets, mix


def level(budget: float, nodes: dict, weights: dict) -> dict:
    """Share a budget among nodes of given capacity, filling one after the other."""
    open_, shares = {k: weights.get(k, 1) for k in nodes}, {}
    while open_:
        height = budget / sum(open_.values())
        full = [k for k in open_ if nodes[k] <= height * open_[k]]
        if not full:
            return shares | {k: int(height * w) for k, w in open_.items()}
        for k in full:
            shares[k] = nodes[k]
            budget -= nodes[k]
            del open_[k]
    return shares


@pytest.mark.parametrize("percent", [10, 80, 150, 1000])
def test_budgets_by_filling(spark, percent):
    leaves = {("web", "en", "a"): 1000, ("web", "en", "b"): 10, ("web", "de", "a"): 50, ("books", "en", "a"): 5,
              ("books", None, None): 300, ("code", "en", "c"): 2000}
    targets = Targets(budget_percent=percent)
    frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(frame, targets).collect()}
    capacity = {k: v * targets.max_epochs for k, v in leaves.items()}
    below = lambda *p: sum(c for k, c in capacity.items() if k[: len(p)] == p)
    want = {}
    top = level(sum(leaves.values()) * percent // 100, {d: below(d) for d, _, _ in leaves}, targets.domain)
    for domain, share in top.items():
        langs = level(share, {k[1]: below(domain, k[1]) for k in leaves if k[0] == domain}, targets.lang)
        for lang, part in langs.items():
            sources = {k[2]: capacity[k] for k in leaves if k[:2] == (domain, lang)}
            want |= {(domain, lang, s): b for s, b in level(part, sources, {}).items() if b}
    assert got == want


def test_prefixes(spark):
    """Each leaf's chosen documents are a prefix of its order, as long as fits."""
    rows = odd_rows(["a ", "b c ", "d\n"], 400, seed=3)
    frame = documents(spark, rows)
    chosen = mix(frame)
    assert set(chosen.columns) == {*frame.columns, "domain", "n_tokens", "epochs"}
    used, sizes = {}, {}
    for r in chosen.collect():
        leaf = (r.domain, r.lang, r.source)
        used[leaf] = used.get(leaf, 0) + r.n_tokens * r.epochs
        assert r.n_tokens == len(r.text.split()) and 1 <= r.epochs <= Targets().max_epochs
    marked = frame.withColumn("domain", mixing.domain_of_source()).withColumn("n_tokens", mixing.n_words(frame.text))
    for r in marked.collect():
        leaf = (r.domain, r.lang, r.source)
        sizes.setdefault(leaf, []).append(r.n_tokens)
    leaves = [(*k, sum(v)) for k, v in sizes.items() if sum(v)]
    budgets = leaf_budgets(
        spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), Targets()
    ).collect()
    for r in budgets:
        leaf = (r.domain, r.lang, r.source)
        assert r.budget - 2 * max(sizes[leaf]) <= used.get(leaf, 0) <= r.budget


def test_query(spark):
    frame = mixing.op2_source_mixing(spark, SF_DIR)
    expected, missing, extra = oracle.differences(frame, oracle.connect(SF_DIR), mixing.ORACLE_SQL)
    assert expected and not missing and not extra


@pytest.mark.parametrize("broadcast_rows", [0])
def test_without_broadcasts(spark, monkeypatch, broadcast_rows):
    before = sorted(map(str, mixing.op2_source_mixing(spark, SF_DIR).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast_rows)
    assert sorted(map(str, mixing.op2_source_mixing(spark, SF_DIR).collect())) == before


def test_empty_table(spark):
    assert mix(documents(spark, [])).collect() == []
