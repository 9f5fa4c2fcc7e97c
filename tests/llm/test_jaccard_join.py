import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import components as components_module
from pingtrace.llm import jaccard_join
from pingtrace.llm.components import components, merged
from pingtrace.llm.jaccard_join import ORACLE_SQL, Similarity, keep_first, op3_jaccard_join, similar_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, n, percent):
    """(id, size, component) of every row, and the components as lists of row numbers."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    above = list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    holders = defaultdict(list)
    for k, grams in enumerate(sets):
        for g in grams:
            holders[g].append(k)
    for k, grams in enumerate(sets):
        for other, both in Counter(o for g in grams for o in holders[g] if o > k).items():
            if 100 * both >= percent * (len(grams) + len(sets[other]) - both):
                above[root(k)] = root(other)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    lowest = {r: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for r, g in groups.items()}
    return Counter((i, len(sets[k]), lowest[root(k)]) for k, (i, _) in enumerate(rows)), list(groups.values()), sets


@pytest.fixture(scope="module")
def rows():
    """Families of edited texts, in which chains of links are common, and odd rows."""
    chance = random.Random(2)
    base = "the quick brown fox jumps over lazy dogs and cats while it rains on us all day long in spain".split() * 4
    found = []
    for k in range(250):
        words = base[: chance.choice([3, 5, 12, 30, 60, 76])]
        for _ in range(chance.randint(0, 3)):
            words[chance.randrange(len(words))] = chance.choice("abcdefgh")
        found.append((1000 + k, " ".join(words)))
    return found + odd_rows(["one ", "two ", "three ", "Four ", "\n"], 60, most=8)


@pytest.mark.parametrize(("n", "percent", "tile_rows"), [(3, 90, 1024), (3, 90, 8), (5, 80, 8)])
def test_components(spark, rows, n, percent, tile_rows):
    frame = similar_components(documents(spark, rows), Similarity(n, percent), tile_rows=tile_rows)
    got = Counter((r.doc_id, r["size"], r.component) for r in frame.collect())
    assert got == plain(rows, n, percent)[0]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert Counter(map(tuple, op3_jaccard_join(spark, SF_DIR).collect())) == plain(rows, 3, 90)[0]


def test_query_equals_its_sql(spark):
    frame = op3_jaccard_join(spark, SF_DIR)
    expected, missing, extra = oracle.differences(frame, oracle.connect(SF_DIR), ORACLE_SQL)
    assert expected and not missing and not extra


def test_similar_sets_share_a_division():
    """The tiles' promise, for sizes on both sides of every band's edge."""
    import numpy as np

    chance = np.random.default_rng(1)
    for percent in (80, 90):
        similarity = Similarity(3, percent)
        for size in [*range(1, 60), *(e + d for e in similarity.band_edges(3000) for d in (-1, 0, 1) if e + d > 0)]:
            grams = np.unique(chance.integers(0, 1 << 63, size).astype(np.uint64))
            fewer = next(b for b in range(size, -1, -1) if b == 0 or not similarity.holds(b - 1, b - 1, size))
            other = np.sort(chance.permutation(grams)[: max(fewer, 1)])
            if similarity.holds(len(other), len(other), len(grams)):
                assert np.intersect1d(similarity.keys(grams), similarity.keys(other)).size, (percent, size)


def test_keep_first(spark, rows):
    frame = documents(spark, rows)
    kept = keep_first(frame, Similarity(3, 90))
    assert kept.columns == frame.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    _, groups, sets = plain(rows, 3, 90)
    blank = [k for k, s in enumerate(sets) if not s]
    left = [g for g in groups if sets[g[0]]]
    assert sum(got.values()) == len(left) + len(blank)
    assert not got - Counter(rows)
    for group in left:
        ids = [rows[k][0] for k in group]
        lowest = min((i for i in ids if i is not None), default=None)
        assert sum(got[r] > 0 for r in {rows[k] for k in group} if r[0] == lowest) == 1


def test_keep_first_with_columns_of_any_names(spark):
    names = ["_jaccard_id", "_jaccard_class", "_own_id", "_own_class", "_own_dropped", "_OWN_CLASS_", "group", "first"]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i"), (None, "g h i"), (4, None)]
    frame = documents(spark, rows).selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    kept = keep_first(frame, Similarity(3, 90))
    assert kept.columns == frame.columns
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == [1, 3, 4] and all(r[n] == "x" for r in found for n in names)


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """One large family of near copies, of which most pairs are links, and one whose pairs lie below the bound."""
    chance = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]

    def family(n, base, changes):
        made = []
        for _ in range(n):
            words = list(base)
            for _ in range(changes):
                words[chance.randrange(len(words))] = chance.choice(vocabulary)
            made.append(" ".join(words))
        return made

    near, apart = chance.choices(vocabulary, k=240), chance.choices(vocabulary, k=240)
    texts = family(300, near, 2) + family(300, apart, 5)
    rows = list(enumerate(texts))
    made = {}
    for name in ("_possible_links", "_in_question", "_joining_links"):
        whole = getattr(jaccard_join, name)

        def counted(tiles, similarity, name=name, whole=whole):
            found = whole(tiles, similarity)
            made[name] = (tiles.count(), found.count(), tiles.select("division", "block_a", "block_b").distinct().count())
            return found

        monkeypatch.setattr(jaccard_join, name, counted)
    whole_linked, pairs = jaccard_join.linked, []
    monkeypatch.setattr(jaccard_join, "linked", lambda p, *a: pairs.append(p.count()) or whole_linked(p, *a))
    frame = similar_components(documents(spark, rows), Similarity(3, 90), tile_rows=64)
    got = Counter((r.doc_id, r["size"], r.component) for r in frame.collect())
    assert got == plain(rows, 3, 90)[0]
    # Never more rows than came in; pairs are few for each text, where a family has 44,850.
    assert made and all(out <= came for came, out, _ in made.values())
    assert all(n <= 12 * len(rows) for n in pairs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_merged_components(spark):
    chance = random.Random(3)
    links = [(chance.randrange(60), chance.randrange(60)) for _ in range(50)]
    first, more, every = (spark.createDataFrame(x, "a long, b long") for x in (links[:30], links[30:], links))
    assert sorted(merged(components(first), more).where("node <> component").collect()) == sorted(
        components(every).where("node <> component").collect()
    )
    none = more.where("false")
    assert sorted(merged(components(first), none).collect()) == sorted(components(first).collect())
    assert merged(components(none), none).collect() == []


def test_settled_links_are_not_followed_again(spark, monkeypatch):
    """Later steps look only at the links that join components, not at those of earlier steps again."""
    chance = random.Random(12)
    rows = []
    for changes in (2, 4, 6):
        base = [f"w{chance.randrange(3000)}" for _ in range(240)]
        for _ in range(80):
            words = list(base)
            for _ in range(changes):
                words[chance.randrange(len(words))] = f"x{chance.randrange(3000)}"
            rows.append((len(rows), " ".join(words)))
    edges, whole = [], components_module.staged

    def counted(frame, label, *more):
        table = whole(frame, label, *more)
        edges.extend([table.count()] if label == "component-edges" else [])
        return table

    monkeypatch.setattr(components_module, "staged", counted)
    got = Counter((r.doc_id, r["size"], r.component) for r in similar_components(documents(spark, rows), Similarity(3, 90)).collect())
    assert got == plain(rows, 3, 90)[0]
    assert len(edges) > 1 and all(n < edges[0] for n in edges[1:])


def test_empty_table(spark):
    empty = documents(spark, [])
    assert similar_components(empty, Similarity(3, 90)).collect() == []
    assert keep_first(empty, Similarity(3, 90)).collect() == []


def test_arrays_are_taken_in_rounds(spark, monkeypatch):
    """Four similar classes in question in eight divisions: no round has the copies for all of them."""
    base = list(range(1, 101))
    sets = {k: np.array(sorted([*base, 1000 + k]), np.uint64) for k in range(4)}
    arrays = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "class bigint, grams binary")
    sizes = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "class bigint, size bigint")
    asked = spark.createDataFrame(
        [(d, 0, 0, 0, k, k, len(s)) for d in range(8) for k, s in sets.items()],
        "division bigint, block_a int, block_b int, block int, class bigint, component bigint, size bigint",
    )
    copied, whole = [], jaccard_join._joining_links
    monkeypatch.setattr(jaccard_join, "_joining_links", lambda t, s: copied.append(t.count()) or whole(t, s))
    links = jaccard_join._joined_in_rounds(asked, sizes, arrays, Similarity(3, 90))
    assert {r.component for r in components(links).collect()} == {0} and links.count() == 8 * 3
    assert len(copied) == 8 and sum(copied) == 32 and max(copied) < 32
