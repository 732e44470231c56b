"""Source divergence against its contract, done term by term in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gneiss.llm import divergence as D
from gneiss.llm import queries
from tests.llm.helpers import LONG, documents
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value long, rank int, p long"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        t = WORD.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(t)
        count[lang or "", None].update(t)
        docs[lang or ""].update(set(t))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(source):
            c = count[lang, source]
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = p(None)
        for g in sources:
            mine = p(g)
            pair = sorted((-sum(abs(mine[t] - other[t]) for t in kept), s.encode(), s) for s in sources - {g} for other in [p(s)])
            out += [(lang, g, "pair", s, -v, k) for k, (v, _, s) in enumerate(pair, 1)]
            term = sorted((q[t] - mine[t], t.encode(), t) for t in kept if count[lang, g][t] and mine[t] > q[t])[:top]
            out += [(lang, g, "term", t, -v, k) for k, (v, _, t) in enumerate(term, 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, 3, 4) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "ijklmnopqrst"]
    weight = [1 / (k + 1) for k in range(len(words))]
    return [(" ".join(r.choices(words[(k := r.randrange(3)) :], weight[: len(words) - k], k=r.randint(0, 60))).title(), r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None])) for _ in range(400)]


@pytest.mark.parametrize("least, top", [(1, 5), (5, 50), (30, 3)])
def test_equals_brute_force(spark, rows, least, top):
    assert result(D.divergence(made(spark, rows), least, top)) == brute(rows, least, top)


def test_pairs_in_small_pieces(spark, rows, monkeypatch):
    """Postings cut into few pairs at once, and terms cut by record batches, give the same."""
    import pyarrow as pa

    r = random.Random(5)
    postings = sorted((lang, f"t{t}", f"s{s}", r.randrange(1, 90), 3 + s) for lang in ("a", "b") for t in range(30) for s in r.sample(range(9), r.randint(1, 9)))
    table = pa.table(dict(zip(["lang", "term", "source", "p", "p0"], map(list, zip(*postings, strict=True)), strict=True)))

    def total(batches):
        out = Counter()
        for b in D.both_have(iter(batches)):
            for x in b.to_pylist():
                out[x["lang"], *sorted((x["source"], x["item"]))] += x["value"]
        return out

    whole = total(table.to_batches())
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 3)
    assert total(table.to_batches(max_chunksize=4)) == whole
    want = Counter()
    for i, (lang, t, a, p, p0) in enumerate(postings):
        for other, u, b, q, q0 in postings[i + 1 :]:
            if (lang, t) == (other, u):
                want[lang, *sorted((a, b))] += abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)
    assert whole == want


def test_flushing_counts_changes_nothing(spark, rows, monkeypatch):
    """Terms beyond what a task holds go out early."""
    import pyarrow as pa

    table = pa.table({"lang": [x[1] or "" for x in rows], "source": [x[2] or "" for x in rows], "text": [x[0] for x in rows]})

    def total(batches):
        n, docs, groups = Counter(), Counter(), Counter()
        for b in D.count_terms(iter(batches)):
            for x in b.to_pylist():
                key = x["lang"], x["source"], x["term"]
                n[key] += x["n"]
                docs[key] += x["docs"]
                groups[key] += x["term"] is None
        return n, docs, +groups

    whole = total(table.to_batches())
    monkeypatch.setattr(D, "TERMS_AT_ONCE", 10)
    assert total(table.to_batches(max_chunksize=7)) == whole
    assert max(whole[2].values()) == 1


def test_rounds_go_on_until_bounds_are_below(spark, rows):
    """A first round of one bucket finds the same terms as one of all."""
    d = made(spark, rows)
    every = [x for x in brute(rows, 5, 7) if x[2] == "term"]
    real = D.top_terms
    for at_first in (1, 10_000):
        D.top_terms = lambda s, top, n=at_first: real(s, top, n)
        try:
            assert [x for x in result(D.divergence(d, 5, 7)) if x[2] == "term"] == every
        finally:
            D.top_terms = real


def test_many_groups_are_joined_without_a_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "GROUPS_TO_ALL", 0)
    assert result(D.divergence(made(spark, rows), 5, 5)) == brute(rows, 5, 5)


def test_awkward_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("  \n\t 12 !", "en", "b"), (LONG, "en", "c"), (LONG, "en", "c"), ("ÀB aB", "", ""), ("É" * 5000, "de", "x"), ("one", None, "x")]
    for least in (1, 2, 30):
        assert result(D.divergence(made(spark, rows), least, 50)) == brute(rows, least, 50)
    assert result(D.divergence(made(spark, []))) == []
    assert result(D.divergence(documents(spark, [(1, "a b"), (1, "a b")]))) == []


def test_probabilities_are_exact(spark):
    n = [0, 1, 7, 10**6, 3 * 10**12, 10**13]
    d = spark.createDataFrame([(c, t, v) for c in n for t in n for v in (1, 10**6) if c <= t], "c long, t long, v long")
    for c, t, v, p in d.withColumn("p", D.probability("c", "t", "v")).collect():
        assert p == 1 + 1000000000 * (c + 5) // (t + 5 * v)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    compare(queries.QUERIES["op12_source_divergence"](spark, sf), connect(sf), queries.ORACLES["op12_source_divergence"])
