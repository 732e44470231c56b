"""Suffix, substring, near-duplicate and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.line_dedup import BLOCK, blocks, dedup_lines, hashed, rare_pairs
from gneiss.llm.minhash_dedup import links_within, min_max, multipliers, near_duplicates
from gneiss.llm.substring_dedup import dedup_substrings
from gneiss.llm.suffix_dedup import dedup_suffixes, least_of
from gneiss.llm.suffix_sort import Sorter, repeated_starts
from gneiss.llm.words import hash_words
from tests.llm.helpers import awkward, corpus, documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Find(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_words_are_those_of_the_pattern():
    r = random.Random(3)
    for _ in range(200):
        t = bytes(r.choice(b"ab \t\n\x0b\x0c\r\x1c\xc3\xa9\xc2\xa0") for _ in range(r.randint(0, 30)))
        data = np.frombuffer(b" " + t + b" ", np.uint8)
        begin, end, h = hash_words(data)
        found = [bytes(data[a:b]) for a, b in zip(begin, end, strict=True)]
        assert found == WORD.findall(t) == t.split()
        assert all((x == y) == (a == b) for x, a in zip(found, h, strict=True) for y, b in zip(found, h, strict=True))


def test_suffix_and_prefix_arrays():
    r = random.Random(1)
    for _ in range(300):
        n, depth = r.randint(1, 60), r.choice([3, 8, 200])
        t = [r.randint(2, r.choice([2, 3, 6])) for _ in range(n)] + [0]
        order, prefix = Sorter(np.array(t, np.int16), depth, r.choice([5, 10**6])).sort()
        assert sorted(order.tolist()) == list(range(n + 1))
        cut = [t[p : p + depth] for p in order.tolist()]
        assert cut == sorted(cut)
        for i in range(1, n + 1):
            common = 0
            while common < min(len(cut[i - 1]), len(cut[i])) and cut[i - 1][common] == cut[i][common]:
                common += 1
            assert prefix[i] == common


def test_repeated_starts():
    r = random.Random(2)
    for _ in range(100):
        pieces, n = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))], r.randint(2, 7)
        count = Counter(p[i : i + n] for p in pieces for i in range(len(p) - n + 1))
        want = [[i for i in range(len(p) - n + 1) if count[p[i : i + n]] > 1] for p in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, n, r.choice([3, 10**6]))] == want


def test_window_minima():
    x = np.random.default_rng(0).integers(0, 50, 101).astype(np.uint64)
    for w in (1, 2, 7, 100, 101):
        assert least_of(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def suffix_brute(rows, length):
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    count = Counter(t[s : s + length] for t in texts.values() for s in range(len(t) - length + 1))
    out = {}
    for i, t in rows:
        t = (t or "").encode()
        cover = [False] * (len(t) + 1)
        for s in range(len(t) - length + 1) if i is not None else ():
            if count[t[s : s + length]] > 1:
                cover[s : s + length] = [True] * length
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        spans = sum(a and not b for a, b in zip(cover, [False, *cover], strict=False))
        out[i, t] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "seed"), [(40, 8), (200, 32), (12, 12)])
def test_suffix_dedup(spark, length, seed):
    rows = corpus(5) + [(100 + i, t) for i, t in enumerate(["é" * 150, "ab" * 200, "ab" * 90, "", None])] + [(200, "x" * 500), (200, "x" * 500), (None, "ab" * 200)]
    want = suffix_brute(rows, length)
    got = dedup_suffixes(documents(spark, rows), length=length, seed=seed).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in want if i == r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [want[r.doc_id, t] for t in texts]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def substring_brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                cover[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out[i] = (len(w), sum(cover), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed"), [(20, 5), (6, 2), (5, 5), (8, 1)])
def test_substring_dedup(spark, window, seed):
    rows = corpus(6) + [(100, "a b " * 60), (101, "a b " * 20), (102, "a " * 50), (103, None), (104, ""), (105, "z" * 9), (106, "u v w " * 30), (106, "u v w " * 30)]
    want = substring_brute(rows, window)
    got = dedup_substrings(documents(spark, [*rows, (None, "a b " * 60)]), window=window, seed=seed).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def near_brute(rows, size, top):
    find, sets = Find(), {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and 100 * both >= top * len(sets[x] | sets[y]):
                find.join(x, y)
    return {i: (len(sets[i]), find.root(i)) for i in ids}


@pytest.mark.parametrize(("size", "top", "bands", "rows"), [(3, 85, 25, 5), (5, 80, 30, 4)])
def test_near_duplicates(spark, size, top, bands, rows):
    table = corpus(7, 80) + [(300, "One two THREE four"), (301, "one two three four"), (302, ""), (303, None), (304, "x"), (305, "x"), (306, "\t")]
    want = near_brute(table, size, top)
    for block in (2_000_000, 300):  # the second makes pairs of blocks
        got = near_duplicates(documents(spark, table), size=size, top=top, bands=bands, rows=rows, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward(spark):
    got = near_duplicates(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[9] == {(4, False)} and by[8] == {(7, False)} and by[7] == {(7, True)} and by[None] == {(None, True)} and by[2] == {(2, True)}
    assert near_duplicates(documents(spark, [])).count() == 0


def test_min_max_estimates_similarity():
    r = np.random.default_rng(4)
    x = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    by = multipliers(256)
    a, b = min_max(x[:800], by, 512), min_max(x[200:], by, 512)
    assert abs((a == b).mean() - 0.6) < 0.08 and len(a) == 512


def test_links_within_is_exact():
    r = random.Random(8)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(30), r.randint(1, 20))), np.uint64) for _ in range(12)]
        side = np.array([r.randint(0, 1) for _ in sets]) if r.random() < 0.5 else None
        want, got = Find(), Find()
        for i, x in enumerate(sets):
            want.root(i), got.root(i)
            for j in range(i):
                y = sets[j]
                both = len(set(x.tolist()) & set(y.tolist()))
                if 100 * both >= 60 * (len(x) + len(y) - both) and (side is None or side[i] != side[j]):
                    want.join(i, j)
        for a, b in links_within(list(range(12)), sets, side, 60, 100):
            got.join(a, b)
        assert [want.root(i) for i in range(12)] == [got.root(i) for i in range(12)]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    find = Find()
    for a, b in edges:
        if a is not None and a != b:
            find.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find.root(n) for n in find}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def full_set(line, k=10):
    return {line[m : m + k] for m in range(len(line) - k + 1)} or {line}


def line_brute(rows, threshold=0.8):
    find, first, sets = Find(), {}, {}
    for i, t in sorted(r for r in set(rows) if r[0] is not None and r[1] is not None):
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
                sets[line] = full_set(line)
    names = list(sets)
    for x in range(len(names)):
        for y in range(x):
            a, b = sets[names[x]], sets[names[y]]
            if len(a & b) >= threshold * len(a | b):
                find.join(x, y)
    best = {}
    for k, line in enumerate(names):
        best[find.root(k)] = min(best.get(find.root(k), (1e18, 0)), first[line])
    place = {line: best[find.root(k)] for k, line in enumerate(names)}
    return {(i, t): t if t is None or i is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or place[x] == (i, p)) for i, t in rows}


def test_line_dedup(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdéfgh") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            lines.append(r.choice([" ".join(w), " ".join(w), word(), "", " "]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (101, ""), (102, "漢字がある行の文字列です\n漢字がある行の文字列です"), (None, base[0])]
    want = line_brute([x for x in rows if x[0] != 102])
    got = dedup_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].lang == "zz" and got[0].component == 3
    bad = [x.doc_id for x in got if x.doc_id != 102 and x.text not in [v for (i, _), v in want.items() if i == x.doc_id]]
    assert not bad
    assert [x.text for x in got if x.doc_id == 102] == ["漢字がある行の文字列です"]
    assert dedup_lines(documents(spark, [])).count() == 0


def test_lines_of_a_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.text) for r in dedup_lines(docs).collect()} == {(i, x) for (i, _), x in line_brute(rows).items()}


def test_ids_with_several_texts(spark):
    """Equal to the same documents under ids of their own, whose order is that of the text's hash."""
    r = random.Random(8)
    shared = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    texts = [f"{i} alone here {shared if i % 2 else i} and {i} more" for i in range(8)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    order = [x.text for x in documents(spark, rows[:8], False).orderBy("doc_id", F.xxhash64("text")).collect()]
    plain = [(order.index(t), t) for _, t in rows[:9]] + [(None, texts[1])]
    for f in (dedup_suffixes, dedup_substrings):
        got = sorted((x.doc_id is None, x.doc_id or 0, x.kept_sha256, x.n_removed) for x in f(documents(spark, rows)).collect())
        want = sorted((x.doc_id is None, (x.doc_id or 0) // 2, x.kept_sha256, x.n_removed) for x in f(documents(spark, plain)).collect())
        assert got == want and any(x[3] for x in got)


def test_texts_with_one_id_are_two_documents(spark):
    one, two = "the quick brown fox jumps over the lazy dog", "a line that is nowhere else in these documents"
    got = sorted(r.text for r in dedup_lines(documents(spark, [(1, one), (2, two), (2, one), (2, one)])).collect())
    assert got == ["", "", two, one]


def test_lines_are_compared_on_all_their_characters(spark):
    rows = [(1, "It is 12 km away"), (2, "He ran far away"), (3, "And with."), (4, "Is with."), (5, "Zu. Für."), (6, "Für."), (7, "a bc de fgh ij kl mn op qr st uv wx yz ab cd ef gh ij kl mn"), (8, "a bc de fgh ij kl mn op qr st uv wx yz ab cd ef gh ij kl mm")]
    x, y = full_set(rows[6][1]), full_set(rows[7][1])
    assert len(x & y) >= 0.8 * len(x | y)  # no word of four letters: only full shingles see this pair
    got = {r.doc_id: r.n_removed for r in dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1}


def test_pairs_of_lines_over_one_template(spark):
    r = random.Random(21)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = letters(300), []
    for _ in range(150):
        at = sorted(r.sample(range(10, 290, 14), 3))
        own = list(template)
        for p in at:
            own[p : p + 3] = letters(3)
        lines.append("".join(own))
        own[r.randrange(20, 280)] = letters(1).upper()
        lines.append("".join(own))
    sets, find = [full_set(x) for x in lines], Find()
    for x in range(len(lines)):
        find.root(x)
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                find.join(x, y)
    kept = [x for x in range(len(lines)) if find.root(x) == x]
    assert len(kept) > 100
    assert [r.doc_id for r in dedup_lines(documents(spark, list(enumerate(lines)))).where("n_removed = 0").orderBy("doc_id").collect()] == kept


def test_shingles_are_hashed_in_blocks(spark):
    """A row for eight shingles of a line, not for each; together they are all the line's shingles and no other."""
    text = "añ𝄞 das ist eine Zeile 漢字 mit 𝒳 vielen Zeichen."
    table = spark.createDataFrame([(n, text[:n]) for n in range(1, len(text) + 1)], "d1 long, line string")
    want = {r.d1: set(r.s) for r in table.select("d1", hashed(F.col("line"), 10).alias("s")).collect()}
    got, rows = {}, {}
    for r in blocks(table, 10).collect():
        got.setdefault(r.d1, set()).update(r[1:])
        rows[r.d1] = rows.get(r.d1, 0) + 1
    assert got == want
    assert rows == {n: -(-max(1, n - 9) // BLOCK) for n in want}


def test_lines_over_one_passage_meet_once(spark):
    """However many shingles two lines share, the join on rare shingles makes their pair once, and every pair of 0.8."""
    r = random.Random(31)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = letters(400)
    lines = [letters(r.choice([30, 60])) + passage for _ in range(40)]
    sets = [full_set(x) for x in lines]
    like = {(x, y) for x in range(40) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
    table = spark.createDataFrame([(i, i, x, len(sets[i])) for i, x in enumerate(lines)], "d1 long, c long, line string, n int")
    got = [(max(x.a, x.b), min(x.a, x.b)) for x in rare_pairs(table, 10, 0.8).collect()]
    assert len(like) > 100 and like <= set(got)
    assert len(got) == len(set(got))


def test_awkward_texts_pass_all(spark):
    d = documents(spark, awkward())
    for f in (dedup_suffixes, dedup_substrings, dedup_lines):
        assert f(d).count() == len(awkward())
        assert f(documents(spark, [])).count() == 0
    s = {r.doc_id: r.n_removed for r in dedup_substrings(d).collect()}
    assert s[9] == 40_000 and s[4] > 0  # LONG repeats itself; its copy goes whole
