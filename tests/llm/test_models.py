"""Language ID, page extraction, token counts and vector search against labels, libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import ann
from gneiss.llm.html_extraction import Field, blocks, encode, extract_main_text, labelled_pages, text_of
from gneiss.llm.language_id import UNDETERMINED, identify, op4_language_id, train
from gneiss.llm.token_counts import SPACE, Counter, count_tokens, load_pieces
from tests.llm.helpers import LONG, awkward, documents

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op4_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_language_awkward(spark):
    d = documents(spark, awkward() + [(20, "12345 ***"), (21, "Ünïcode wörter")])
    m = train(spark.read.parquet(f"{SF}/documents.parquet"), per_language=60)
    got = {r.doc_id: r for r in identify(d, m, keep=("text", "lang")).collect()}
    numbers = identify(documents(spark, [(i, t) for i, t in enumerate("² ½ ① 5 _ ٣ Ⅷ".split())]), m).collect()
    assert {(r.lang_pred, r.score) for r in numbers} == {(UNDETERMINED, 0.0)}
    assert {r.lang_pred for r in identify(documents(spark, [(1, "ª"), (2, "ʰ"), (3, "ǅ"), (4, "1é")]), m).collect()} <= {"de", "en", "es", "fr"}
    assert [got[i].lang_pred for i in (1, 2, 3, 20)] == [UNDETERMINED] * 4 and got[1].score == 0
    assert got[21].lang_pred in {"de", "en", "es", "fr"} and got[4].text == LONG and got[4].lang == "zz"
    assert {r.lang_pred for r in identify(d, None).collect()} == {UNDETERMINED}
    assert train(documents(spark, []).withColumn("lang", F.lit(None).cast("string"))) is None
    one = train(documents(spark, [(i, f"text {i}") for i in range(8)]))
    assert {r.lang_pred for r in identify(documents(spark, [(1, "abc")]), one).collect()} == {"zz"}


@pytest.fixture(scope="module")
def field():
    return Field(labelled_pages(200))


def test_held_out_layouts(field):
    wrong = total = 0
    for page in labelled_pages(150, seed=99):
        features, _, y = encode(page)
        for label, want in zip(field.decode(features), y, strict=True):
            wrong += label != int(want == "1")
            total += 1
    assert total > 2000 and wrong <= 0.01 * total


def test_viterbi_is_the_best_path(field):
    from itertools import product

    for page in labelled_pages(12, seed=5):
        f, _, _ = encode(page)
        f = f[:9]
        score = lambda y, f=f: sum(field.weights[w][v] for x, v in zip(f, y, strict=True) for w in x if w in field.weights) + sum(field.move[a][b] for a, b in zip(y, y[1:], strict=False))
        assert score(field.decode(f)) == pytest.approx(max(map(score, product((0, 1), repeat=len(f)))))


def test_blocks():
    read = lambda s: [text_of(b) for b in blocks(s)]
    assert read("<p>a <b>b</b>\n c<p>d<br>e</p>f &amp; g&nbsp;h") == ["a b c", "d e", "f & g h"]
    assert read("<script>x</p>y</script><style>p{}</style><!-- c --><p title='a>b'>z</p>") == ["z"]
    assert read("<ul><li>a<li>b</ul><td>c") == ["a", "b", "c"]
    assert read("a < b <3 & c") == ["a < b <3 & c"]
    assert read("") == read("<p> </p>") == read("<!-- never ends") == []
    assert read("<p>cut <a href='x") == ["cut"]
    assert read("<script>never ends") == []


def test_text_after_embedded_elements_stays(field):
    read = lambda s: [text_of(b) for b in blocks(s)]
    assert read('<article><p>one <svg class="i"/> two</p><p>three</p></article>') == ["one two", "three"]
    assert read("<p>one <iframe src=x /> four</p><p>five</p>") == ["one four", "five"]
    assert read("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x=1 holds"]
    assert read("<article><noscript><p>body</p></noscript><p>end</p></article>") == ["body", "end"]
    assert read("<p>a <svg><g><path d='M0'/></g><text>t</text></svg> b</p><p>c") == ["a t b", "c"]
    assert read("<p>a <svg><g>b<p>c</p><div>d</div>") == ["a b", "c", "d"]
    assert read("<p>a <object>o <video>v</video></object> b</p>") == ["a o v b"]
    assert read("<article><p>a <textarea>t</p><p>b</p></article>") == ["a", "b"]
    assert read("<p>a<select><option>x</select> b</p>") == ["a b"]
    page = "<nav><a href=/a>A</a></nav><article><p>One two three.</p><noscript><p>Four five six.</p></noscript><p>Seven <svg/> eight.</p></article><footer>&copy; f</footer>"
    assert field.extract(page) == ["One two three.", "Four five six.", "Seven eight."]


def test_deeply_nested_pages_are_read_whole(field):
    import time

    n = 20_000
    begin = time.monotonic()
    assert len(blocks("".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'>word {k}" for k in range(n)), field.weights.keys())) == n
    assert len(blocks("<b>x" * n + "</i>" * n + "<p>y")) == 2
    assert [text_of(b) for b in blocks("<svg><title>" * n + "<p>y")] == []
    assert time.monotonic() - begin < 20


def test_layouts_of_another_hand(field):
    """Not made by the generator that the field learns from: tables, id-only columns, definition pages, old portals."""
    body = ["The river rose two metres in a day.", "Nobody in the village had seen such a flood before, and the bridge was closed at noon.", "By evening the water fell again."]
    para = lambda x: f"<p>{x}</p>"
    pages = [
        f"<table><tr><td class='leftnav'><a href=/>Home</a> <a href=/n>News</a></td><td class='content'>{''.join(map(para, body))}</td></tr></table><div class=footer>Copyright 2001</div>",
        f"<div id=header><a href=/>Site</a></div><div id=main><div class=post>{''.join(map(para, body))}</div></div><div id=sidebar><ul><li><a href=1>Old</a></ul></div><div id=footer>&copy; us</div>",
        f"<body><header><a href=/>S</a></header><main><section>{''.join(map(para, body))}</section></main><aside><p>Read also this.</p></aside><footer><p>&copy; 2020 All rights.</p></footer>",
        f"<body><div class='cookie-consent'>We use cookies.</div><article class='story'>{''.join(map(para, body))}<div class=share><a href=t>Tweet</a></div></article><section class=comments><div class=comment><p>First!</p></div></section>",
        f"<body><nav role=navigation><ul><li><a href=/>A</a><li><a href=/b>B</a></ul></nav><div class=entry-content>{body[0]}<br>{body[1]}<p>{body[2]}</div><form><label>Mail</label><input></form>",
    ]
    words = lambda x: " ".join(x).split()
    right = total = 0
    for page in pages:
        got = words(field.extract(page))
        right += len(set(got) & set(words(body)))
        total += len(set(got) | set(words(body)))
    assert right / total > 0.9


def test_pages(spark, field):
    art = "<nav><a href=/a>A</a></nav><article><h1>T&eacute;</h1><p>One  two\nthree.</p><p>x.</p></article><footer>&copy; f</footer>"
    rows = [(1, "u", art), (2, None, None), (3, "v", ""), (None, "w", art), (4, "x", "<p>" + LONG + "</p>"), (1, "u", art)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extract_main_text(d, field=field).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Té\nOne two three.\nx." == by[None].text and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[4].text == LONG
    assert extract_main_text(d.where("false"), field=field).count() == 0


def test_tables_pages_are_whole(spark, field):
    import re

    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(d, field=field).collect()}
    for r in d.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        want = [text_of(b) for b in blocks(inner)]
        assert got[r.page_id] == "\n".join(want)


TEXTS = ["", "a", " a", "a ", "  two  spaces ", "日本語 x", "é\n\nb", "\n", "😀 ok 😀😀", "The the THE", "▁x", "tab\tx", LONG[:3000]]


def reference(vocabulary):
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


def test_token_counts_are_the_tokenizers(spark):
    from gneiss.llm.token_counts import default_vocabulary

    path = default_vocabulary()
    t = reference(path)
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [len(t.encode(SPACE + x.replace(" ", SPACE), add_special_tokens=False).ids) if x else 0 for x in texts]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want))
    c = Counter(load_pieces(path), limit=3)
    assert [c.of(x) for x in texts[:40]] == want[:40]


def test_token_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    r = random.Random(4)
    for fallback in (False,):
        for _ in range(60):
            names = {"a", "b", SPACE} if r.random() < 0.7 else {SPACE}
            names |= {"".join(r.choice("ab" + SPACE) for _ in range(r.randint(1, 4))) for _ in range(6)}
            pieces = [(p, float(-r.randint(1, 4))) for p in sorted(names)]
            t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
            c = Counter([("\0unk", 0.0), *pieces], bytes_for_unknown=fallback)
            for _ in range(20):
                s = "".join(r.choice("aab xb") for _ in range(r.randint(1, 12)))
                want = len(t.encode(SPACE + s.replace(" ", SPACE), add_special_tokens=False).ids)
                assert c.best(SPACE + s.replace(" ", SPACE)) == want


def test_token_awkward(spark):
    got = count_tokens(documents(spark, awkward()), vocabulary=[("a", -1.0)]).collect()
    assert len(got) == len(awkward()) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert count_tokens(documents(spark, []), vocabulary=[]).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall(spark, scale):
    g = np.random.default_rng(2)
    x = g.normal(size=(1200, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= g.uniform(0.2, 3, (1200, 1)).astype(np.float32)
    x[700:] = x[:500] + 0.05 * x[700:]
    x[400:420] = x[0]
    d = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.search(d, d.where("vec_id % 20 = 0"), k=20, block=500).toPandas()
    hit = 0
    y = x.astype(np.float64)
    for q, part in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -s))[:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, s[part.vec_id])
        assert part.score.is_monotonic_decreasing
        hit += len(set(best) & set(part.vec_id))
    assert hit >= 0.9 * 20 * 60


def share_and_recall(x, k=20, step=20):
    """What share of the rows the tables let through, what share is reranked, and the recall at ``k``."""
    coder = ann.Coder(x[:4096], float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-12), len(x), k)
    index = ann.Index(np.arange(len(x)), x, coder)
    met, near, hit, asked = [], [], 0, range(0, len(x), step)
    for i in asked:
        met.append(index.met(coder.query_code(x[i]), coder.radius).mean())
        near.append(len(index.within(coder.query_code(x[i]), coder.radius)) / len(x))
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:k]) & set(index.search(i, x[i], k)[0]))
    return np.mean(met), np.mean(near), hit / k / len(asked)


def test_tables_are_selective_where_vectors_have_neighbours():
    g = np.random.default_rng(5)
    centres = g.normal(size=(100, 64))
    x = np.repeat(centres, 42, axis=0) + 0.15 * g.normal(size=(4200, 64))
    x = x[g.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met, near, recall = share_and_recall(x)
    assert recall >= 0.9 and near < 0.05 and met < 0.2


def test_recall_on_the_embeddings(spark):
    """These vectors are spread evenly over the sphere: neighbours differ in two bits of five, and no share of such
    a radius is selective. The README gives the shares."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    met, near, recall = share_and_recall(np.array([r.embedding for r in rows], np.float64))
    print(f"share of rows through the tables {met:.3f}, reranked {near:.3f}, recall {recall:.3f}")
    assert recall >= 0.9 and near < 0.3


def test_every_code_within_the_radius_is_found():
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 8))
    coder = ann.Coder(x, float(np.linalg.norm(x, axis=1).max()), 400, 5, bits=64)
    index = ann.Index(np.arange(400), x, coder)
    for i in range(20):
        q = coder.query_code(x[i])
        far = ann.hamming(index.codes, q)
        for radius in (0, 3, 4, 9, 20, 40, 64):
            assert sorted(index.within(q, radius)) == np.flatnonzero(far <= radius).tolist()


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [-1.0, 0.0])]
    d = vectors(spark, rows)
    got = ann.search(d, d.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 2, 1.0), (0, 20, 0.5), (0, 9, -1.0), (20, 0, 0.5), (20, 1, 0.5), (20, 2, 0.5), (20, 9, -0.5)]
    assert ann.search(d.where("false"), d).count() == 0
