"""op11, op12 and op13 against plain versions, on odd rows and on layouts that the field has not seen."""

import hashlib
import html
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from pointspark.llm import op11_collocations as op11
from pointspark.llm import op12_html as op12
from pointspark.llm import op13_merkle as op13
from pointspark.llm import queries as q


def plain_collocations(docs, max_words=3, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            own = f.setdefault(lang, Counter())
            for k in range(1, max_words + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    most[p[i : i + size]] = max(most[p[i : i + size]], a)
        rows = []
        for p, a in found.items():
            if 100 * most[p] >= covered * a:
                continue
            score, _, l, r = min((int(Fraction(10**6 * a * a, own[p[:k]] * own[p[k:]])), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "min_count": 3, "top": 40}, {"max_words": 2, "covered": 90}])
def test_op11_equals_plain_version(documents, options):
    names = {"min_count": "least"}
    want = plain_collocations([(r["lang"], r["text"]) for r in documents.collect()], **{names.get(k, k): v for k, v in options.items()})
    assert want and sorted(map(tuple, op11.collocations(documents, **options).collect())) == want


def test_op11_small_tables_and_bitmaps_change_nothing(documents, monkeypatch):
    """Counts sent on early, and a bitmap so small that most hashes meet another."""
    want = sorted(map(tuple, op11.collocations(documents).collect()))
    counts = op11.counts
    monkeypatch.setattr(op11, "counts", lambda docs, k, known: counts(docs, k, known, at_once=50))
    monkeypatch.setattr(op11, "bitmap", lambda frequent, k: op11.Bitmap(16, {0: b"\xff" * 8192}))
    assert sorted(map(tuple, op11.collocations(documents).collect())) == want


def test_op11_emits_only_what_may_be_frequent(spark):
    docs = spark.createDataFrame([("en", "a b c. a b d. x y")] * 10, "lang string, text string")
    known = op11.bitmap(spark.createDataFrame([("en", "a", 20), ("en", "b", 20)], "lang string, phrase string, f long"), 1)
    assert [tuple(r) for r in op11.counts(docs.repartition(3), 2, known).collect()] == [("en", "a b", 20)]


def test_op11_odd_rows(spark, odd, none):
    got = sorted(map(tuple, op11.collocations(odd).collect()))
    assert got == plain_collocations([(r["lang"], r["text"]) for r in odd.collect()])
    assert ("en", "word word word") in {(r[0], r[2]) for r in got}
    assert op11.collocations(none).count() == 0
    clash = odd.select("lang", "text", *[odd["n_chars"].alias(c) for c in ("phrase", "f", "k", "w", "a", "n", "rank", "score", "cut")])
    assert sorted(map(tuple, op11.collocations(clash).collect())) == got
    large = 10**9
    spark_side = spark.range(1).selectExpr(f"CAST({large} AS DECIMAL(15,0)) AS a", f"CAST({3 * large} AS DECIMAL(15,0)) AS l")
    assert spark_side.selectExpr("CAST(a * a AS DECIMAL(30,0)) * CAST(1000000 AS DECIMAL(8,0)) div CAST(l * l AS DECIMAL(30,0)) AS s").first()[0] == 111111


def article(page):
    """The article of a test page, by its own markup."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", inner)]
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return op12.train(pages.filter("page_id % 2 = 0"))


def test_op12_held_out_pages(pages, model):
    held = {r["page_id"]: r["html"] for r in pages.filter("page_id % 2 = 1").collect()}
    got = op12.extract(pages.filter("page_id % 2 = 1"), model).collect()
    assert len(got) == len(held) > 100
    assert all(r["text"] == article(held[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_op12_held_out_layouts(pages, model):
    """Other pages, laid out by other draws: nearly every block gets its label."""
    htmls = [r["html"] for r in pages.filter("page_id % 2 = 1").orderBy("page_id").limit(40).collect()]
    laid = op12.training_pages(htmls, 5, seed=77)
    wrong = sum(a != bool(y) for blocks, labels in laid for a, y in zip(model.main(blocks), labels, strict=True))
    assert wrong < 0.01 * sum(len(b) for b, _ in laid)


LONG = [" ".join(f"Word{i} and{j} more" for j in range(12)) + "." for i in range(4)]


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='site-hdr'><a href=/>Site</a></div><div class='td-post'><h1>Some title here</h1><p>{0}</p><p>{1}</p><div class='ad-slot'><p>{3}</p></div><p>{2}</p></div><div class='user-comments'><p>{3}</p></div></body>",
        "<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>My site</h1><nav><a>One</a> <a>Two</a></nav></header><main><h1>Some title here</h1><p>{0}</p><p>{1}<p>{2}<section id='comments'><h2>Comments</h2><p>{3}</p></section></main><footer>f</footer>",
        "<body><div id=top><a>Menu</a></div><aside class='sidebar'><h3>More</h3><p>{3}</p></aside><article><h1>Some title here</h1>{0}<br><p>{1}</p><script>x='</p>'</script><p>{2}</p></article><form><p>{3}</p><input></form><div class=cookie-notice>{3}</div></body>",
    ],
)
def test_op12_other_templates(model, page):
    blocks = op12.blocks_of(page.format(*LONG))
    assert [b.text for b, y in zip(blocks, model.main(blocks), strict=True) if y] == ["Some title here", *LONG[:3]]


def test_op12_blocks():
    texts = lambda h: [b.text for b in op12.blocks_of(h)]
    assert texts("<p>a&amp;amp; b<br>c<b>d</b>\n e<p>f<div>g<ul><li>h<li>i</ul>j") == ["a&amp; b cd e", "f", "g", "h", "i", "j"]
    assert texts("<head><title>x</title><body>a<script>b<p></script><!-- c --><noscript>d</noscript>e") == ["ae"]
    assert texts("<head><title>x</title><div>a</div>") == ["a"]
    assert texts("</p></div>a</b><table><tr><td>1<td>2<tr><th>3</table>&#955;&nbsp;") == ["a", "1", "2", "3", "λ"]
    assert texts("a < b &lt;c> <") == ["a < b <c> <"] and texts("") == texts(None) == []
    (one,) = op12.blocks_of('<div class="postContent main-2"><a id="x">ab</a> cd')
    assert one.path == (("div", ("post", "content", "main")), ("a", ("x",))) and one.linked == 0.4


def test_op12_viterbi_is_the_best_path(model):
    import itertools

    blocks = op12.blocks_of("<nav><a>x</a></nav><article><h1>T</h1><p>some text of it.</p><div class=ad>buy</div></article><div>z</div>")

    def score(labels):
        s = 0.0
        for t, y in enumerate(labels):
            s += y * sum(model.weights.get(f, 0.0) for f in op12.path_features(blocks[t].path) + op12.text_features(blocks, t))
            s += model.change[op12.same_place(blocks[t - 1], blocks[t])][labels[t - 1]][y] if t else 0.0
        return s

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert [int(y) for y in model.main(blocks)] == list(best)


def test_op12_odd_rows(spark, model, pages):
    body = f"<article><p>{LONG[0]}</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n"), (None, "u", body), (4, "u", body), (4, "u", body), (5, "u", "<article>" + f"<p>{LONG[1]}</p>" * 3000)]
    df = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in op12.extract(df, model).collect()), key=repr)
    long = "\n\n".join([LONG[1]] * 3000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "", 0), (0, "u", LONG[0], len(LONG[0])), (4, "u", LONG[0], len(LONG[0])), (4, "u", LONG[0], len(LONG[0])), (5, "u", long, len(long))], key=repr)
    none = df.limit(0)
    assert op12.extract(none, op12.train(none)).count() == 0
    assert op12.train(pages, train_pages=10) == op12.train(pages.repartition(7), train_pages=10)  # whatever the order of rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def raised(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    leaf = lambda r, text: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
    trees = {}
    for r in rows:
        lower = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        met = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]) if lower else r["text"]
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, met)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: raised([t[2] for t in sorted(trees[x])]) for x in langs}
    top, out = raised([levels[x][-1][0] for x in langs]), []
    for j, lang in enumerate(langs):
        for i, (some, doc, own, met) in enumerate(sorted(trees[lang])):
            path = []
            for tree, at in ((levels[lang], i), (top, j)):
                for nodes in tree[:-1]:
                    run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                    path.append((run[: at % 8], run[at % 8 + 1 :]))
                    at //= 8
            proof, root = h(*[x for a, b in path for x in a + b]), top[-1][0]
            for a, b in path:
                met = h(*a, met, *b)
            out.append((doc if some else None, own, levels[lang][-1][0], root, proof, met, met == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_op13_equals_plain_version(documents):
    got = op13.manifest(documents).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(documents.collect())
    assert {r["verified"] for r in got} == {True, False}


def test_op13_many_rows_and_groups(spark):
    """Trees of several blocks and of one leaf, ends of every kind, and more groups than a run has nodes."""
    sizes = {None: 1, "a": 4096, "b": 4097, "c": 9001, "é": 64, "z": 7} | {f"g{i:02}": i + 1 for i in range(60)}
    rows = [(d * 7, "T", lang, None if d % 5 else "s", d) for lang, n in sizes.items() for d in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = op13.manifest(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(df.collect())


def test_op13_odd_rows(odd, none):
    clash = odd.select("*", *[odd["n_chars"].alias(c) for c in ("key", "grp", "leaf", "met", "g", "tree", "at", "block", "size", "root", "_p")])
    want = plain_manifest(odd.collect())
    for df in (odd, clash):
        assert sorted(map(tuple, op13.manifest(df).select(*COLUMNS).collect()), key=repr) == want
    assert op13.manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 512, 513, 700, 4095, 4096])
def test_op13_traversal(n):
    """Every path leads to the root; the traversal holds a few subtrees, not the block."""
    leaves = [op13.h(b"%d" % i) for i in range(n)]
    height = op13.height_of(n)
    root = op13.block_root(leaves, height)
    assert root.decode() == raised([x.decode() for x in leaves])[-1][0]
    paths = list(op13.traverse(leaves, height))
    assert len(paths) == n and all(len(p) == height and op13.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))


def test_queries_take_whole_tables(spark, sf):
    assert q.op12_html_extraction(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
