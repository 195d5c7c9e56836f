"""Splitting, fusion, markup, encoding, mixing and residue."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doctax.llm import chunking, encoding, fusion, markup, mixing, prefix, residue


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#。\r 你\U0001f600", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_keep_limit_and_overlap(text, most, over):
    pieces = chunking.split_points(text, most, over)
    assert all(b - a <= most for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        assert end - start == over or start == 0
    assert (len(pieces) > 1) == (len(text) > most)


def test_cuts_prefer_strong_boundaries():
    text = "word " * 40 + "end.\n\n## Next part\n" + "word " * 40
    (_, first), (second, _) = chunking.split_points(text, 260, 0)
    assert first == second and text[first:].startswith("## Next part")


def test_split_oversized(spark):
    rows = [(1, None), (2, ""), (3, "x" * 10), (4, "é" * 11), (4, "é" * 11), (5, "\U0001f600" * 10), (6, "a b\n" * 40_000)]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("start", F.lit("clash"))
    got = chunking.split_oversized(df, "id", "t", 10, 2).collect()
    assert {r.id for r in got} == {4, 6}
    assert sum(1 for r in got if r.id == 4) == 2
    assert chunking.split_oversized(df.limit(0), "id", "t", 10, 2).count() == 0


def test_pieces_of_an_id_with_two_texts_are_of_one(spark):
    rows = [(1, "word " * 30), (1, "other things here " * 9), (1, "short"), (2, "aaaa bbbb " * 4), (2, "cccc dddd " * 4), (None, "x y " * 20)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(4)
    for with_text in (True, False):
        by = {}
        for r in chunking.split_oversized(df, "id", "t", 35, 5, with_text).collect():
            by.setdefault(r.id, []).append(r)
        assert set(by) == {1, 2, None}
        for i, pieces in by.items():
            pieces.sort(key=lambda r: r.piece_no)
            size = max(len(t) for k, t in rows if k == i)
            assert pieces[0].start == 0 and pieces[-1].end == size and all(x.end - y.start == 5 for x, y in zip(pieces, pieces[1:]))
            if with_text:
                whole = pieces[0].piece + "".join(r.piece[5:] for r in pieces[1:])
                assert (i, whole) in rows


def test_cuts_find_a_boundary_after_more_pieces():
    text = "a" * 30 + " " + "b" * 95 + " " + "c" * 40
    pieces = chunking.split_points(text, 100, 0)
    assert all(text[a - 1].isspace() for a, _ in pieces[1:])
    blanks = "x" * 50 + " " * 900 + "y" * 50
    assert all(b - a <= 60 for a, b in chunking.split_points(blanks, 60, 0))


def brute_flow(x, q, p):
    m = len(x)
    pc = np.array([((x < a).sum() + ((x == a).sum() - 1) / 2) / (m - 1) if m > 1 else 0.5 for a in x])
    d = pc[:, None] - pc[None, :]
    pref = lambda v: np.clip((v - q) / (p - q), 0, 1)
    return (pref(d) - pref(-d)).sum(1) / max(m - 1, 1)


def test_flows_equal_pairs():
    rng = np.random.default_rng(0)
    g, v = rng.integers(0, 6, 300), np.round(rng.normal(size=300), 1)
    v[::13] = np.nan
    got = fusion.flows(g, v, 0.05, 0.5)
    for k in range(6):
        at = np.flatnonzero((g == k) & ~np.isnan(v))
        assert np.allclose(got[at], brute_flow(v[at], 0.05, 0.5))
    assert (got[np.isnan(v)] == 0).all()


def test_light_and_heavy_groups_agree(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else str(i % 7), i, rng.choice([None, float("nan"), round(rng.random(), 2)]), rng.random() * 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id bigint, a double, b double").withColumn("extra", F.lit("x"))
    one = {r.id: (r.net_flow, r.place) for r in fusion.outranking(df, ["g"], "id", {"a": 1.0, "b": 2.0}).collect()}
    two = {r.id: (r.net_flow, r.place) for r in fusion.outranking(df, ["g"], "id", {"a": 1.0, "b": 2.0}, light_rows=50).collect()}
    assert one == two and len(one) == 600
    scaled = {r.id: r.place for r in fusion.outranking(df.withColumn("b", F.col("b") * 1e6), ["g"], "id", {"a": 1.0, "b": 2.0}).collect()}
    assert scaled == {i: p for i, (_, p) in one.items()}
    assert fusion.outranking(df.limit(0), ["g"], "id", {"a": 1.0}).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([("k" if i % 5 else None, i, i % 7) for i in range(200)], "k string, i bigint, n bigint")
    got = {r.i: r.s for r in prefix.running_sums(df, ["k"], ["i"], {"s": "n"}).collect()}
    total = {}
    for i in range(200):
        k = i % 5 > 0
        total[k] = total.get(k, 0) + i % 7
        assert got[i] == total[k]


ODD = ["", " ", "a", "don't  stop\n\n\n x", "<|endoftext|> is text", "  lead and trail  ", "é́ 你好世界 " * 30, "a" * 700, "12345 " * 90, "\U0001f468‍\U0001f469‍\U0001f467 " * 20, "x = {'a': 1}\n\tif y:\n" * 40, "\r\n\t \x85\x00z" * 50]


@settings(max_examples=120, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_tree_reduction_equals_whole(text, leaf):
    own = encoding.load("byte_bpe_50k.json")
    assert encoding.encode_part(own, text, leaf).ids() == own.encode(text, add_special_tokens=False).ids


def test_encoding_round_trip(spark):
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "id bigint, t string").withColumn("ids", F.lit("clash"))
    got = {r.id: list(r.ids) for r in encoding.encode_corpus(df, "t", leaf_chars=50).collect()}
    own = encoding.load("byte_bpe_50k.json")
    assert got == {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(ODD)} | {99: []}
    back = encoding.decode_corpus(encoding.encode_corpus(df, "t", leaf_chars=50), "ids", "back")
    assert {r.id: r.back for r in back.collect()} == dict(enumerate(ODD)) | {99: ""}
    assert {r.id: r.n for r in encoding.encode_corpus(df, "t", "n", count_only=True).collect()} == {i: len(v) for i, v in got.items()}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 300))
def test_budget_is_the_best_reachable(counts, budget):
    lengths, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    taken = mixing.fit_budget(lengths, n, budget)
    reach = {0}
    for length, k in counts.items():
        reach = {r + j * length for r in reach for j in range(k + 1)}
    assert (taken <= n).all() and (taken >= 0).all()
    assert int((taken * lengths).sum()) == max(r for r in reach if r <= budget)


def test_budget_far_from_the_window():
    rng = np.random.default_rng(0)
    lengths, counts = np.arange(1, 400), rng.integers(1, 50, 399)
    budget = int((lengths * counts).sum() * 0.6)
    taken = mixing.fit_budget(lengths, counts, budget, window=500)
    assert int((taken * lengths).sum()) == budget and (taken <= counts).all()


def test_mixing(spark):
    rows = [(i, "big" if i % 10 else "small", i % 40 + 1) for i in range(2000)] + [(5000, None, 9), (5001, "other", 9), (5002, "big", 0), (5003, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 2), ("off", None, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix_sources(docs, targets, "n", seed=4)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].reached_share - 2 / 3) < 1e-3 and abs(got["small"].reached_share - 1 / 3) < 1e-3
    assert got["gone"].reached_tokens == 0 and got["small"].most_repeats <= 3 and got["big"].most_repeats <= 1
    ids = chosen.collect()
    assert len({r.doc_id for r in ids}) == len(ids) and not {5000, 5001, 5002, 5003} & {r.doc_id for r in ids}
    again, _ = mixing.mix_sources(docs.repartition(7), targets, "n", seed=4)
    assert sorted(map(tuple, ids)) == sorted(map(tuple, again.collect()))
    assert mixing.mix_sources(docs.limit(0), targets, "n")[0].count() == 0


MARKS = [
    ("# Head\n\ntext", {"markdown"}), ("Head\n====\n\ntext", {"markdown"}), ("a **b** c", {"markdown"}), ("see [a](b.md)", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}),
    ("```\n<b>x</b> \\section{y}\n```", {"markdown"}), ("* one\n* two", {"markdown"}), ("== H ==\n* one\n# two", {"wiki"}), ("see [[Risk list|x]]", {"wiki"}), ("{| class=\"x\"\n|-\n| a || b\n|}", {"wiki"}),
    ("''it'' is", {"wiki"}), ("<p>a</p>", {"html"}), ("R&amp;D", {"html"}), ("<!-- x --> y", {"html"}), ("# H\n<br>\ntext", {"html", "markdown"}), ("\\section{A} text", {"latex"}), ("so $x_1 = 2$ holds", {"latex"}),
    ("<pre># no\n**no**</pre>", {"html"}), ("\\begin{verbatim}\n# no <b>x</b>\n\\end{verbatim}", {"latex"}),
    ("", set()), (" \n ", set()), ("R&D and a<b and b>c", set()), ("27 * 3 is 81 and 2_27; Accuracy* and (*measured", set()), ("It cost $4,700 instead of $76,600.", set()),
    ("C:\\audit\\run_50\\part_16 and risk_score_v30", set()), ("issue #71 and form #2 [sic] item [9]", set()), ("HEADING\n\n1.2 Part\n\n(a) item", set()), ("9~17 -- or better --", set()),
]


@pytest.mark.parametrize("text,want", MARKS)
def test_marks(text, want):
    assert markup.find_marks(text) == want
    assert markup.find_marks(text.replace("\n", "\r\n")) == want


def test_clean_text_keeps_structure():
    page = "<html><head><title>T</title><script>x=1<2</script></head><body><h2>Part</h2><p>a&nbsp;b <b>c</b></p><ul><li>one<li>two</ul><table><tr><th>k<th>v</tr><tr><td>x<td>1</tr></table><pre><code>if a &lt; 1:\n  # no\n</code></pre></body></html>"
    clean, found = markup.clean_text(page)
    assert found == ["html"]
    for part in ("# T", "## Part", "a b c", "- one", "- two", "| k | v |", "| x | 1 |", "```\nif a < 1:\n  # no\n```"):
        assert part in clean, part
    clean, _ = markup.clean_text("\\section{A}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{equation}\nx > 1\n\\end{equation}\nb~\\cite{k} \\emph{c}")
    for part in ("## A", "- one", "$$x > 1$$", "b  c"):
        assert part in clean, part
    clean, _ = markup.clean_text("== A ==\n* one\n[[x|two]] ''three''")
    assert clean == "## A\n- one\ntwo three"


def test_tree_matching_and_templates(spark):
    memo = {}
    shapes = {}
    a, b = (markup.parse_page(x, shapes) for x in ("<div><p>a</p><p>b</p><ul><li>c</li></ul></div>", "<div><p>a</p><ul><li>d</li><li>e</li></ul></div>"))
    assert markup.match_trees(a, b, memo) == 1 + 1 + 2 + 3
    assert dict((w, o) for _, w, o in markup.mapped_texts(a, b, memo))["c"] in ("d", "e")
    pages = [(i, f"<nav><a>Home</a></nav><p>text {i}</p>" if i else "<nav><a>Home</a></nav><p>first</p>", "h") for i in range(6)] + [(10, None, "h"), (11, "plain", None), (12, "<p>one</p>", "k"), (13, "", "h")]
    df = spark.createDataFrame(pages, "id bigint, c string, host string")
    got = {r.id: (r.clean, r.markup) for r in markup.clean_markup(df, "id", "c", "host").collect()}
    assert got[1] == ("text 1", ["html"]) and got[12] == ("one", ["html"]) and got[11] == ("plain", []) and got[13] == ("", []) and 10 not in got
    assert markup.clean_markup(df.limit(0), "id", "c", "host").count() == 0


def test_template_of_pages_that_are_not_the_richest(spark):
    rich = [(i, f"<h1>Part {i}</h1><ul><li>point {i}</li></ul><table><tr><td>{i}</td></tr></table>" + f"<p>text <b>no {i}</b></p>" * (i % 4 + 1), "h") for i in range(30)]
    plain = [(100 + i, "<nav><a>Home</a><a>List</a></nav>" + "".join(f"<p>words {i} {j}</p>" for j in range(i % 5 + 1)), "h") for i in range(10)]
    copies = [(200 + i, "<section><p>Equal pages are one page</p></section>", "h") for i in range(6)]
    df = spark.createDataFrame([*rich, rich[0], rich[0], *plain, *copies], "id bigint, c string, host string").repartition(3)
    got = {r.id: r.clean for r in markup.clean_markup(df, "id", "c", "host").collect()}
    assert not any("Home" in c or "List" in c for c in got.values())
    assert all(got[100 + i].startswith(f"words {i} 0") for i in range(10)) and got[203] == "Equal pages are one page" and "# Part 7" in got[7]


def _tree(rng, depth):
    return f"<{(t := rng.choice('bius'))}>" + "".join(_tree(rng, depth - 1) if depth and rng.random() < 0.6 else "x" for _ in range(rng.randint(0, 3))) + f"</{t}>"


def test_mapping_is_the_largest_and_keeps_order(monkeypatch):
    def best(a, b):
        if a.tag != b.tag:
            return 0
        rows = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + best(x, y))
        return 1 + rows[-1][-1]

    rng = random.Random(4)
    for k in range(150):
        if k == 100:  # a band as wide as the rows changes nothing
            monkeypatch.setattr(markup, "FULL_ROWS", 0)
        shapes, memo = {}, {}
        a, b = (markup.parse_page("".join(_tree(rng, 3) for _ in range(rng.randint(1, 5))), shapes) for _ in range(2))
        assert markup.match_trees(a, b, memo) == best(a, b)
        place = {id(c): j for j, c in enumerate(b.children)}
        pairs = sorted((i, place[id(y)]) for i, _, y in markup._mapped(a.children, b.children, memo))
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
        assert sum(best(a.children[i], y) for i, _, y in markup._mapped(a.children, b.children, memo)) == best(a, b) - 1
    monkeypatch.setattr(markup, "BAND", 3)
    one, two = (markup.parse_page("".join(f"<p>{i}</p><b>x</b>" for i in range(n)), {}) for n in (300, 290))
    assert markup.match_trees(one, two, {}) > 500


def test_long_rows_of_children_are_aligned_whole(spark, monkeypatch):
    long = lambda i, p, h: "".join(f"<p>words {i} {j}</p>" for j in range(p)) + "<div><a>Home</a></div>" + "".join(f"<h2>part {i} {j}</h2>" for j in range(h))
    shapes = {}
    one, two = (markup.parse_page(long(0, *n), shapes) for n in ((1500, 300), (300, 1500)))
    assert markup.match_trees(one, two, {}) == 1 + 2 * 300 + 3 + 2 * 300
    texts = list(markup.mapped_texts(one, two, {}))
    assert len(texts) == 601 and ("Home", "Home") in {(w, o) for _, w, o in texts}
    pages = [(i, long(i, *n), "h") for i, n in enumerate(((1800, 100), (1200, 700), (700, 1200), (100, 1800)))]
    got = markup.clean_markup(spark.createDataFrame(pages, "id bigint, c string, host string"), "id", "c", "host").collect()
    assert len(got) == 4 and all("Home" not in r.clean and f"words {r.id} 99" in r.clean and f"# part {r.id} 99" in r.clean for r in got)

    rng = random.Random(5)
    for _ in range(60):  # the same mapping, whichever rows and pairs are kept
        shapes = {}
        a, b = (markup.parse_page("".join(_tree(rng, 3) for _ in range(rng.randint(1, 30))), shapes) for _ in range(2))
        found = []
        for full, band, pairs in ((1_000_000, 256, 1_000_000), (0, 256, 1_000_000), (0, 2, 1_000_000), (9, 3, 1)):
            for name, value in (("FULL_ROWS", full), ("BAND", band), ("MEMO_PAIRS", pairs)):
                monkeypatch.setattr(markup, name, value)
            found.append((markup.match_trees(a, b, {}), list(markup.mapped_texts(a, b, {}))))
        assert all(x == found[0] for x in found)


def test_marks_of_the_template_are_apart(spark):
    pages = [(i, f"<nav>[[Home]]</nav><p>text {i}</p># not a list {i}\n* part", "h") for i in range(5)] + [(9, "<nav>[[Home]]</nav><p>[[Risk|x]]</p>\n# one\n# two", "h")]
    got = {r.id: r.markup for r in markup.clean_markup(spark.createDataFrame(pages, "id bigint, c string, host string"), "id", "c", "host").collect()}
    assert got[1] == ["html", "markdown", "wiki"] and got[9] == ["html", "wiki"]


def test_markup_without_caps():
    deep = "<div>" * 1500 + "inner" + "</div>" * 1500
    assert markup.clean_text(deep)[0] == "inner"
    long = "\\[" + "x + " * 500 + "y\\]"
    assert markup.find_marks(long) == {"latex"} and markup.clean_text("\\emph{a \\textbf{b \\emph{c \\textit{d \\emph{e}}}}}")[0] == "a b c d e"
    assert markup.find_marks("\\usepackage[" + "a," * 300 + "b]{c}") == {"latex"}


RESIDUE = ["Error 404: Page not found", "Dear {{name}}, welcome.", "This policy is owned by [insert name here].", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet", "Traceback (most recent call last):", "Contact <Add department> please", "找不到页面。"]
PROSE = ["The message \"access denied\" must not reveal why records are locked.", "Names in square brackets are placeholders and the editor fills them.", "The annex [see item 9] and the table [404] describe records.", "The notice that JavaScript is required must be offered in every language.", "It cost $4,700 instead of $76,600.", "total += 1"]


def test_places_without_common_marks():
    alone = ["Fragen bitte an TT.MM.JJJJ.", "due DD-MM-YYYY", "since yyyy-mm-dd", "on XX.XX.20XX", "The next review takes place on «company».", "signed ........", "at 〈insert name〉", "in 《请填写名称》"]
    assert [residue.features(p, {})[1] for t in alone for p in residue.passages(t)] == [True] * len(alone)
    assert not any(residue.features(p, {})[1] for p in ("He waited...", "max. 30 mm. Then", "a well-known «good old» rule"))


def test_residue(spark):
    rng = random.Random(1)
    subject, verb, thing = ["The board", "Each editor", "The records unit"], ["keeps", "reviews", "describes", "offers"], ["records in every language", "the annex and the table", "why records are locked", "names and notices", "placeholders and brackets"]
    normal = [f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} before item {i}." for i in range(600)]
    rows = [(i, " ".join(normal[i : i + 3])) for i in range(500)] + [(1000 + i, f"{normal[i]} {t}") for i, t in enumerate(PROSE)] + [(2000 + i, f"{normal[i]}\n{t}") for i, t in enumerate(RESIDUE)] + [(1, None), (2, ""), (3, " \n")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("odds", F.lit("clash"))
    scores = residue.residue_scores(df, "id", "t")
    found = {r.id for r in scores.where("residue_count > 0").collect()}
    assert {2000 + i for i in range(len(RESIDUE))} <= found
    assert len(found) <= len(RESIDUE) + 2
    assert residue.residue_scores(df.limit(0), "id", "t").count() == 0
