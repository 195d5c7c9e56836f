import numpy as np
import pytest
from pyspark.sql import functions as F

from doctax.operators import catalog, chunk, context, enrich, evaluate, expand, ground, merge, mining, retrieval
from doctax.operators import select as decide

MAPPED = "id string, name string, description string, concern string, risk_type string, isdefinedbytaxonomy string, ispartof string, " + ", ".join(f"{m} array<string>" for m in catalog.MAPPINGS)


def entry(id_, name="n", parent=None, taxonomy="t", risk_type=None, **maps):
    return (id_, name, "d", None, risk_type, taxonomy, parent, *(maps.get(m.split("_")[0]) for m in catalog.MAPPINGS))


def test_expansion_edges_are_symmetric_and_inside(spark):
    rows = spark.createDataFrame([entry("a", parent="p"), entry("b", parent="p"), entry("c", close=["a", "zz"]), entry("d", exact=[])], MAPPED)
    got = {(r.src, r.dst) for r in catalog.expansion_edges(rows).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "a"), ("a", "c")}


def test_collapse_and_expand_variants(spark):
    rows = spark.createDataFrame([entry("x---b", "Name - B"), entry("x---a", "Name - A"), entry("y", "Y")], MAPPED)
    got = {r.id: r for r in catalog.collapse_variants(rows).collect()}
    assert set(got) == {"x", "y"} and got["x"].name == "Name (2 variants)" and got["x"].description == "a, b"
    cands = spark.createDataFrame([(1, "x"), (2, "y")], "candidate_id bigint, risk_id string")
    assert sorted(r.risk_id for r in ground.expand_variants(cands, catalog.variants(rows)).collect()) == ["x---a", "x---b", "y"]


def test_agentic_entries_need_a_document_on_agents(spark):
    rows = spark.createDataFrame([entry("a", risk_type="agentic"), entry("b")], MAPPED)
    quiet = spark.createDataFrame([("nothing",), (None,)], "text string")
    loud = spark.createDataFrame([("An AI Agent acts",)], "text string")
    assert catalog.prune_agentic(rows, quiet).count() == 1
    assert catalog.prune_agentic(rows, loud).count() == 2
    assert catalog.prune_agentic(rows, quiet.limit(0)).count() == 1


def test_crosswalk(spark):
    rows = spark.createDataFrame([entry("h1", taxonomy="home", close=["o1", "h2"]), entry("h2", taxonomy="home"), entry("o1"), entry("o2", broad=["h2"])], MAPPED)
    assert {(r.risk_id, r.home_id) for r in catalog.crosswalk(rows, "home").collect()} == {("o1", "h1"), ("o2", "h2")}


def test_bm25_repeated_words_and_ties(spark):
    corpus = spark.createDataFrame([("a", "red fox"), ("b", "blue fox"), ("c", "green hen"), ("d", "grey owl")], "id string, text string")
    asked = spark.createDataFrame([(1, "red red"), (2, "red"), (3, "zzz"), (4, "")], "query_id bigint, text string")
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(corpus, asked, 5).collect()}
    assert set(got) == {(1, "a"), (2, "a")} and abs(got[(1, "a")] - 2 * got[(2, "a")]) < 1e-5


def test_bm25_matrix_equals_join(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 30, n))
    corpus = spark.createDataFrame([(f"e{i:02}", word(12)) for i in range(25)] + [("e99", "")], "id string, text string")
    asked = spark.createDataFrame([(i, word(9)) for i in range(40)] + [(90, None), (91, "")], "query_id bigint, text string")
    one, two = (sorted(map(tuple, retrieval.bm25(corpus, asked, 5, cells).collect())) for cells in (10_000, 0))
    assert one == two and len(one) == 200


def test_dense_equals_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 8))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(50)] + [(99, None)], "id bigint, v array<double>")
    got = retrieval.dense(rows, rows.where("id < 3"), 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        s = np.round(u @ u[q], 6)
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] == list(np.lexsort((np.arange(50), -s))[:4])


def cands(spark, rows):
    return spark.createDataFrame(rows, "g int, candidate_id bigint, bm25_rank int, embedding_distance double, cross_encoder_score double, rrf_score double, decision string")


def test_rrf_is_symmetric_and_keeps_single_lists(spark):
    rows = cands(spark, [(1, 1, 1, 0.5, None, None, None), (1, 2, 0, 0.1, None, None, None), (1, 3, 2, None, None, None, None), (1, 4, None, float("nan"), None, None, None)])
    got = {r.candidate_id: r.rrf for r in retrieval.rrf_fuse(rows, ["g"], "candidate_id").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == round(1 / 61 + 1 / 62, 6) and got[2] == round(1 / 61, 6) and got[3] == round(1 / 62, 6)


def test_classification_partitions(spark):
    score = [0.85, 0.70, 0.50, 0.30, 0.10]
    rows = cands(spark, [(1, i, 5 if i == 4 else 0, None, s, None, None) for i, s in enumerate(score)] + [(1, 9, None, None, float("nan"), None, None)])
    got = {r.candidate_id: r["class"] for r in decide.by_rank(rows, ["g"], "candidate_id", 2, 1, 0.2, 10).collect()}
    assert got == {0: "accepted", 1: "accepted", 2: "borderline", 3: "discarded", 4: "borderline", 9: "discarded"}
    got = {r.candidate_id: r.c for r in rows.select("candidate_id", decide.by_threshold(0.7, 0.15).alias("c")).collect()}
    assert got[1] == "accepted" and got[3] == "borderline" and got[4] == "discarded" and got[9] == "discarded"


def test_section_groups(spark):
    rows = [(1, i, s) for i, s in enumerate([None, "A", None, "A", "B", "B", "B", "B", "B", "B"])]
    got = {r.i: (r.run, r.part) for r in context.section_groups(spark.createDataFrame(rows, "d int, i int, section string"), ["d"], "i").collect()}
    assert [got[i][0] for i in range(10)] == [1, 2, 2, 2, 3, 3, 3, 3, 3, 3]
    assert [got[i][1] for i in range(10)] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def greedy_context(chunks, i, budget):
    size = [len(c[1].split()) for c in chunks]
    left, b, a, ob, oa, turn = budget - size[i], i - 1, i + 1, True, True, 0
    taken = [i]
    while left > 0 and (ob or oa):
        if turn % 2 == 0 and ob:
            if b >= 0 and size[b] <= left:
                taken.append(b)
                left -= size[b]
                b -= 1
            else:
                ob = False
        elif turn % 2 == 1 and oa:
            if a < len(chunks) and size[a] <= left:
                taken.append(a)
                left -= size[a]
                a += 1
            else:
                oa = False
        turn += 1
    parts = []
    for k in sorted(taken):
        if k > min(taken) and chunks[k][0] and chunks[k][0] != chunks[k - 1][0]:
            parts.append(f"## {chunks[k][0]}")
        parts.append(chunks[k][1])
    return "\n\n".join(parts)


@pytest.mark.parametrize("budget", [3, 9, 25, 60])
def test_contexts_equal_the_rule(spark, budget):
    rng = np.random.default_rng(budget)
    chunks = [(rng.choice(["A", "B", None]), " ".join(["w"] * rng.integers(1, 9)) + str(i)) for i in range(25)]
    rows = spark.createDataFrame([("d", i, s, t) for i, (s, t) in enumerate(chunks)] + [("e", 0, None, " ")], "d string, i int, section string, text string")
    got = {r.i: r.context for r in context.contexts(rows, ["d"], "i", budget).where("d = 'd'").collect()}
    assert got == {i: greedy_context(chunks, i, budget) for i in range(25)}


def test_plain_chunks_join_to_the_text():
    text = ("line of words\n" * 400) + "x" * 5000
    pieces = chunk.plain_pieces(text, 100)
    assert "".join(pieces) == text and max(map(len, pieces)) <= 400 and pieces[0].endswith("\n")
    assert chunk.plain_pieces("") == [""]


def test_table_text():
    text = chunk.table_text(["a"], [["1", "2"], ["3"]], 2, "cap")
    assert "a: 1\ncol_1: 2" in text and "a: 3\ncol_1: \n" in text and text.startswith("<!-- table: cap -->")


def test_merge_and_evidence(spark):
    rows = spark.createDataFrame([("r", 1, 0.8, "x"), ("r", 2, 0.9, "y"), ("r", 3, 0.9, "z")], "risk_id string, id bigint, confidence double, o string")
    got = merge.merge_best(rows, ["risk_id"], "id", ["o"]).first()
    assert (got.id, got.confidence, got.n_matches) == (2, 0.9, 3)
    spans = spark.createDataFrame([("r", i, 0.5, t, s) for i, (t, s) in enumerate([("a", 0.1), ("a", 0.9), ("b", 0.5), ("c", None), ("d", 0.7), (None, 1.0)])], "risk_id string, id bigint, confidence double, text string, score double")
    assert [r.text for r in sorted(merge.cap_evidence(spans, ["risk_id"], "id").collect(), key=lambda r: r.place)] == ["d", "b", "a"]


def test_siblings_and_groups(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("p", "q")], "src string, dst string")
    found = spark.createDataFrame([("a",), ("b x",), ("p---v",)], "risk_id string")
    known = spark.createDataFrame([("b",), ("c",), ("q",)], "id string")
    got = expand.expand_siblings(found, edges, known)
    assert {(r.risk_id, r.source_risk_id) for r in got.collect()} == {("c", "a"), ("q", "p---v")}
    near = spark.createDataFrame([("a", i) for i in range(50)], "risk_id string, chunk_id bigint")
    parents = spark.createDataFrame([("c", None), ("a", "P")], "id string, ispartof string")
    rows = expand.grounding_groups(got, near, parents, max_chunks=5).collect()
    assert [(r.parent, r.risk_ids, r.chunk_ids) for r in rows] == [("P", ["c"], [0, 1, 2, 3, 4])]


def test_enrichment(spark):
    index = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h2", "y"), ("r0", "z")], "risk_id string, action_id string")
    cross = spark.createDataFrame([("r1", "h2"), ("r1", "h1"), ("r0", "h1")], "risk_id string, home_id string")
    risks = spark.createDataFrame([("r0",), ("r1",), ("r2",)], "risk_id string")
    assert {(r.risk_id, r.action_id, r.via) for r in enrich.actions_of(risks, index, cross).collect()} == {("r0", "z", "r0"), ("r1", "x", "h1"), ("r1", "y", "h2")}
    filled = enrich.filled(risks.withColumn("t", F.when(F.col("risk_id") == "r2", "kept")), spark.createDataFrame([("h2", "v2")], "risk_id string, value string"), cross, "t")
    assert {r.risk_id: r.t for r in filled.collect()} == {"r0": None, "r1": "v2", "r2": "kept"}


def test_scores_and_sweep(spark):
    a = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "y")], "g string, i string")
    b = spark.createDataFrame([("p", "y"), ("p", "z"), ("q", "z")], "g string, i string")
    got = {r.g: r for r in evaluate.scored(evaluate.compared(a, b, ["g", "i"]), ["g"]).collect()}
    assert (got["p"].matched, got["p"].precision, got["p"].recall) == (1, 0.5, 0.5) and got["q"].f1 == 0.0
    pairs = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)], "label int, score double")
    assert evaluate.auc_trapz(pairs).first().auc == round(5 / 6, 6)
    assert evaluate.auc_trapz(pairs.where("label = 1")).first().auc == 0.0
    best = evaluate.best_threshold(evaluate.threshold_sweep(pairs)).first()
    assert best.f1 == round(6 / 7, 6)


def test_name_matching(spark):
    rows = [("d", "predicted", "chat bot service"), ("d", "expected", "the chat bot service"), ("d", "predicted", "other"), ("d", "expected", "unlike")]
    got = evaluate.match_names(spark.createDataFrame(rows, "g string, side string, name string"), "g").collect()
    assert [(r.predicted, r.expected) for r in got] == [("chat bot service", "the chat bot service")]


def test_negatives(spark):
    pos = spark.createDataFrame([("p", "a")], "g string, i string")
    pool = spark.createDataFrame([("p", x) for x in "abcdefg"], "g string, i string")
    got = mining.hard_negatives(pos, pool, ["g"], "i", 3)
    assert got.count() == 3 and got.where("i = 'a'").count() == 0
    assert {r.i for r in got.collect()} == {r.i for r in mining.hard_negatives(pos, pool.repartition(3), ["g"], "i", 3).collect()}
    scored = spark.createDataFrame([("g", i, i < 13, float(i)) for i in range(20)], "g string, i int, pos boolean, score double")
    assert mining.mined_negatives(scored, ["g"], "i", "pos").count() == 0


def test_grounded_needs_quotes(spark):
    rows = spark.createDataFrame([("a", True, ["q"]), ("b", True, [" "]), ("c", False, ["q"]), ("d", True, None)], "risk_id string, grounded boolean, quotes array<string>")
    assert [r.risk_id for r in ground.grounded(rows).collect()] == ["a"]


def test_quotes_are_located(spark):
    passages = spark.createDataFrame([("g", 1, "a b"), ("g", 2, "b c"), ("g", 3, "c")], "g string, chunk_id bigint, text string")
    quotes = spark.createDataFrame([("g", "r", "c"), ("g", "r", "zz"), ("g", "r", " ")], "g string, risk_id string, quote string")
    assert {r.quote: r.chunk_id for r in ground.located(quotes, passages, "g").collect()} == {"c": 2, "zz": 1}
