import json

import pytest

from doctax.config import RunConfig
from doctax.operators import providers
from doctax.plans import pipeline, registry
from doctax.sources import documents, sinks
from doctax.streaming import ingest

CATALOGUE = "id string, name string, description string, concern string, risk_type string, isdefinedbytaxonomy string, ispartof string"


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("r1", "data leakage", "private data leaves the system", None, None, "t", None), ("r2", "model drift", "quality falls over time", None, "agentic", "t", None), ("r3", "biased hiring", "unfair treatment of people", None, None, "t", None)]
    rows += [(f"x{i}", f"other topic {i}", f"something else {i}", None, None, "t", None) for i in range(5)]
    return spark.createDataFrame(rows, CATALOGUE)


def test_run_from_documents_to_matches(spark, catalogue, tmp_path):
    docs = spark.createDataFrame([(1, "We saw data leakage last year. Private data leaves the system."), (2, " "), (3, None)], "doc_id bigint, text string")
    result = pipeline.run_extraction(docs, catalogue, RunConfig(score_floor=0.1))
    rows = {r.risk_id: r for r in result["merged"].collect()}
    assert "r1" in rows and "r2" not in rows and rows["r1"].quotes and rows["r1"].query_id == "1#0"
    assert "ground" in {r.stage for r in providers.usage(result["calls"]).collect()}
    sinks.write_results(result["merged"], str(tmp_path / "run"))
    assert json.loads((spark.read.text(str(tmp_path / "run/result.json")).first().value))["risks"][0]["risk_id"] == "r1"
    page = sinks.report(result["merged"].select("risk_id", "confidence"), "Run <1>", str(tmp_path / "r.html"))
    assert "Run &lt;1&gt;" in page


def test_run_without_models(spark, catalogue):
    config = RunConfig(use_judge=False, use_grounding=False, expand_siblings=False)
    assert not config.needs_model
    docs = spark.createDataFrame([(1, "biased hiring of people")], "doc_id bigint, text string")
    got = pipeline.run_extraction(docs, catalogue, config)
    assert "calls" not in got and {r.grounding_confidence for r in got["merged"].collect()} <= {"ungrounded"}
    assert pipeline.run_extraction(docs.limit(0), catalogue, config)["merged"].count() == 0


def test_scorer_sees_twice_the_top(spark, catalogue):
    from pyspark.sql import functions as F

    rows = [(f"e{i:02d}", "alpha " * (20 - i) + f"own{i}", "", None, None, "t", None) for i in range(20)]
    docs = spark.createDataFrame([(1, "alpha")], "doc_id bigint, text string")
    late = lambda pairs: pairs.withColumn("cross_encoder_score", F.when(F.col("bm25_rank") > 5, 0.9).otherwise(0.1))
    config = RunConfig(top=5, accept=5, use_judge=False, use_grounding=False, score_floor=0.5)
    got = pipeline.run_extraction(docs, spark.createDataFrame(rows, CATALOGUE), config, scorer=late)
    found = got["candidates"].select("bm25_rank", "class").collect()
    assert {r.bm25_rank for r in found} == set(range(6, 11)) and {r["class"] for r in found} == {"accepted"}


def test_extraction_run_has_the_defaults(spark, monkeypatch):
    from doctax.plans import q_eval

    seen = []
    monkeypatch.setattr(q_eval.t, "table", lambda *a: spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
    monkeypatch.setattr(q_eval.pipeline, "run_extraction", lambda docs, catalogue, config: seen.append(config) or {"merged": spark.createDataFrame([], "risk_id string, query_id string, confidence double, accepted_by string, grounding_confidence string, n_matches bigint")})
    q_eval.extraction_run(spark, "")
    assert (seen[0].top, seen[0].grounding_passes) == (RunConfig().top, RunConfig().grounding_passes)


def test_borderline_is_promoted_without_a_judge(spark, catalogue):
    docs = spark.createDataFrame([(1, "data leakage and biased hiring of people")], "doc_id bigint, text string")
    config = RunConfig(accept=1, use_judge=False, use_grounding=False, score_floor=0.1)
    got = {r.risk_id: r.accepted_by for r in pipeline.run_extraction(docs, catalogue, config)["merged"].collect()}
    assert set(got) >= {"r1", "r3"} and set(got.values()) == {"threshold", "auto_promoted"}


def test_families_siblings_and_chains(spark):
    rows = [("fam---a", "bias in hiring", "unfair hiring", None, None, "t", "h"), ("fam---b", "unjust loan terms", "unfair lending", None, None, "t", "h"), ("s1", "privacy notice", "people are told", None, None, "t", "g"), ("s2", "leakage of data", "data leaves", None, None, "t", "g")]
    rows += [(f"x{i}", f"other topic {i}", f"something else {i}", None, None, "t", None) for i in range(6)]
    entries = spark.createDataFrame([(*r, None, None, None, None, ["s1"] if r[0] == "s2" else None) for r in rows], CATALOGUE + ", exact_mappings array<string>, close_mappings array<string>, broad_mappings array<string>, narrow_mappings array<string>, related_mappings array<string>")
    docs = spark.createDataFrame([(1, "There was leakage of data. A privacy notice was missing."), (2, "We saw bias in hiring (2 variants) of people.")], "doc_id bigint, text string")
    actions = spark.createDataFrame([("s2", "act-1"), ("s2", "act-2")], "risk_id string, action_id string")
    config = RunConfig(score_floor=0.1, accept=1, judge=0, grounding_passes=2, causal_synthesis=True)
    result = pipeline.run_extraction(docs, entries, config, actions=actions)
    got = {r.risk_id: r for r in result["merged"].collect()}
    assert got["s2"].accepted_by == "threshold" and got["s2"].actions == ["act-1", "act-2"] and got["s2"].threat == "leakage of data" and got["s2"].threat_source is None
    assert got["s1"].accepted_by == "expansion" and got["s1"].confidence == 0 and got["s1"].evidence[0].query_id == "1#0" and "privacy notice" in got["s1"].evidence[0].text
    assert "fam" not in got and "fam---b" not in got
    assert {r.stage for r in providers.usage(result["calls"]).collect()} >= {"ground", "expand", "causal"}
    alone = pipeline.run_extraction(docs, entries, RunConfig(score_floor=0.1, accept=1, judge=0, expand_siblings=False))["merged"]
    assert "s1" not in {r.risk_id for r in alone.collect()}


def test_batches_and_passes_of_calls(spark):
    rows = spark.createDataFrame([("q", f"r{i}", "n", "d") for i in range(7)], "query_id string, risk_id string, name string, description string")
    texts = spark.createDataFrame([("q", "text")], "query_id string, text string")
    got = {r.key: json.loads(r.payload) for r in pipeline.payloads(rows, texts, 3, 2).collect()}
    assert set(got) == {f"q@{b}@{p}" for b in range(3) for p in (1, 2)} and [x["risk_id"] for x in got["q@2@1"]["risks"]] == ["r6"]
    assert len(pipeline.payloads(rows, texts, 0).collect()) == 1


def test_generated_queries_reach_every_chunk_of_their_run(spark, catalogue):
    docs = spark.createDataFrame([(1, "We saw data leakage last year.\n" + "filler words here\n" * 200), (2, "nothing that any entry has xyzzy")], "doc_id bigint, text string")
    config = RunConfig(chunk_tokens=256, query_generation=True, use_judge=False, use_grounding=False, score_floor=0.0, top=3)
    result = pipeline.run_extraction(docs, catalogue, config)
    seen = {(r.query_id, r.risk_id): r["class"] for r in result["candidates"].collect()}
    chunks = [r.query_id for r in result["chunks"].where("doc_id = 1").collect()]
    assert len(chunks) > 2 and all(seen.get((q, "r1")) == "accepted" for q in chunks)
    assert "queries" in {r.stage for r in providers.usage(result["calls"]).collect()}


def test_provider_errors_are_rows(spark):
    class Broken:
        def __call__(self, stage, payload):
            raise ValueError("no")

    with pytest.raises(ValueError):
        providers.call_once(Broken(), "judge", {}, 1)

    class Cut:
        def __call__(self, stage, payload):
            if len(payload["text"]) > 700:
                raise providers.Truncated
            return len(payload["text"])

    answer, incidents = providers.call_once(Cut(), "judge", {"text": "x" * 1500})
    assert answer == 540 and incidents == ["output_truncated", "output_truncated"]
    rows = spark.createDataFrame([("a", "{}"), ("b", "not json")], "key string, payload string")
    got = {r.key: r for r in providers.call_model(rows, "judge").collect()}
    assert got["a"].error is None and got["b"].error and got["b"].answer is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.html").write_text("<html><head><title>t</title></head><body><nav>menu</nav><h1>Head</h1><p>one two three four five six seven eight nine ten</p></body></html>")
    (tmp_path / "c.txt").write_text("  ")
    got = {r.source.split("/")[-1]: r.content for r in documents.read_documents(spark, str(tmp_path / "*.*")).collect()}
    assert got["a.txt"] == "plain text" and got["b.html"].startswith("# Head") and "menu" not in got["b.html"] and "c.txt" not in got
    (tmp_path / "map.tsv").write_text("# note\nsubject_id\tsubject_source\tpredicate_id\tobject_id\tobject_source\tmapping_justification\nr1\ts\tskos:exactMatch\tc1\tnist\tx\nr1\ts\tskos:relatedMatch\tc2\tnist\tx\n")
    assert [(r.risk_id, r.category) for r in documents.read_category_map(spark, str(tmp_path / "map.tsv"), ("nist",)).collect()] == [("r1", "c1")]
    assert documents.parse_remote("https://gte-model-serving.apps.x/v1/embeddings") == ("https://gte-model-serving.apps.x/v1", "gte")
    assert documents.resolve_runs([str(tmp_path)])[tmp_path.name][0].endswith("a.txt")


def test_report_says_where_it_ends(spark, tmp_path):
    rows = spark.range(5)
    assert "The first 3 rows." in sinks.report(rows, "t", str(tmp_path / "a.html"), 3)
    assert "The first" not in sinks.report(rows, "t", str(tmp_path / "b.html"), 5)


def test_prompt_registry(spark):
    prompts = spark.createDataFrame([("judge", "s", "u"), ("ground", None, "u")], "name string, system string, user string")
    first = sinks.changed_prompts(prompts, spark.createDataFrame([], "name string, digest string"))
    assert first.count() == 2 and sinks.changed_prompts(prompts, first).count() == 0


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "view", 1.0) for i in range(9)], "event_id int, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_folder(spark, str(tmp_path / "in"), rows.schema)
    got = ingest.run_to_end(ingest.usage_by_window(stream), "usage_test", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.usage_by_window(rows).collect()))


def test_registry_is_complete():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 70
